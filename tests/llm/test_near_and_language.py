import os

import numpy as np
import pytest
from brute import near_components, random_texts
from conftest import HARD
from pyspark.sql import functions as F

from answerscope.llm import near_dedup as near
from answerscope.llm.components import components
from answerscope.llm.language_id import ORDER, Model, _grams, fit, identify, kneser_ney
from answerscope.llm.near_dedup import near_dedup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size, percent, seed", [(3, 85, 1), (5, 80, 2), (1, 50, 3)])
def test_components_against_brute_force(spark, size, percent, seed):
    texts = random_texts(90, [f"w{i}" for i in range(200)], 60, seed)
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(docs, size, percent).collect()}
    want = near_components(rows, size, percent)
    assert [got[k] for k, _ in rows] == want


def test_large_bucket_of_loose_copies(spark, monkeypatch):
    """A group in which pairs are on both sides of the threshold, searched blockwise."""
    monkeypatch.setattr(near, "SMALL_BUCKET", 3)
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 9), replace=False):
            w[k] = f"n{i}x{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(docs, 3, 85).collect()}
    assert [got[k] for k, _ in rows] == near_components(rows, 3, 85)


def test_near_hard_rows(hard, nothing):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_dedup(hard, 3, 85).collect())
    assert got == sorted((str(k), n, str(c)) for (k, _), (n, c) in zip(HARD, near_components(HARD, 3, 85)))
    assert near_dedup(hard).where("doc_id is null and not kept").count() == 0
    assert near_dedup(nothing).collect() == []


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    a, b = np.unique(values[:2200]), np.unique(values[1800:])
    rows = near.registers([a, b, np.unique(values), np.zeros(0, np.uint64)])
    assert (near.merge_registers(rows[0], rows[1]) == rows[2]).all() and not rows[3].any()
    pairs = [(np.unique(values[:1000]), np.unique(values[k:1000 + k])) for k in (0, 50, 100, 300, 1000)]
    ra, rb = near.registers([x for x, _ in pairs]), near.registers([y for _, y in pairs])
    sizes = np.full(5, 1000.0)
    true = np.array([len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for x, y in pairs])
    assert np.abs(near.estimate(ra, rb, sizes, sizes) - true).max() < 0.16


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 299)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_probabilities_add_up():
    codes, _ = _grams(["the cat sat on the mat", "the dog ran"])
    grams, counts = np.unique(codes, return_counts=True)
    model = kneser_ney(["en"], np.zeros(len(grams), int), grams, counts)
    letters = model.grams[1]
    for context in (0x746865, 0x207468, 0x717171):  # seen and unseen contexts of three characters
        context = np.uint64(sum(((context >> (8 * k)) & 0xFF) << (16 * k) for k in range(3)))
        total = np.exp(model.score((context << np.uint64(16)) | letters)).sum()
        # The rest is the share of characters never seen.
        assert total < 1.0001 and total + np.exp(model.unknown) > 0.98


def test_grams_of_texts():
    codes, bounds = _grams(["Ab c", None, "", "12", "é"])
    text = lambda c: "".join(chr((int(c) >> (16 * k)) & 0xFFFF) for k in range(ORDER - 1, -1, -1))
    assert [text(c) for c in codes[:bounds[1]]] == ["   a", "  ab", " ab ", "ab c", "b c "]
    assert list(np.diff(bounds)) == [5, 0, 0, 0, 2] and [text(c) for c in codes[bounds[4]:]] == ["   é", "  é "]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    done = identify(docs, fit(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    held = done.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95
    assert done.where("score < 0 or score > 1").count() == 0


def test_language_hard_rows(spark, hard, nothing):
    training = spark.createDataFrame(
        [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog are on the mat", "en"), ("der hund und die katze sind auf der matte", "de")] * 8)]
        + [(None, "zzzz", "xx"), (99, None, "yy"), (100, "no language", None)], "doc_id bigint, text string, lang string")
    model = fit(training)
    assert model.langs == ["de", "en"]
    out = identify(hard, model)
    got = out.collect()
    assert len(got) == len(HARD) and all(0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) for (k, t) in HARD
               for r in got if k is not None and r.doc_id == k and k not in (5,))
    texts = spark.createDataFrame([(1, "the dog and the cat"), (2, "die katze und der hund"), (3, "漢字漢字漢字漢字漢字")], "doc_id bigint, text string")
    said = {r.doc_id: r for r in identify(texts, model).collect()}
    assert (said[1].lang_pred, said[2].lang_pred) == ("en", "de") and said[3].rejected
    assert identify(nothing, model).collect() == []
    assert fit(nothing).langs == [] and {r.lang_pred for r in identify(hard, Model([])).collect()} == {"und"}


def test_every_gram_is_in_the_model(spark):
    """Over four million grams, each seen once."""
    text = F.pandas_udf(lambda ids: ids.map(lambda i: "".join(map(chr, np.random.default_rng(i).integers(0x4E00, 0x9F00, 60_000)))), "string")
    docs = spark.range(0, 100, 1, 8).select(F.col("id").alias("doc_id"), text("id").alias("text"), F.lit("zh").alias("lang"))
    model = fit(docs, calibration_rows=1)
    assert model.langs == ["zh"] and len(model.opened().grams[ORDER]) > 4_000_000


def test_files_hold_the_plain_model(spark, monkeypatch):
    from answerscope.llm import language_id

    monkeypatch.setattr(language_id, "PACK", 1024)
    rng = np.random.default_rng(6)
    rows = [(str(i % 3), "".join(map(chr, rng.choice([*range(97, 110), 0x4E00, 0xAC00, 0xD55C, 0x20], 300)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    table = language_id.count_grams(docs).toPandas()
    want = kneser_ney(["0", "1", "2"], table.lang.astype(int).to_numpy(), table.gram.to_numpy().view(np.uint64), table.n.to_numpy())
    got = language_id.kneser_ney_files(language_id.count_grams(docs)).opened()
    assert got.langs == want.langs and got.unknown == want.unknown
    for order in range(1, ORDER + 1):
        assert (got.grams[order] == want.grams[order]).all() and (got.contexts[order] == want.contexts[order]).all()
        assert np.allclose(got.logs[order], want.logs[order], atol=1e-5) and np.allclose(got.backoffs[order], want.backoffs[order], atol=1e-5)


def test_pairs_of_low_estimates_are_verified(spark):
    """Pairs at the threshold whose registers agree least, of 60,000 tried."""
    seeds = (6622, 7623, 12855, 30425, 31658, 44089)
    rows = [(2 * k + side, " ".join(f"s{s}w{i}" for i in range(3 * side, 37 + 3 * side))) for k, s in enumerate(seeds) for side in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(docs, 1, 85).collect()}
    want = near_components(rows, 1, 85)
    assert [got[k] for k, _ in rows] == want and {c for _, c in want} == {0, 2, 4, 6, 8, 10}

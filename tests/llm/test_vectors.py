"""Whitening, hard negatives and near vectors against brute force, also on hard rows."""

import os

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from answerscope.llm import hard_negatives as hard_module, near_vectors as near_module
from answerscope.llm.hard_negatives import hard_negatives
from answerscope.llm.near_vectors import near_vectors
from answerscope.llm.queries import QUERIES
from answerscope.llm.whitening import whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, label int, embedding array<float>"
NAN, INF = float("nan"), float("inf")


def clustered(n, dim, groups, spread, seed, labels=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, dim))
    x = (base[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    return [(int(i), int(l), [float(c) for c in v]) for i, (l, v) in enumerate(zip(rng.integers(0, labels, n), x))]


#: Null keys, labels, vectors and entries, NaN and infinity, another length, zeros, repeated rows and keys, ties.
HARD = [*clustered(40, 4, 8, 0.1, 1), (41, None, [1.0, 0.0, 0.0, 0.0]), (42, 1, None), (43, 1, [1.0, None, 0.0, 0.0]), (44, 1, [NAN, 0.0, 1.0, 0.0]),
        (45, 1, [INF, 0.0, 1.0, 0.0]), (46, 1, [1.0, 2.0]), (47, 1, []), (48, 1, [0.0] * 4), (None, 1, [1.0, 0.5, 0.0, 0.0]),
        (50, 1, [1.0, 0.5, 0.0, 0.0]), (50, 1, [1.0, 0.5, 0.0, 0.0]), (50, 2, [1.0, 0.5, 0.0, 0.25]), (51, 1, [1.0, 0.5, 0.0, 0.0]), (None, None, None)]
TAKEN = ("uid", "key", "x", "z", "n", "rank", "copies", "block", "part", "id", "p", "crowd", "component", "n_links", "kept", "vector", "anchor", "i", "j", "v")


def table(spark, rows):
    """With further columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"mine:{c}") for c in TAKEN})


def check_whitened(got, rows, **how):
    keep = [(k, v) for k, _, v in rows if brute.usable_vector(v, 4)]
    n, deviation, white, explained = brute.whitened([v for _, v in keep], how.get("components", 16), 64, 1_000_000, how.get("weights") == "count")
    want = sorted(zip([str(k) for k, _ in keep], deviation.tolist(), white.tolist()), key=lambda r: (r[0], r[1]))
    got = sorted(((str(r.vec_id), int(r.deviation), r.whitened, r.n, r.explained, r.identity_error) for r in got), key=lambda r: (r[0], r[1]))
    assert [g[:2] for g in got] == [w[:2] for w in want] and {g[3] for g in got} == {n}
    a, b = np.array([g[2] for g in got]), np.array([w[2] for w in want])
    assert np.abs(a * np.sign((a * b).sum(axis=0)) - b).max(initial=0) < 1e-9
    assert all(np.allclose(g[4], explained, rtol=1e-9) and g[5] < 1e-9 for g in got)


@pytest.mark.parametrize("weights, components", [("one", 16), ("count", 16), ("one", 2)])
def test_whitening_of_hard_rows(spark, weights, components):
    check_whitened(whiten(table(spark, HARD), weights=weights, components=components).collect(), HARD, weights=weights, components=components)


def test_whitening_without_variance(spark):
    assert whiten(table(spark, HARD).where("1 = 0")).collect() == []
    same = [(i, 0, [1.0, 2.0, 3.0, 4.0]) for i in range(3)]
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whiten(table(spark, same)).collect()] == [(1, 0, [], [], 0.0)] * 3
    line = [(i, 0, [float(i), 0.0, -2.0 * i, 7.0]) for i in range(5)]
    rows = whiten(table(spark, line)).orderBy("vec_id").collect()
    assert all(len(r.whitened) == 1 and abs(r.explained[0] - 1) < 1e-12 for r in rows)
    assert abs(sum(r.whitened[0] ** 2 for r in rows) / 5 - 1) < 1e-9


def test_whitening_of_far_values(spark):
    """Entries whose sums leave 64 bits stay exact."""
    rows = [(i, 0, [1e30 if i % 2 else -1e30, 3e16 * i, 1.0 * i, 0.0]) for i in range(6)]
    got = {r.vec_id: r.deviation for r in whiten(table(spark, rows), offset=0).collect()}
    cut = 1 << 62
    x = [[max(-cut, min(cut, int(np.floor(64 * float(np.float32(c)))))) for c in v] for _, _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((6 * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    assert [got[i] for i in range(6)] == [w if w < 10 ** 38 else None for w in want]


def test_whitening_query(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, deviation, white, explained = brute.whitened([v for _, _, v in rows], 16, 64, 1_000_000, False)
    got = {(r.vec_id, r.component): r for r in QUERIES["op11_whitening"](spark, SF).collect()}
    assert len(got) == 16 * len(rows)
    for k in range(16):
        z = np.array([got[v, k + 1].whitened for v, _, _ in rows])
        assert min(np.abs(z - white[:, k]).max(), np.abs(z + white[:, k]).max()) < 1e-9
        assert all(abs(got[v, k + 1].explained / explained[k] - 1) < 1e-9 and got[v, k + 1].identity_error < 1e-9 for v, _, _ in rows)
        assert [got[v, k + 1].deviation for v, _, _ in rows] == deviation.tolist() and got[rows[0][0], 1].n == n


def check_negatives(spark, rows, anchor, column, **how):
    given = [r for r in rows if r[0] is not None and r[1] is not None and brute.usable_vector(r[2], 4)]
    how = {"positives": 5, "negatives": 3, "low": 50, "high": 95, "scale": 256} | how
    size = how.pop("cluster_size", 512)
    got = sorted(tuple(r) for r in hard_negatives(table(spark, rows), column, cluster_size=size, **how).collect())
    want = brute.hard_negatives(given, anchor, **how)
    assert got == want
    return want


@pytest.mark.parametrize("size, how", [(512, {}), (3, {}), (1, {"low": 0, "high": 100, "negatives": 5}), (4, {"positives": 1, "low": -100})])
def test_negatives_of_hard_rows(spark, size, how):
    assert check_negatives(spark, HARD, lambda k: k % 2 == 0, F.col("vec_id") % 2 == 0, cluster_size=size, **how)


def test_negatives_with_ties_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(hard_module, "SEGMENT", 16)
    monkeypatch.setattr(hard_module, "MEMBERS", 5)
    rows = [(i, i % 3, [float(i % 4), 1.0, 2.0, float(i % 2)]) for i in range(90)] + clustered(60, 4, 4, 0.05, 3)
    assert check_negatives(spark, rows, lambda k: k % 5 == 0, F.col("vec_id") % 5 == 0, cluster_size=8)


def test_negatives_of_nothing(spark):
    assert hard_negatives(table(spark, HARD).where("1 = 0"), F.lit(True)).collect() == []
    assert hard_negatives(table(spark, HARD), F.lit(None).cast("boolean")).collect() == []


def test_walk_ends_when_certified():
    """A list sorted by bound is left as soon as no member can use the rest."""
    rng = np.random.default_rng(4)
    near, far = rng.integers(90, 110, (3, 4)), rng.integers(-110, -90, (5000, 4))
    import pyarrow as pa

    def rows(x, first, **more):
        n = len(x)
        return {"uid": pa.array(range(first, first + n), pa.int64()), "key": pa.array(range(first, first + n), pa.int64()), "label": pa.array(["a"] * n),
                "x": near_module.packed(x.astype(np.int64)), **more}

    void = {"rank": pa.array([[]] * 3, pa.list_(pa.int64())), "score": pa.array([[]] * 3, pa.list_(pa.int64())), "low": pa.array([[-np.inf]] * 3)}
    walk = hard_module._Walk(pa.table(rows(near, 0, **void)), 4, 2, (None, None))
    first = pa.RecordBatch.from_pydict(rows(near, 0, bound=pa.array([1e3] * 3)))
    rest = pa.RecordBatch.from_pydict(rows(far, 3, bound=pa.array([-100.0] * 5000)))
    assert walk.step(first) and not walk.step(rest)
    assert walk.result().num_rows == 6


def check_near(spark, rows, threshold=0.98, **how):
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near_vectors(table(spark, rows), threshold, **how).collect())
    want = brute.near_vectors(rows, threshold)
    assert got == sorted((str(k), n, str(c), k is None or k == c) for (k, _, _), (n, c) in zip(rows, want))
    return want


def test_near_vectors_of_hard_rows(spark):
    rows = [r if r[2] is None or len(r[2]) in (0, 4) else (r[0], r[1], None) for r in HARD]
    assert any(n for n, _ in check_near(spark, rows, 0.98))
    check_near(spark, rows, 0.9, pivots=64)
    assert near_vectors(table(spark, HARD).where("1 = 0")).collect() == []


def test_near_vectors_of_other_lengths_stand_alone(spark):
    got = {r.vec_id: r for r in near_vectors(table(spark, HARD)).where("vec_id in (46, 47)").collect()}
    assert all(r.n_links == 0 and r.component_id == k and r.kept for k, r in got.items()) and len(got) == 2


@pytest.mark.parametrize("spread", [0.05, 0.09, 0.13])
def test_crowds(spark, monkeypatch, spread):
    """Groups inside, around and beyond the angle at which a crowd is counted without comparison, in several blocks."""
    monkeypatch.setattr(near_module, "BLOCK", 16)
    rows = clustered(260, 64, 3, spread, 7, labels=2) + [(1000 + i, 0, [1.0] + [0.0] * 63) for i in range(30)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(table(spark, rows)).collect()}
    want = brute.near_vectors(rows, 0.98)
    assert sum(n for n, _ in want) > 800 and [got[k] for k, _, _ in rows] == want


def test_recall(spark):
    """Links of loose groups among many single vectors: at least 0.9 are found, and none is made up."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(700, 64))
    copies = base[:150] + 0.13 * rng.normal(size=(150, 64))
    rows = [(i, 0, [float(c) for c in v]) for i, v in enumerate(np.concatenate((base, copies)).astype(np.float32))]
    x = np.array([v for _, _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = (x @ x.T >= 0.98).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in near_vectors(table(spark, rows)).collect()}
    found = np.array([got[k] for k, _, _ in rows])
    assert (found <= true).all() and true.sum() > 100 and found.sum() >= 0.9 * true.sum()

"""The registered corpus queries on the smallest tables, and the pipeline against brute force."""

import os

import pytest
from brute import benchmark_hits, near_components, repeated_bytes, repeated_words

import corpus_pipeline
from pyspark.sql import functions as F
from answerscope.llm.queries import QUERIES
from answerscope.llm.quality_rules import judge
from answerscope.llm.sql import ORACLES
from oracle import connect, differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) == []


def _sha(data):
    import hashlib

    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_substring_query(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op1_substring_dedup"](spark, SF).collect()}
    assert got == {k: (n, m, _sha(kept)) for (k, _), (n, m, kept) in zip(texts, repeated_words([t for _, t in texts], 35))}


def test_suffix_query(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in QUERIES["op4_suffix_dedup"](spark, SF).collect()}
    assert got == {k: (n, m, _sha(kept)) for (k, _), (n, m, kept) in zip(texts, repeated_bytes(texts, 100))}


def test_near_query(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_near_dedup"](spark, SF).collect()}
    assert got == dict(zip([k for k, _ in texts], near_components(texts, 3, 85)))


def test_language_query(spark):
    rows = QUERIES["op6_language_id"](spark, SF).collect()
    assert len(rows) == 200 and {r.lang_pred for r in rows} <= {"de", "en", "es", "fr", "und"}


def test_pipeline_against_brute_force(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality rules"](spark, docs, SF).cache()
    want = {k: j[10] for k, t in texts for j in [judge(t, 30)] if j[9]}
    assert {r.doc_id: r.text for r in kept.collect()} == want and kept.columns == docs.columns
    lines = stage["line dedup"](spark, kept, SF).cache()
    assert lines.count() == len(want) and lines.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    near = stage["near dedup"](spark, lines, SF).cache()
    assert {r.doc_id for r in near.collect()} == {k for (k, _), (_, c) in zip(rows, near_components(rows, 5, 80)) if k == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stage["decontamination"](spark, near, SF)
    left = {r.doc_id: r.text for r in near.collect()}
    assert {r.doc_id for r in clean.collect()} == {k for k, t in left.items() if not benchmark_hits(t, items, 10)[0]}
    mixed = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) <= set(mixed.columns) and mixed.select("doc_id").distinct().count() <= len(left)


def test_one_row_of_a_group_stays(spark):
    one = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(4, one), (2, one), (2, one), (None, one), (None, one + " more"), (None, other), (None, other),
            (9, None), (9, None), (8, ""), (7, "v1 v2 v3 v4 v5 v6")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("number", F.lit("mine"))
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in out.collect()) == sorted(
        [(2, one), (0, other), (9, ""), (9, ""), (8, ""), (7, "v1 v2 v3 v4 v5 v6")])

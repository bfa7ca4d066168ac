"""Columns of the input under names that operators use inside come back as they were."""

import pytest
from conftest import HARD
from pyspark.sql import functions as F

import corpus_pipeline
from answerscope.llm.decontamination import clean_documents
from answerscope.llm.line_dedup import line_dedup
from answerscope.llm.mixing import mix_sources
from answerscope.llm.near_dedup import near_dedup

OPERATORS = {
    "lines": lambda d, items: line_dedup(d, least=3), "near": lambda d, items: near_dedup(d), "mixed": lambda d, items: mix_sources(d, {"s": 1.0}),
    "clean": lambda d, items: clean_documents(d, items)}
MADE = {"lines": {"n_lines", "n_dropped", "kept_text"}, "near": {"n_shingles", "component_id", "kept"}, "mixed": {"copy", "shuffle_key"}, "clean": set()}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_taken_names(spark, hard, name):
    items = spark.createDataFrame([("i", "nothing of the kind stands anywhere in these few short texts")], "item_id string, text string")
    out = OPERATORS[name](hard, items)
    mine = [c for c in hard.columns if c not in ("doc_id", "text", "source", "lang", *MADE[name])]
    assert [c for c in out.columns if c not in MADE[name]] == [c for c in hard.columns if c not in MADE[name]]
    rows = out.select(*[F.col(f"`{c}`") for c in mine]).distinct().collect()
    assert [tuple(r) for r in rows] == [tuple(f"mine:{c}" for c in mine)]
    if name != "mixed":
        assert out.count() == len(HARD)


def test_stages_take_any_names(spark, hard):
    docs = hard.where("doc_id is not null").withColumn("n_chars", F.length("text"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert set(docs.columns) - {"copy"} <= set(out.columns), name
        if out.take(1):
            assert out.select("_r1", "_row", "_draw", "_lines").distinct().count() == 1, name

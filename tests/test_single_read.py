"""Operators with several passes compute a table's predictions once."""

import pytest
from pyspark.sql import functions as F

from answerscope.functions import text
from answerscope.operators import compare, disagreement, distributions, metrics, predict, ranking
from answerscope.plans import evaluation
from answerscope.sinks import reports


@pytest.fixture()
def counted(spark):
    """A table whose answers are counted as they are computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def answer(i, model):
        seen.add(1)
        return f"w{i} {model}" if i % 3 else "same"

    ids = spark.range(40).withColumn("model", F.explode(F.array(F.lit("a"), F.lit("b"))))
    rows = ids.select(
        F.col("id").alias("_id"), F.col("id").cast("string").alias("row_id"), "model", F.concat(F.lit("q"), "id").alias("question"),
        F.concat(F.lit("w"), "id", F.lit(" a c")).alias("context"), answer("id", "model").alias("answer"),
        (F.col("id") % 17 / 17.0).alias("score"))
    rows = rows.withColumns({"overlap": text.word_overlap(F.col("answer"), F.col("context")), "question_length": F.lit(2), "context_length": F.lit(5)})
    return rows, seen


@pytest.mark.parametrize("use", [
    lambda df, folder: evaluation.home_analysis(df)["headline"].collect() + evaluation_panels(df),
    lambda df, folder: distributions.box_overall(df, "overlap").collect(),
    lambda df, folder: metrics.metrics_document(df).collect(),
    lambda df, folder: disagreement.sample_pairs(df).collect(),
    lambda df, folder: compare.sample_wins(df, "a", "b").collect(),
    lambda df, folder: reports.write_wide(df, "a", "b", folder),
], ids=["home", "box", "document", "pairs", "wins", "wide"])
def test_rows_are_computed_once(counted, use, tmp_path, request):
    df, seen = counted
    use(df, str(tmp_path))
    # Overlap and answer may each evaluate the function once a row; the first view is made twice here.
    assert seen.value <= (4 if "home" in request.node.name else 2) * 80


def evaluation_panels(df):
    panels = evaluation.home_analysis(df)
    return [r for n in ("model_stats", "performance", "best_model", "score_histogram") for r in panels[n].collect()]


@pytest.mark.parametrize("use", [
    lambda df: ranking.best_model_extremes(df, False),
    lambda df: disagreement.pair_members(df, disagreement.sample_pairs(df)),
    lambda df: disagreement.side_by_side(df, disagreement.sample_pairs(df)),
    lambda df: disagreement.disagreement_sample(df),
], ids=["bottom", "members", "sides", "sample"])
def test_texts_of_found_rows_alone(counted, use):
    df, seen = counted
    rows = use(df)
    before = seen.value
    assert rows.count() and seen.value - before <= 2 * 20 and before <= 2 * 80


def test_wide_summary_is_that_of_the_rows(counted, tmp_path, spark):
    df, _ = counted
    reports.write_wide(df, "a", "b", str(tmp_path))
    lines = {r.value for r in spark.read.text(f"{tmp_path}/metadata.txt").collect()}
    found = compare.wide_summary(df, "a", "b").first().asDict()
    assert {f"total: {found['total']}", f"ties: {found['ties']}", f"wins_a: {found['wins_a']}"} <= lines and len(lines) == len(found)


def test_fan_out_splits_a_context_once(spark):
    inputs = spark.createDataFrame([("q", "b c")], "question string, context string")

    class Echo(predict.Predictor):
        def predict(self, questions, contexts):
            return [{"answer": "b x", "score": 1.0} for _ in questions]

    raw = predict.fan_out(inputs, [predict.Model(m, (Echo,)) for m in ("a", "b")], annotate=True)
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    # Bound to a lambda's variable, not repeated in the lambda over the answers.
    assert "transform(array(split(lower(context" in plan
    assert [r.overlap for r in raw.collect()] == [0.5, 0.5]


def test_clean_overlap_skips_what_changes_no_word(spark):
    df = spark.createDataFrame([("Cama!  x", "na cama; X"), (None, "a"), ("a", None), ("#", "#")], "a string, c string")
    plan = df.select(text.clean_overlap(F.col("a"), F.col("c")).alias("o"))
    assert [r.o for r in plan.collect()] == [1.0, 0.0, 0.0, 0.0]
    assert "trim(" not in plan._jdf.queryExecution().optimizedPlan().toString()

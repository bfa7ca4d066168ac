import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerscope.operators.distributions import QUARTILES, box_summary, score_describe
from answerscope.operators.quantiles import exact_quantiles, order_statistics, with_quantiles


def random_values():
    rng = random.Random(3)
    near = 0.5
    return {
        "uniform": [rng.random() for _ in range(3001)],
        "ties": [rng.choice([0.0, 0.25, 1.0]) for _ in range(999)],
        "constant": [0.3] * 50,
        "single": [0.7],
        "two": [0.1, 0.4],
        "three": [0.9, 0.1, 0.2],
        # Values far apart, and many that share the finest bucket.
        "spread": [10.0 ** rng.randrange(-12, 12) for _ in range(500)],
        "close": [near + i * 1e-16 for i in range(200)] + [1e12],
        "negative": [-rng.random() * 5 for _ in range(400)],
    }


def test_quantiles_equal_numpy(spark):
    values = random_values()
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("empty", None), (None, 0.5), ("ties", None)]
    df = spark.createDataFrame(rows, "model string, score double")
    probs = {"q0": 0.0, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99, "q100": 1.0}
    got = {r["model"]: r for r in exact_quantiles(df, "model", "score", probs).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-15), (k, name)


def test_describe_equals_pandas(spark):
    values = {k: v for k, v in random_values().items() if k not in ("spread", "close")}
    pdf = __import__("pandas").DataFrame([(k, v) for k, vs in values.items() for v in vs], columns=["model", "score"])
    expected = pdf.groupby("model")["score"].describe()
    for r in score_describe(spark.createDataFrame(pdf)).collect():
        e = expected.loc[r["model"]]
        assert r["count"] == e["count"]
        for ours, theirs in (("mean", "mean"), ("min", "min"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
            assert r[ours] == pytest.approx(e[theirs], abs=5.1e-5)
        assert (r["std"] is None) == bool(np.isnan(e["std"]))


def test_box_summary(spark):
    vs = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, -50.0]
    df = spark.createDataFrame([("m", v) for v in vs], "model string, score double")
    r = box_summary(df).first()
    q1, q2, q3 = np.quantile(vs, [0.25, 0.5, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [v for v in vs if low <= v <= high]
    assert (r.q25, r.q50, r.q75, r.lower_fence, r.upper_fence) == (q1, q2, q3, low, high)
    assert (r.whisker_low, r.whisker_high, r.outliers, r.n) == (min(inside), max(inside), len(vs) - len(inside), len(vs))


def test_value_counts_are_computed_once(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("model"), F.rand(1).alias("score"))
    q = order_statistics(df.where(F.col("score") >= 0), "model", "score", list(QUARTILES.values()))
    q.collect()
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_brackets_of_large_groups(spark):
    """Groups beyond the size that is bracketed as a whole: ties, order, scales, NaN; bit for bit the value of that rank."""
    rng = np.random.default_rng(8)
    values = {
        "sorted": np.arange(60_000) / 7, "ties": rng.integers(0, 5, 30_000) / 4, "mostly one": np.where(rng.random(20_000) < 0.9, 0.5, rng.random(20_000)),
        "scales": 10.0 ** rng.uniform(-200, 200, 20_000) * rng.choice([-1, 1], 20_000), "edge": np.r_[np.zeros(5001), np.ones(4999)],
        "infinite": np.r_[np.full(3000, -np.inf), rng.random(3000), np.full(2999, np.inf)], "just": rng.random(2001)}
    pdf = __import__("pandas").DataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("ties", float("nan"))] * 9, columns=["model", "score"])
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(6)
    probs = {"q0": 0.0, "q01": 0.001, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q999": 0.9995, "q100": 1.0}
    got = {r["model"]: r for r in with_quantiles(df, "model", "score", probs, F.count(F.lit(1)).alias("rows")).collect()}
    for k, vs in values.items():
        ordered = np.sort(vs)
        assert got[k].rows == len(vs) + 9 * (k == "ties")
        for name, p in probs.items():
            at = (len(vs) - 1) * p
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            with np.errstate(invalid="ignore"):
                want = low + (high - low) * (at - np.floor(at))
            assert got[k][name] == want or (np.isnan(want) and np.isnan(got[k][name])), (k, name)


def test_two_passes(spark):
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            passed.add(len(b))
            yield b

    df = spark.range(9000).select((F.col("id") % 3).cast("string").alias("model"), (F.col("id") / 7).alias("score")).mapInPandas(counted, "model string, score double")
    assert with_quantiles(df, "model", "score", QUARTILES, F.avg("score").alias("m")).count() == 3
    assert with_quantiles(df, "model", "score", QUARTILES, F.avg("score").alias("m")).collect() and passed.value <= 9000 * 2 + 9000 * 2


def test_a_missed_rank_is_an_error(spark, monkeypatch):
    """A bracket that cannot hold its rank fails the query; nothing near is returned."""
    from answerscope.operators import quantiles

    monkeypatch.setattr(quantiles, "MARGIN", -0.01)
    df = spark.range(5000).select(F.lit("m").alias("model"), F.rand(3).alias("score"))
    with pytest.raises(Exception, match="bracket"):
        exact_quantiles(df, "model", "score", {"q": 0.5}).collect()


def test_no_join_by_key(spark):
    """Without adaptive execution nothing may rest on a join of all values by model."""
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("model"), F.rand(1).alias("score"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for q in (exact_quantiles(df, "model", "score", QUARTILES), box_summary(df)):
            assert "SortMergeJoin" not in q._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_far_outlier(spark):
    values = [i / 1000 for i in range(2000)] + [1e12, -1e15]
    df = spark.createDataFrame([("m", v) for v in values], "model string, score double")
    r = exact_quantiles(df, "model", "score", {"a": 0.1, "b": 0.5, "c": 0.9}).first()
    assert [r.a, r.b, r.c] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.9])), rel=1e-12)


def test_disagreement_has_no_object_aggregate(spark, table):
    from answerscope.operators.disagreement import disagreement

    df = table([("1", "q", "c", m, a, 0.5, 1.0) for m, a in (("a", "x"), ("b", "y"), (None, "x"))])
    q = disagreement(df)
    r = q.first()
    assert (r.n_rows, r.n_models, r.n_answers, r.level) == (3, 3, 2, "partial_disagreement")
    assert "ObjectHashAggregate" not in q._jdf.queryExecution().executedPlan().toString()

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from answerscope.operators import distributions, filters, metrics
from answerscope.sources.columns import annotate


def values(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def random_pdf():
    rng = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({
        "_id": [str(i) for i in range(n)], "model": rng.choice(["m1", "m2", "m3"], n),
        "question": [f"q {i % 40} wo rd" for i in range(n)], "context": [f"c {i % 40}" for i in range(n)],
        "answer": rng.choice(["a", "b", None], n), "score": rng.random(n), "overlap": rng.random(n).round(2)})
    pdf.loc[rng.choice(n, 60, replace=False), "score"] = np.nan
    pdf["question_length"] = pdf["question"].str.len() + rng.integers(0, 5, n)
    pdf["context_length"] = 7
    return pdf


@pytest.fixture(scope="module")
def random_df(spark, random_pdf):
    df = spark.createDataFrame(random_pdf)
    return df.withColumn("score", F.when(~F.isnan("score"), F.col("score"))).cache()


def test_per_model_metrics(table):
    df = table([("1", "q", "c", "m1", "a", 0.2, 1.0), ("2", "q", "c", "m1", "a", None, 0.0),
                ("3", "q", "c", "m1", "a", 0.6, 0.5), ("4", "q", "c", "m2", "a", None, 0.25),
                ("5", "q", "c", None, "a", 0.9, 0.25)])
    got = {r["model"]: r for r in metrics.per_model_metrics(df).collect()}
    assert set(got) == {"m1", "m2"}
    assert tuple(got["m1"])[1:] == (3, pytest.approx(0.4), pytest.approx(0.4), 0.5)
    assert tuple(got["m2"])[1:] == (1, None, None, 0.25)


def test_overall_of_nothing(table):
    assert values(metrics.overall_metrics(table([]))) == [(0, 0.0)]
    assert values(metrics.avg_unique_answers(table([]))) == [(0.0,)]


def test_agreement_counts_null_apart_and_drops_null_pairs(table):
    df = table([("1", "q", "c", "m1", None, 0.1, 0.0), ("1", "q", "c", "m2", "", 0.1, 0.0),
                ("2", "q2", "c", "m1", "x", 0.1, 0.0), ("2", "q2", "c", "m2", "x", 0.1, 0.0),
                ("3", None, "c", "m1", "x", 0.1, 0.0), ("3", "q", None, "m1", "x", 0.1, 0.0)])
    assert sorted(values(metrics.agreement_groups(df).drop("pair_id"))) == [(2, 1), (2, 2)]
    assert values(metrics.avg_unique_answers(df)) == [(1.5,)]


def test_risk_counts(table):
    df = table([(str(i), "q", "c", "m", "a", s, 0.0) for i, s in enumerate([0.8, 0.5, 0.4999, None])])
    assert values(metrics.risk_counts(df)) == [("high_risk", 2), ("low_risk", 1), ("medium_risk", 1)]


def test_document(table):
    df = table([("1", "q", "c", "m1", "a", 0.9, 1.0), ("1", "q", "c", "m2", "b", None, 0.0)])
    doc = metrics.metrics_document(df).first().asDict(recursive=True)
    assert doc["overall"] == {"total_predictions": 2, "avg_overlap": 0.5}
    assert doc["per_model"]["m2"] == {"count": 1, "mean_score": None, "median_score": None, "avg_overlap": 0.0}
    assert doc["comparative"] == {"avg_unique_answers": 2.0}
    assert doc["categorical"] == {"high_risk": 1, "low_risk": 1}


def test_document_of_nothing_and_without_overlap(table):
    doc = metrics.metrics_document(table([])).first().asDict(recursive=True)
    assert doc == {"overall": {"total_predictions": 0, "avg_overlap": 0.0}, "per_model": {},
                   "comparative": {"avg_unique_answers": 0.0}, "categorical": {}}
    bare = table([("1", "q", "a b", "m", "a c", 0.9, 1.0), ("1", "q", "a b", None, "a", 0.9, 1.0)]).drop("overlap")
    doc = metrics.metrics_document(bare).first().asDict(recursive=True)
    assert doc["overall"] == {"total_predictions": 2, "avg_overlap": 0.75}
    assert list(doc["per_model"]) == ["m"] and doc["per_model"]["m"]["avg_overlap"] == 0.5
    assert doc["categorical"] == {"low_risk": 2}


def test_annotate_defaults(spark):
    out = annotate(spark.createDataFrame([("q",)], "question string")).first()
    assert (out.answer, out.context, out.overlap, out.context_length, out.question_length) == (None, "", 0.0, 0, 1)
    out = annotate(spark.createDataFrame([(None, "abc", "x")], "question string, context string, answer string")).first()
    assert (out.context_length, out.question_length) == (3, 0)


def test_model_stats_equal_pandas(random_df, random_pdf):
    kept = random_pdf[random_pdf["score"].fillna(0) >= 0.0]
    expected = kept.groupby("model").agg(mean=("score", "mean"), n=("score", "count"), std=("score", "std"),
                                         overlap=("overlap", "mean")).round(4)
    for r in metrics.model_stats(filters.filter_home(random_df)).collect():
        e = expected.loc[r["model"]]
        assert r.scored == e["n"]
        assert (r.score_mean, r.score_std, r.overlap_mean) == pytest.approx((e["mean"], e["std"], e["overlap"]), abs=1.01e-4)


def test_best_model_takes_the_first_name_on_a_tie(table):
    df = table([("1", "q", "c", m, "a", 0.1, o) for m, o in (("z", 0.5), ("b", 0.5), ("a", 0.4))])
    assert metrics.best_model(df).first()["model"] == "b"


def test_overlap_by_confidence(table):
    df = table([("1", "q", "c", "m", "a", 0.8, 0.5), ("2", "q", "c", "m", "a", 0.9, 1.0), ("3", "q", "c", "m", "a", 0.6, 0.1)])
    assert values(metrics.overlap_by_confidence(df)) == [(0.75, 0.0)]


def test_filters(table):
    df = table([("1", "Find It", "c", "m1", "x", None, 0.5), ("2", "q", "c", "m1", "FINDER", 0.5, None),
                ("3", None, "c", "m2", None, 0.05, 0.9)]).withColumn("question_length", F.length("question"))
    ids = lambda d: sorted(r["_id"] for r in d.collect())
    assert ids(filters.filter_home(df)) == ["1", "2", "3"]
    assert ids(filters.filter_home(df, min_score=0.1)) == ["2"]
    assert ids(filters.filter_home(df, min_overlap=0.1)) == ["1", "3"]
    assert ids(filters.filter_home(df, models=[])) == []
    assert ids(filters.filter_home(df, models=["m2"])) == ["3"]
    assert ids(filters.filter_home(df, keyword="FIND")) == ["1", "2"]
    assert ids(filters.filter_home(df, keyword="f.nd")) == ["1", "2"]
    assert ids(filters.filter_home(df, keyword="f.nd", literal=True)) == []
    assert ids(filters.filter_advanced(df, (0.0, 1.0))) == ["2"]
    assert ids(filters.filter_advanced(df, models=[])) == ["2"]
    assert ids(filters.filter_advanced(df.drop("question_length"), (0.0, 1.0))) == ["2", "3"]
    assert values(filters.retention(df, F.col("score") >= 0.1)) == [(1, 3, pytest.approx(100 / 3))]
    assert values(filters.observed_ranges(df)) == [(0.05, 0.5, 1, 7)]


def test_correlations_equal_pandas(random_df, random_pdf):
    names = ["score", "overlap", "question_length", "context_length"]
    expected = random_pdf[names].corr()
    got = {(r.var1, r.var2): r.r for r in distributions.correlation_matrix(random_df).collect()}
    assert len(got) == 16
    for (a, b), r in got.items():
        e = expected.loc[a, b]
        assert (r is None) if math.isnan(e) else r == pytest.approx(e, abs=1e-9)
    pairs = distributions.correlation_pairs(random_df).collect()
    assert len(pairs) == 6 and {p.var1 for p in pairs[3:] if p.r is None} <= {"score", "overlap", "question_length"}
    with pytest.raises(ValueError):
        distributions.correlation_matrix(random_df.select("score"))


def test_constant_column_has_no_correlation(table):
    df = table([(str(i), "q", "c", "m", "a", 1.0, float(i)) for i in range(3)])
    assert values(distributions.correlation(df, "score", "overlap")) == [(None,)]


def test_trend(random_df, random_pdf):
    lines = distributions.trend(random_df, "overlap").collect()
    whole = random_pdf[["overlap", "score"]].corr().iloc[0, 1]
    assert len(lines) == 3
    for r in lines:
        part = random_pdf[random_pdf["model"] == r["model"]].dropna(subset=["score"])
        slope, intercept = np.polyfit(part["overlap"], part["score"], 1)
        assert (r.slope, r.intercept) == (pytest.approx(slope), pytest.approx(intercept))
        assert r.points == len(part)
        assert r.correlation == pytest.approx(whole)
    single = distributions.trend(random_df.drop("model"), "overlap").collect()
    assert len(single) == 1 and single[0].correlation == pytest.approx(whole)


@pytest.mark.parametrize("bins", [1, 7, 30])
def test_histogram_equals_numpy(random_df, random_pdf, bins):
    counts, edges = np.histogram(random_pdf["score"].dropna(), bins=bins)
    rows = distributions.histogram(random_df, "score", bins).orderBy("bin").collect()
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r.lower for r in rows] == pytest.approx(edges[:-1].tolist())
    assert rows[0].mean_value == pytest.approx(random_pdf["score"].mean())
    dense = distributions.density(random_df, "score", bins).collect()
    assert len(dense) == 3 * bins
    assert sum(r["count"] for r in dense) == counts.sum()


def test_histogram_edge_cases(table):
    assert distributions.histogram(table([]), "score", 5).collect() == []
    one = distributions.histogram(table([("1", "q", "c", "m", "a", 0.3, 0.0)] * 4), "score", 5).orderBy("bin").collect()
    assert [r["count"] for r in one] == [4, 0, 0, 0, 0]

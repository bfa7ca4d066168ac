import pandas as pd
import pytest
from pyspark.sql import functions as F

from answerscope.operators import compare, ranking
from answerscope.sources.columns import annotate


@pytest.fixture(scope="module")
def long(spark):
    rows = []
    for i in range(120):
        rows.append((str(i), f"q{i}", "x y z", "a", f"x{i % 4}", (i * 37 % 101) / 101, (i % 11) / 10))
        rows.append((str(i), f"q{i}", "x y z", "b", f" X{i % 3} ", None if i % 9 == 0 else (i * 53 % 97) / 97, (i % 7) / 6))
    schema = "_id string, question string, context string, model string, answer string, score double, overlap double"
    keep = spark.createDataFrame(rows, schema)
    return keep.withColumns({"question_length": F.length("question"), "context_length": F.length("context")}).cache()


@pytest.fixture(scope="module")
def wide(long):
    pdf = long.toPandas()
    a, b = (pdf[pdf["model"] == m].set_index("_id") for m in ("a", "b"))
    return pd.DataFrame({"a_answer": a.answer, "b_answer": b.answer, "a_score": a.score, "b_score": b.score,
                         "overlap_a": a.overlap, "overlap_b": b.overlap})


def winner(x, y):
    return "a" if x > y else "b" if y > x else "tie"


def test_wide_compare(long, wide):
    for r in compare.wide_compare(long, "a", "b", with_text=True).collect():
        w = wide.loc[r["_id"]]
        assert (r.a_answer, r.b_answer, r.a_score, r.overlap_a, r.overlap_b) == (
            w.a_answer, w.b_answer, w.a_score, w.overlap_a, w.overlap_b)
        assert r.b_score == w.b_score or (r.b_score is None and pd.isna(w.b_score))
        assert r.score_winner == winner(w.a_score, w.b_score)
        assert r.overlap_winner == winner(w.overlap_a, w.overlap_b)
        assert r.score_difference is None if pd.isna(w.b_score) else r.score_difference == w.b_score - w.a_score
        assert r.question == f"q{r['_id']}" and r.context == "x y z"


def test_best_worst(long, wide):
    for r in compare.best_worst(long, ("a", "b")).collect():
        w = wide.loc[r["_id"], ["a_score", "b_score"]]
        assert (r.best_score, r.worst_score) == (w.max(), w.min())
        assert r.best_score_model == ("a" if w.a_score == w.max() else "b")
        assert r.worst_score_model == ("a" if w.a_score == w.min() else "b")


def test_summary_and_wins(long, wide):
    s = compare.wide_summary(long, "a", "b").first()
    wins = [winner(x, y) for x, y in zip(wide.a_score, wide.b_score)]
    assert (s.total, s.wins_a, s.wins_b, s.ties) == (120, wins.count("a"), wins.count("b"), wins.count("tie"))
    assert s.mean_b_score == pytest.approx(wide.b_score.mean())
    counted = {(r.criterion, r.winner): r["count"] for r in compare.win_counts(long, "a", "b").collect()}
    assert [counted["score", w] for w in ("a", "b", "tie")] == [wins.count(w) for w in ("a", "b", "tie")]
    assert len(counted) == 6


def test_tiers_and_shares(long, wide):
    tiers = compare.tier_distribution(long, "a", "b").collect()
    assert [t.tier_rank for t in tiers] == [1, 2, 3, 4, 5, 6]
    for m in ("a", "b"):
        assert sum(t[f"{m}_count"] for t in tiers) == 120
        assert sum(t[f"{m}_pct"] for t in tiers) == pytest.approx(100)
    shares = {r.model: r for r in compare.risk_shares(long, "a", "b").collect()}
    for m in ("a", "b"):
        assert shares[m].risky == (wide[f"overlap_{m}"] < 0.2).sum()
        assert shares[m].explicit == (wide[f"overlap_{m}"] >= 0.6).sum()
    safer = "b" if shares["a"].risky_pct > shares["b"].risky_pct else "a"
    assert {r.safer_model for r in shares.values()} == {safer}


def test_empty_tiers_are_kept(long):
    only = long.where(F.col("overlap") == 0)
    rows = compare.tier_distribution(only, "a", "b").collect()
    assert [r.a_count for r in rows] == [0, 0, 0, 0, 0, 11]
    v = compare.overlap_verdicts(only, "a", "b").first()
    assert (v.a_verdict, v.b_verdict, v.mean_pct) == ("critical", "critical", 0.0)


def test_extremes(long, wide):
    top = compare.global_extremes(long, ("a", "b"), True).collect()
    best = wide[["a_score", "b_score"]].max(axis=1)
    assert sorted((r.best_score for r in top), reverse=True) == sorted(best, reverse=True)[:10]
    counts = compare.extreme_model_counts(long, ("a", "b")).collect()
    assert sum(r["count"] for r in counts) == 20
    rows = ranking.extreme_rows(long).collect()
    for m in ("a", "b"):
        ranked = wide[f"{m}_score"].sort_values(kind="stable")
        bottom = sorted(r.score for r in rows if r.model == m and r.end == "bottom")
        assert bottom == ranked.head(10).tolist()
        assert sorted(r["rank"] for r in rows if r.model == m and r.end == "top") == list(range(1, 11))


def test_nulls_last_both_ways(table):
    df = table([(str(i), "q", "c", "m", "a", s, 1.0) for i, s in enumerate([None, 0.2, 0.9])])
    assert [r.score for r in ranking.best_model_extremes(df, True).collect()] == [0.9, 0.2, None]
    assert [r.score for r in ranking.best_model_extremes(df, False).collect()] == [0.2, 0.9, None]


def test_sample_of_differing_rows(long, wide):
    picked = compare.sample_differing(long, "a", "b").collect()
    left_out = {r["_id"] for r in ranking.extreme_ids(long, ("a", "b")).collect()}
    assert len(picked) == 5 and not left_out & {r["_id"] for r in picked}
    assert all(r.a_answer.strip().lower() != r.b_answer.strip().lower() for r in picked)
    again = compare.sample_differing(long.repartition(5), "a", "b").collect()
    assert [r["_id"] for r in picked] == [r["_id"] for r in again]
    assert compare.sample_means(long, "a", "b").first().sampled == 5
    assert sum(r["count"] for r in compare.sample_wins(long, "a", "b").collect()) == 10
    # All 10 inputs are extremes: fewer than five remain, so nothing is sampled.
    assert compare.sample_differing(long.where(F.col("_id").cast("int") < 10), "a", "b").collect() == []


def test_top_per_group_spreads_a_large_group(spark):
    df = spark.range(20_000).select(F.lit("m").alias("model"), F.col("id").cast("string").alias("_id"),
                                    ((F.col("id") * 7919) % 20011).cast("double").alias("score"))
    out = ranking.top_per_group(df, "model", [F.desc("score")], 3, ["_id"])
    expected = sorted(((i * 7919) % 20011 for i in range(20_000)), reverse=True)[:3]
    assert [r.score for r in out.orderBy("rank").collect()] == expected
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_annotated_input_feeds_the_comparison(spark):
    rows = [("1", "q", "the cat", m, a, 0.5) for m, a in (("a", "cat"), ("b", "dog"))]
    df = annotate(spark.createDataFrame(rows, "_id string, question string, context string, model string, answer string, score double"))
    r = compare.wide_compare(df, "a", "b").first()
    assert (r.overlap_a, r.overlap_b, r.overlap_winner, r.score_winner) == (1.0, 0.0, "a", "tie")

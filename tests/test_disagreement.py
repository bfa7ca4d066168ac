from pyspark.sql import functions as F

from answerscope.functions.keys import PAIR_KEY, pair_of
from answerscope.operators import disagreement as d


def rows_of(question, answers, context="c", start=0):
    return [(f"{question}{start + i}", question, context, m, a, 0.1 * i, 0.5) for i, (m, a) in enumerate(answers)]


CASES = {
    "full": ([("m1", "a"), ("m2", "b"), ("m3", "c")], "full_disagreement"),
    "partial": ([("m1", "a"), ("m2", "a"), ("m3", "b")], "partial_disagreement"),
    "same": ([("m1", "a"), ("m2", "a"), ("m3", "a")], "no_disagreement"),
    "blank": ([("m1", None), ("m2", "")], "no_disagreement"),
    "lonely": ([("m1", "a")], "insufficient_models"),
    "repeated": ([("m1", "a"), ("m1", "b"), ("m2", "c")], "partial_disagreement"),
    "nameless": ([("m1", "a"), (None, "b")], "full_disagreement"),
}


def test_classes(table):
    rows = [r for q, (answers, _) in CASES.items() for r in rows_of(q, answers)]
    rows += [("n1", None, "c", "m1", "a", 0.1, 0.0), ("n2", None, "c", "m2", "b", 0.1, 0.0)]
    df = table(rows)
    keys = {bytes(r.k).hex(): r.question for r in
            df.select("question", pair_of(df).alias("k")).distinct().collect()}
    got = {keys[r.pair_id]: r.level for r in d.disagreement(df).collect()}
    assert got == {**{q: level for q, (_, level) in CASES.items()}, None: "insufficient_models"}
    # The stored key gives the same classes without reading texts.
    stored = df.withColumn(PAIR_KEY, pair_of(df)).drop("question", "context")
    assert {keys[r.pair_id]: r.level for r in d.disagreement(stored).collect()} == got


def many_pairs(table, pairs=60):
    rows = []
    for i in range(pairs):
        for m in ("m1", "m2"):
            rows.append((str(i), f"q{i}", "c", m, m if i % 2 else "same", i / pairs, 0.9 if m == "m1" else 0.1))
    return table(rows)


def test_sample_excludes_pairs_only_in_the_extremes(table):
    # One model per pair is best; its extreme rows alone do not remove the pair.
    df = many_pairs(table)
    chosen = d.sample_pairs(df).collect()
    assert len(chosen) == 5 and {c.level for c in chosen} == {"full_disagreement"}
    assert sorted(c.position for c in chosen) == [1, 2, 3, 4, 5]
    again = d.sample_pairs(df.repartition(7)).collect()
    assert sorted(chosen) == sorted(again)


def test_sample_drops_pairs_whose_rows_are_all_extremes(table):
    # Only m1 has these pairs twice under one text, and all its rows are extremes.
    rows = [("1", "q", "c", "m1", "a", 0.9, 0.9), ("2", "q", "c", "m1", "b", 0.8, 0.9)]
    assert d.sample_pairs(table(rows)).collect() == []
    rows += [("1", "q", "c", "m2", "z", 0.1, 0.0)]
    assert [r.level for r in d.sample_pairs(table(rows)).collect()] == ["partial_disagreement"]


def test_partial_fills_up_after_full(table):
    rows = rows_of("f", CASES["full"][0])
    for i in range(9):
        rows += rows_of(f"p{i}", CASES["partial"][0])
    chosen = d.sample_pairs(table(rows)).collect()
    assert sorted(c.level for c in chosen) == ["full_disagreement"] + ["partial_disagreement"] * 4


def test_side_by_side_and_members(table):
    df = table([("2", "q", "x" * 300, "m2", "later", 0.1, 0.1), ("1", "q", "x" * 300, "m2", "first", 0.2, 0.2),
                ("1", "q", "x" * 300, "m1", "other", 0.3, 0.9)])
    pairs = d.sample_pairs(df)
    shown = d.side_by_side(df, pairs).collect()
    assert [(r.model, r.answer) for r in shown] == [("m1", "other"), ("m2", "first")]
    assert shown[0].context_preview == "x" * 200 + "..."
    assert d.pair_members(df, pairs).count() == 3
    assert d.disagreement_sample(df).first().context == "x" * 300


def test_one_pair_with_most_rows(spark):
    # A third of all rows share one pair and one answer: they are counted before the shuffle.
    df = spark.range(30_000).select(
        F.col("id").cast("string").alias("_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("q"), F.col("id"))).alias("question"),
        F.lit("c").alias("context"), F.when(F.col("id") % 2 == 0, "m1").otherwise("m2").alias("model"),
        F.lit("same").alias("answer"), F.lit(0.5).alias("score"), F.lit(0.5).alias("overlap"))
    out = d.disagreement(df)
    assert out.agg(F.max("n_rows")).first()[0] == 10_000
    levels = {r.level: r["count"] for r in out.groupBy("level").count().collect()}
    assert levels == {"insufficient_models": 20_000, "no_disagreement": 1}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_count(1)" in plan and "SortMergeJoin" not in plan

"""Overall, per-model, agreement and risk metrics, and the nested document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bands import RISK_BANDS, performance_tier, risk_band
from ..functions.keys import PAIR_KEY, answer_key, is_complete, pair_id, pair_of
from ..functions.statistics import half_even
from ..functions.text import nonspace_count, word_count
from ..session import written
from ..sources.columns import annotate
from .quantiles import brackets, merged_summaries, select_ranks, summary_of, with_quantiles


def overall_metrics(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_predictions"),
                  F.coalesce(F.avg("overlap"), F.lit(0.0)).alias("avg_overlap"))


def per_model_metrics(df: DataFrame) -> DataFrame:
    """Rows, mean and median score, mean overlap per model.

    ``count`` counts rows; a model without any score has null statistics.
    """
    return with_quantiles(df, "model", "score", {"median_score": 0.5}, F.count(F.lit(1)).alias("count"),
                          F.avg("score").alias("mean_score"), F.avg("overlap").alias("avg_overlap")).select(
        "model", "count", "mean_score", "median_score", "avg_overlap")


def agreement_groups(df: DataFrame) -> DataFrame:
    """Per (question, context): rows and distinct answers; null is one answer.

    Pairs with a null side are left out. Texts are hashed before the shuffle,
    and one answer of one pair is one group first, so a pair with very many
    rows is spread over tasks and counted before it meets in one.
    """
    answer = F.col("_answer") if "_answer" in df.columns else answer_key(F.col("answer"))
    each = (df.groupBy(pair_of(df).alias("_pair"), answer.alias("_answer"))
            .agg(F.count(F.lit(1)).alias("_rows")))
    return agreement_of_counts(each)


def agreement_of_counts(counts: DataFrame) -> DataFrame:
    """As ``agreement_groups``, from rows counted by ``_pair`` and ``_answer`` in ``_rows`` (several counts add up)."""
    each = counts.where(is_complete(F.col("_pair"))).groupBy("_pair", "_answer").agg(F.sum("_rows").alias("_rows"))
    return (each.groupBy("_pair").agg(F.sum("_rows").alias("n_predictions"), F.count(F.lit(1)).alias("n_unique_answers"))
            .select(pair_id(F.col("_pair")).alias("pair_id"), "n_predictions", "n_unique_answers"))


def avg_unique_answers(df: DataFrame) -> DataFrame:
    return agreement_groups(df).agg(
        F.coalesce(F.avg("n_unique_answers"), F.lit(0.0)).alias("avg_unique_answers"))


def risk_counts(df: DataFrame) -> DataFrame:
    """Rows per risk band, most frequent first; empty bands do not appear."""
    return (df.groupBy(risk_band(F.col("score")).alias("risk_band")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "risk_band"))


def headline_metrics(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.avg(size).alias(f"mean_{name}") for name, size in question_sizes(df).items()],
        F.avg("score").alias("mean_score"), F.avg("overlap").alias("mean_overlap"))


def question_sizes(df: DataFrame) -> dict[str, Column]:
    """Words and characters of the question: stored columns of these names, else from the text."""
    if "question_words" in df.columns:
        return {n: F.col(n) for n in ("question_words", "question_chars")}
    return {"question_words": word_count(F.col("question")), "question_chars": nonspace_count(F.col("question"))}


def model_stats(df: DataFrame, digits: int = 4) -> DataFrame:
    """Per-model statistics of (filtered) rows; ``scored`` counts non-null scores."""
    stats = (df.where(F.col("model").isNotNull()).groupBy("model").agg(
        F.avg("score").alias("score_mean"), F.count("score").alias("scored"),
        F.stddev_samp("score").alias("score_std"), F.avg("overlap").alias("overlap_mean"),
        *[F.avg(size).alias(f"mean_{name}") for name, size in question_sizes(df).items()]))
    rounded = [c for c in stats.columns if c not in ("model", "scored")]
    return stats.withColumns({c: half_even(F.col(c), digits) for c in rounded})


def model_mean_overlap(df: DataFrame) -> DataFrame:
    return (df.where(F.col("model").isNotNull()).groupBy("model")
            .agg(F.avg("overlap").alias("mean_overlap")))


def best_model(df: DataFrame) -> DataFrame:
    """The model with the highest mean overlap; the first name on a tie."""
    return model_mean_overlap(df).orderBy(F.desc_nulls_last("mean_overlap"), "model").limit(1)


def performance_tiers(df: DataFrame) -> DataFrame:
    means = df.where(F.col("model").isNotNull()).groupBy("model").agg(F.avg("score").alias("mean_score"))
    return means.withColumn("tier", performance_tier(F.col("mean_score")))


def overlap_by_confidence(df: DataFrame, high: float = 0.8, low: float = 0.5) -> DataFrame:
    """Mean overlap of confident and of doubtful rows; 0 where there are none."""
    def mean_where(keep):
        return F.when(F.count_if(keep) > 0, F.avg(F.when(keep, F.col("overlap")))).otherwise(F.lit(0.0))

    return df.agg(mean_where(F.col("score") >= high).alias("overlap_high_score"),
                  mean_where(F.col("score") < low).alias("overlap_low_score"))


def dataset_profile(df: DataFrame) -> DataFrame:
    """Rows, mean and largest text lengths of the input table."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("context_length").alias("mean_context_length"), F.max("context_length").alias("max_context_length"),
        F.avg("question_length").alias("mean_question_length"), F.max("question_length").alias("max_question_length"))


def score_cells(df: DataFrame) -> DataFrame:
    """Mergeable sums per (model, band): ``model, band, n, s, scored, o, overlapped, summary``."""
    return df.groupBy("model", risk_band(F.col("score")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.count("score").alias("scored"),
        F.sum("overlap").alias("o"), F.count("overlap").alias("overlapped"), summary_of("score").alias("summary"))


def document_of(cells: DataFrame, scores: DataFrame, agreement: DataFrame, weight: str | None = None) -> DataFrame:
    """The metrics document from cells, rows with ``model`` and ``score`` (that count ``weight`` times), and the agreement.

    The rolled-up cells, one row per model, per band and in all, are one scalar
    from which the brackets of the medians and the document are made.
    """
    spark = cells.sparkSession
    by_model, by_band, everything = 1, 2, 3
    sums = [F.sum(c).alias(c) for c in ("n", "s", "scored", "o", "overlapped")]
    rolled = cells.groupingSets([["model"], ["band"], []], "model", "band").agg(
        F.grouping_id().alias("g"), *sums, merged_summaries("summary").alias("summary"))
    cell = F.struct("g", "model", "band", "n", "s", "scored", "o", "overlapped", "summary")
    every = spark.range(1).select(rolled.agg(F.collect_list(cell)).scalar().alias("every"))
    of_models = F.filter("every", lambda r: (r["g"] == by_model) & r["model"].isNotNull())
    by_key = F.map_from_entries(F.transform(F.filter(of_models, lambda r: r["summary"]["n"] > 0),
                                            lambda r: F.struct(r["model"], brackets(r["summary"], [0.5]))))
    medians = select_ranks(scores, "model", "score", every.select(by_key).scalar(), {"median_score": 0.5}, weight)
    medians = medians.agg(F.map_from_entries(F.collect_list(F.struct("model", "median_score")))).scalar()

    avg_overlap = lambda r: F.try_divide(r["o"], r["overlapped"])
    model = lambda r: F.struct(r["model"], F.struct(
        r["n"].alias("count"), F.try_divide(r["s"], r["scored"]).alias("mean_score"),
        F.try_element_at(F.col("medians"), r["model"]).alias("median_score"), avg_overlap(r).alias("avg_overlap")))
    place = F.create_map(*[F.lit(x) for i, (_, label) in enumerate(RISK_BANDS) for x in (label, i)])
    band = lambda r: F.struct((-r["n"]).alias("order"), place[r["band"]].alias("place"), r["band"], r["n"])
    overall = lambda r: F.struct(r["n"].alias("total_predictions"), F.coalesce(avg_overlap(r), F.lit(0.0)).alias("avg_overlap"))
    nothing = F.struct(F.lit(0).cast("long").alias("total_predictions"), F.lit(0.0).alias("avg_overlap"))
    # The grand total of an empty table is a row of nulls.
    total = F.filter("every", lambda r: (r["g"] == everything) & r["n"].isNotNull())
    bands = F.sort_array(F.transform(F.filter("every", lambda r: r["g"] == by_band), band))
    return every.withColumn("medians", medians).select(
        F.coalesce(F.try_element_at(F.transform(total, overall), F.lit(1)), nothing).alias("overall"),
        F.map_from_entries(F.sort_array(F.transform(of_models, model))).alias("per_model"),
        agreement.select(F.struct("avg_unique_answers")).scalar().alias("comparative"),
        F.map_from_entries(F.transform(bands, lambda b: F.struct(b["band"], b["n"]))).alias("categorical"))


def metrics_document(df: DataFrame) -> DataFrame:
    """One row with the nested parts overall, per_model, comparative, categorical.

    Counts, sums and sketches are taken once per (model, band); everything but the exact medians
    and agreement follows from these few rows. A table without overlap is annotated first.
    The table is read once: keys and numbers are written for the passes over it (runs a job).
    """
    if "overlap" not in df.columns:
        df = annotate(df)
    df = written(df.select("model", "score", "overlap", pair_of(df).alias(PAIR_KEY), answer_key(F.col("answer")).alias("_answer")), "document-rows")
    return document_of(score_cells(df), df, avg_unique_answers(df))


def document_rows(document: DataFrame) -> DataFrame:
    """A metrics document as rows ``section, item, metric, value``."""
    per_model = document.select(F.explode("per_model").alias("item", "s"))
    parts = [
        document.select(F.lit("overall"), F.lit(""), F.inline(_entries("overall", ["total_predictions", "avg_overlap"]))),
        per_model.select(F.lit("per_model"), "item",
                         F.inline(_entries("s", ["count", "mean_score", "median_score", "avg_overlap"]))),
        document.select(F.lit("comparative"), F.lit(""), F.inline(_entries("comparative", ["avg_unique_answers"]))),
        document.select(F.explode("categorical").alias("item", "value"))
        .select(F.lit("categorical"), "item", F.lit("count"), F.col("value").cast("double")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("section", "item", "metric", "value")


def _entries(column: str, names):
    return F.array(*[F.struct(F.lit(n).alias("metric"), F.col(column)[n].cast("double").alias("value")) for n in names])

"""Two models side by side: one row per input, winners, tiers, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.bands import EXPLICIT_TIERS, OVERLAP_TIER_NAMES, RISKY_TIERS, overlap_tier, overlap_verdict
from ..functions.keys import ROW_KEY, seeded_order, with_row
from ..functions.text import answers_differ
from ..session import written
from .ranking import extreme_inputs, extremes

SEED = 42


def _winner(left: Column, right: Column, a: str, b: str) -> Column:
    return F.when(left > right, a).when(right > left, b).otherwise("tie")


def wide_scores(df: DataFrame, models) -> DataFrame:
    """Numbers only, one row per input: ``_row, _id, <m>_score, overlap_<m>``.

    An input is told by ``_row`` (see ``row_of``); ``_id`` is passed through
    and may be missing or repeated. Fixed-width columns keep this a hash aggregate that combines the rows of
    one input before the shuffle.
    """
    picks = []
    for m in models:
        of_model = F.col("model") == m
        picks += [F.max(F.when(of_model, F.col("score"))).alias(f"{m}_score"),
                  F.max(F.when(of_model, F.col("overlap"))).alias(f"overlap_{m}")]
    return with_row(df.where(F.col("model").isin(list(models)))).groupBy("_row").agg(
        F.min("_id").alias("_id"), *picks, F.max("question_length").alias("question_length"), F.max("context_length").alias("context_length"))


def wide_compare(df: DataFrame, a: str, b: str, with_text: bool = False) -> DataFrame:
    """Long to wide for models ``a`` and ``b`` with differences and winners, one row per input.

    The texts of the input row are carried only on request; rows of one input
    lie together in a written table, so they combine before the shuffle.
    """
    return with_winners(_wide(df, a, b, with_text).drop("_row"), a, b)


def _wide(df: DataFrame, a: str, b: str, with_text: bool = False) -> DataFrame:
    names = [(c, m, f"{m}_{c}" if c != "overlap" else f"overlap_{m}") for m in (a, b) for c in ("answer", "score", "overlap")]
    picks = [F.max(F.when(F.col("model") == m, F.col(c))).alias(n) for c, m, n in names]
    texts = [F.max(c).alias(c) for c in ("question", "context")] if with_text else []
    sizes = [F.max("question_length").alias("question_length"), F.max("context_length").alias("context_length")]
    wide = with_row(df.where(F.col("model").isin(a, b))).groupBy("_row").agg(F.min("_id").alias("_id"), *picks, *texts, *sizes)
    return wide.select("_row", "_id", *[t for t in ("question", "context") if with_text], "question_length", "context_length",
                       *[n for _, _, n in names])


def with_winners(wide: DataFrame, a: str, b: str) -> DataFrame:
    """Differences (b minus a) and the winner by score and by overlap; missing means tie."""
    sa, sb, oa, ob = (F.col(c) for c in (f"{a}_score", f"{b}_score", f"overlap_{a}", f"overlap_{b}"))
    return wide.withColumns({
        "score_difference": sb - sa, "overlap_difference": ob - oa,
        "score_winner": _winner(sa, sb, a, b), "overlap_winner": _winner(oa, ob, a, b)})


def best_worst(df: DataFrame, models) -> DataFrame:
    """Per input the best and worst score, missing ones skipped, and the models holding them.

    On a tie the first model of the list holds it; without scores the last.
    """
    return _best_worst(df, models).drop("_row")


def _best_worst(df: DataFrame, models) -> DataFrame:
    wide = wide_scores(df, models)
    scores = [F.col(f"{m}_score") for m in models]
    best, worst = (F.greatest(*scores), F.least(*scores)) if len(scores) > 1 else (scores[0], scores[0])

    def holder(extreme: Column) -> Column:
        *first, last = models
        if not first:
            return F.lit(last)
        return reduce(lambda c, m: c.when(F.col(f"{m}_score") == extreme, m), first[1:],
                      F.when(F.col(f"{first[0]}_score") == extreme, first[0])).otherwise(last)

    return wide.select("_row", "_id", *scores, best.alias("best_score"), worst.alias("worst_score"),
                       holder(best).alias("best_score_model"), holder(worst).alias("worst_score_model"))


def global_extremes(df: DataFrame, models, largest: bool, count: int = 10) -> DataFrame:
    """Inputs with the best row-best score, or the worst row-worst score."""
    by = "best_score" if largest else "worst_score"
    return extremes(_best_worst(df, models), by, count, largest, ties=("_id", "_row")).drop("_row")


def extreme_model_counts(df: DataFrame, models, count: int = 10) -> DataFrame:
    """How often each model holds a place in the global best and worst lists."""
    parts = [
        global_extremes(df, models, largest, count)
        .groupBy(F.col(holder).alias("model")).agg(F.count(F.lit(1)).alias("count")).withColumn("list", F.lit(name))
        for largest, holder, name in ((True, "best_score_model", "top"), (False, "worst_score_model", "bottom"))]
    return parts[0].unionByName(parts[1]).select("list", "model", "count")


def wide_summary(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows, mean question length, mean score and overlap, wins and ties by score."""
    return with_winners(wide_scores(df, (a, b)), a, b).agg(*summary_columns(a, b))


def summary_columns(a: str, b: str) -> list[Column]:
    """The aggregates of ``wide_summary`` over a wide table with winners."""
    means = [F.avg(c).alias(f"mean_{c}") for c in (f"{a}_score", f"{b}_score", f"overlap_{a}", f"overlap_{b}")]
    wins = [F.count_if(F.col("score_winner") == w).alias(f"wins_{w}") for w in (a, b)]
    return [F.count(F.lit(1)).alias("total"), F.avg("question_length").alias("mean_question_length"),
            *means, *wins, F.count_if(F.col("score_winner") == "tie").alias("ties")]


def win_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Wins and ties by score and by overlap; zero counts are kept."""
    wide = with_winners(wide_scores(df, (a, b)), a, b)
    cells = [(c, w) for c in ("score", "overlap") for w in (a, b, "tie")]
    one = wide.agg(*[F.count_if(F.col(f"{c}_winner") == w).alias(f"{c}~{w}") for c, w in cells])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("criterion"), F.lit(w).alias("winner"), F.col(f"{c}~{w}").alias("count"))
        for c, w in cells])))


def tier_distribution(df: DataFrame, a: str, b: str) -> DataFrame:
    """Overlap tiers per model: count, percent, and b minus a in points; all six tiers."""
    tier = overlap_tier(F.col("overlap"))
    own = {m: F.col("model") == m for m in (a, b)}
    one = df.where(own[a] | own[b]).withColumn("_tier", tier).agg(
        *[F.count_if(own[m] & (F.col("_tier") == t)).alias(f"{m}~{t}") for m in (a, b) for t in OVERLAP_TIER_NAMES],
        *[F.count_if(own[m]).alias(f"{m}~n") for m in (a, b)])

    def percent(m, t):
        return F.try_divide(F.col(f"`{m}~{t}`") * 100.0, F.col(f"`{m}~n`"))

    return one.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("tier_rank"), F.lit(t).alias("tier"),
                 F.col(f"`{a}~{t}`").alias(f"{a}_count"), percent(a, t).alias(f"{a}_pct"),
                 F.col(f"`{b}~{t}`").alias(f"{b}_count"), percent(b, t).alias(f"{b}_pct"),
                 (percent(b, t) - percent(a, t)).alias("difference_pp"))
        for i, t in enumerate(OVERLAP_TIER_NAMES)])))


def risk_shares(df: DataFrame, a: str, b: str) -> DataFrame:
    """Hallucination-risk and explicit-answer shares per model and the safer model."""
    tier = overlap_tier(F.col("overlap"))
    shares = (df.where(F.col("model").isin(a, b)).withColumn("_tier", tier).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_tier").isin(*RISKY_TIERS)).alias("risky"),
        F.count_if(F.col("_tier").isin(*EXPLICIT_TIERS)).alias("explicit")))
    percent = shares.select("model", "n", "risky", (F.col("risky") * 100.0 / F.col("n")).alias("risky_pct"),
                            "explicit", (F.col("explicit") * 100.0 / F.col("n")).alias("explicit_pct"))
    both = Window.partitionBy()  # one row per model
    ra, rb = (F.max(F.when(F.col("model") == m, F.col("risky_pct"))).over(both) for m in (a, b))
    return percent.withColumns({"safer_model": F.when(ra > rb, b).otherwise(a),
                                "safer_by_pp": F.abs(ra - rb)})


def overlap_verdicts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean overlap in percent per model with its verdict, their mean and distance."""
    own = {m: F.avg(F.when(F.col("model") == m, F.col("overlap"))) * 100 for m in (a, b)}
    one = df.where(F.col("model").isin(a, b)).agg(own[a].alias("_a"), own[b].alias("_b"))
    return one.select(
        F.col("_a").alias(f"{a}_pct"), F.col("_b").alias(f"{b}_pct"),
        ((F.col("_a") + F.col("_b")) / 2).alias("mean_pct"), F.abs(F.col("_b") - F.col("_a")).alias("difference_pp"),
        overlap_verdict(F.col("_a")).alias(f"{a}_verdict"), overlap_verdict(F.col("_b")).alias(f"{b}_verdict"))


def study_rows(df: DataFrame, a: str, b: str) -> DataFrame:
    """The two models' answers and numbers with what tells an input row from others, written to the shared folder."""
    rows = with_row(df.where(F.col("model").isin(a, b)))
    return written(rows.select(F.col("_row").alias(ROW_KEY), "_id", "model", "answer", "score", "overlap",
                               "question_length", "context_length"), "view-rows")


def sample_differing(df: DataFrame, a: str, b: str, count: int = 5, seed: int = SEED,
                     with_text: bool = False) -> DataFrame:
    """Reproducible sample of inputs the two models answer differently.

    Inputs that are an extreme (ten best or worst) of either model are left
    out; fewer rows are returned if fewer differ. Nothing is returned if
    fewer than ``count`` inputs remain after the exclusion. A table with contexts is read once, as
    ``study_rows`` (runs a job).
    """
    narrow = study_rows(df, a, b) if "context" in df.columns else df
    # At most 40 inputs are excluded.
    rest = _wide(narrow, a, b).join(extreme_inputs(narrow, (a, b)).select("_row"), "_row", "left_anti")
    remaining = rest.select("_row").limit(count).agg(F.count(F.lit(1))).scalar()
    differing = rest.where(answers_differ(F.col(f"{a}_answer"), F.col(f"{b}_answer")) & (remaining >= count))
    picked = with_winners(differing.orderBy(seeded_order(seed, F.col("_id")), "_id", "_row").limit(count), a, b)
    if with_text:
        # Texts are read for the picked inputs alone.
        texts = with_row(df.where(F.col("model").isin(a, b))).select("_row", "question", "context")
        texts = texts.join(picked.select("_row"), "_row", "left_semi").groupBy("_row").agg(F.max("question").alias("question"), F.max("context").alias("context"))
        picked = picked.join(texts, "_row")
    return picked.drop("_row")


def sample_means(df: DataFrame, a: str, b: str, count: int = 5, seed: int = SEED) -> DataFrame:
    """Mean scores, overlaps and lengths over that sample."""
    picked = sample_differing(df, a, b, count, seed)
    names = (f"{a}_score", f"{b}_score", f"overlap_{a}", f"overlap_{b}", "question_length", "context_length")
    return picked.agg(F.count(F.lit(1)).alias("sampled"), *[F.avg(n).alias(f"mean_{n}") for n in names])


def sample_wins(df: DataFrame, a: str, b: str, count: int = 5, seed: int = SEED) -> DataFrame:
    """Winners by score and by overlap within that sample."""
    picked = sample_differing(df, a, b, count, seed)
    return (picked.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("criterion"), F.col(f"{c}_winner").alias("winner")) for c in ("score", "overlap")])))
        .groupBy("criterion", "winner").agg(F.count(F.lit(1)).alias("count")))

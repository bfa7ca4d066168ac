"""Describe, histograms, box and density summaries, trends, correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.bands import correlation_direction, correlation_strength
from ..functions.statistics import half_even, pearson
from ..session import written
from .quantiles import exact_quantiles, with_quantiles

QUARTILES = {"q25": 0.25, "q50": 0.50, "q75": 0.75}
CORRELATED = ("score", "overlap", "question_length", "context_length")


def score_describe(df: DataFrame, value: str = "score", digits: int = 4) -> DataFrame:
    """Per model: non-null count, mean, sample deviation, min, quartiles, max."""
    full = with_quantiles(df, "model", value, QUARTILES, F.count(value).alias("count"), F.avg(value).alias("mean"),
                          F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return full.select("model", "count", *[
        half_even(F.col(c), digits).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def bounds_of(df: DataFrame, value: str) -> Column:
    """Smallest and largest value as a scalar subquery with fields ``lo`` and ``hi``."""
    return df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("b")).scalar()


def _bin_of(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based equal-width bin; the last bin is closed; one value alone is bin 0."""
    place = F.coalesce(F.floor(F.try_divide(value - lo, hi - lo) * bins), F.lit(0))
    return F.least(place, F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in equal-width bins over the observed range, empty bins included.

    Two passes over one column; the shuffle carries at most one row per bin
    and task. An input without values gives no bins.
    """
    present = df.where(F.col(value).isNotNull()).select(value)
    span = bounds_of(present, value)
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    counts = (present.withColumn("_b", span).groupBy(_bin_of(F.col(value), lo, hi, bins).alias("bin"))
              .agg(F.count(F.lit(1)).alias("count"), F.sum(value).alias("_sum")))
    step = (hi - lo) / bins
    all_bins = Window.partitionBy()  # one row per bin
    grid = (df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), span.alias("_b"))
            .where(lo.isNotNull()))
    return (grid.join(counts, "bin", "left")
            .select("bin", (lo + F.col("bin") * step).alias("lower"), (lo + (F.col("bin") + 1) * step).alias("upper"),
                    F.coalesce("count", F.lit(0)).alias("count"),
                    (F.sum("_sum").over(all_bins) / F.sum("count").over(all_bins)).alias("mean_value")))


def density(df: DataFrame, value: str = "score", bins: int = 40) -> DataFrame:
    """Binned density per model over the shared range, empty bins included.

    The outline of a violin: ``density`` integrates to 1 over each model.
    """
    present = df.where(F.col(value).isNotNull() & F.col("model").isNotNull()).select("model", value)
    span = bounds_of(present, value)
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    counts = (present.withColumn("_b", span).groupBy("model", _bin_of(F.col(value), lo, hi, bins).alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    # At most `bins` entries per model are gathered.
    per_model = counts.groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("m"), F.sum("count").alias("n"))
    grid = (per_model.withColumn("_b", span)
            .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))))
    count = F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0))
    step = (hi - lo) / bins
    return grid.select("model", "bin", (lo + F.col("bin") * step).alias("lower"), count.alias("count"),
                       F.try_divide(count, F.col("n") * step).alias("density"))


def _with_fences(quartiles: DataFrame) -> DataFrame:
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    return quartiles.withColumns({"lower_fence": F.col("q25") - reach, "upper_fence": F.col("q75") + reach})


_BOX = ("q25", "q50", "q75", "lower_fence", "upper_fence")


def _box_columns(value: str, low: Column, high: Column, count: Column) -> list[Column]:
    """Aggregates over value counts: whiskers inside the fences, outliers, rows."""
    inside = F.col(value).between(low, high)
    return [F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(count)).alias("outliers"), F.sum(count).alias("n")]


def box_summary(df: DataFrame, value: str = "score", key: str = "model") -> DataFrame:
    """Quartiles, fences at 1.5 IQR, whiskers inside them and outliers per key.

    Three passes; the table is read once, the key and the value are written for them (runs a job).
    """
    present = written(df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, value), "box-values")
    fenced = _with_fences(exact_quantiles(present, key, value, QUARTILES))
    # Equal values are counted before they look up their fences; keys are model names, a short map.
    boxes = fenced.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.struct(*_BOX))))).scalar()
    counted = (present.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
               .withColumn("boxes", boxes).withColumn("box", F.try_element_at("boxes", F.col(key))))
    return (counted.groupBy(key)
            .agg(F.first("box").alias("box"), *_box_columns(value, F.col("box.lower_fence"), F.col("box.upper_fence"), F.col("c")))
            .select(key, "n", "box.*", "whisker_low", "whisker_high", "outliers"))


def box_overall(df: DataFrame, value: str) -> DataFrame:
    """The box beside a histogram: one summary over all rows. As in ``box_summary`` the values are written once."""
    present = written(df.where(F.col(value).isNotNull()).select(value), "box-values").withColumn("group", F.lit("all"))
    fenced = _with_fences(exact_quantiles(present, "group", value, QUARTILES))
    counted = (present.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
               .withColumn("box", fenced.select(F.struct(*_BOX)).scalar()))
    summary = counted.agg(F.max("box").alias("box"), *_box_columns(
        value, F.col("box.lower_fence"), F.col("box.upper_fence"), F.col("c")))
    return (summary.where(F.col("n").isNotNull())
            .select(F.lit("all").alias("group"), "n", "box.*", "whisker_low", "whisker_high", "outliers"))


def trend(df: DataFrame, x: str, y: str = "score") -> DataFrame:
    """Least-squares line per model, and one overall if there is no model column.

    ``correlation`` is over all rows, as it is printed beside every line. It
    is put together from the sums of the models, so the rows are read once.
    """
    sums = [F.regr_count(y, x).alias("points"), F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
            F.regr_avgx(y, x).alias("ax"), F.regr_avgy(y, x).alias("ay"),
            F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")]
    grouped = df.groupBy("model") if "model" in df.columns else df.groupBy()
    every = Window.partitionBy()  # one row per model

    def over_all(c: Column) -> Column:
        return F.sum(c).over(every)

    n = F.col("points")
    dx = F.col("ax") - F.try_divide(over_all(n * F.col("ax")), over_all(n))
    dy = F.col("ay") - F.try_divide(over_all(n * F.col("ay")), over_all(n))
    lines = grouped.agg(*sums).withColumns({"dx": dx, "dy": dy})
    dx, dy = F.col("dx"), F.col("dy")
    sxx, syy, sxy = (over_all(F.col(s) + n * d) for s, d in (("sxx", dx * dx), ("syy", dy * dy), ("sxy", dx * dy)))
    lines = lines.withColumn("correlation", F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy))).drop(
        "ax", "ay", "sxx", "syy", "sxy", "dx", "dy")
    return lines.where(F.col("model").isNotNull()) if "model" in df.columns else lines


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(pearson(F.col(x), F.col(y)).alias("r"))


def correlation_matrix(df: DataFrame, columns=CORRELATED) -> DataFrame:
    """All pairs of the columns present, both orders and the diagonal, in one pass.

    A column that is constant or empty correlates with nothing, itself
    included (null). Raises ``ValueError`` for fewer than two columns.
    """
    used = [c for c in columns if c in df.columns]
    if len(used) < 2:
        raise ValueError("a correlation matrix needs at least two numeric columns")
    pairs = [*combinations(used, 2), *[(c, c) for c in used]]
    # Every pair is an aggregate of its own, the diagonal too: a single pass.
    one = df.agg(*[pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}~{b}") for a, b in pairs])
    cells = [(a, b, f"{a}~{b}") for a, b in pairs] + [(b, a, f"{a}~{b}") for a, b in pairs if a != b]
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"`{c}`").alias("r")) for a, b, c in cells])))


def correlation_pairs(df: DataFrame, columns=CORRELATED, top: int = 6) -> DataFrame:
    """Distinct pairs by strength, labelled; undefined correlations come last."""
    used = [c for c in columns if c in df.columns]
    place = F.create_map(*[F.lit(x) for i, c in enumerate(used) for x in (c, i)])
    upper = correlation_matrix(df, columns).where(place[F.col("var1")] < place[F.col("var2")])
    return (upper.withColumns({"strength": correlation_strength(F.col("r")),
                               "direction": correlation_direction(F.col("r"))})
            .orderBy(F.abs("r").desc_nulls_last(), place[F.col("var1")], place[F.col("var2")]).limit(top))

"""Exact quantiles of groups that are too large for one task.

The built-in exact ``percentile`` holds every distinct value of a group in
one task. Here a mergeable sketch per group, taken in the same pass as other
aggregates, brackets the wanted ranks; a second pass counts what lies below the
brackets and the values inside them, about one in a hundred, and selects the exact values.

``order_statistics`` does without sketches: equal values are counted, the
counts are spread over buckets, and only the bucket that holds a wanted rank is looked into.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F

_BITS = 20  # a bucket number has 20 bits per level


def order_statistics(df: DataFrame, key: str, value: str, probs) -> DataFrame:
    """Per key and probability the two neighbouring values: ``key, p, low, high, part``.

    The range between the overall minimum and maximum is cut into a million
    buckets, and each of them into a million again, on a logarithmic scale on
    both sides of zero, so a far outlier does not crowd the other values into
    one bucket. A bucket's number never falls as the value grows, so cumulative
    counts over buckets are exact ranks whatever the distribution. One task
    sees a million counts per key, then the distinct values of one of 2^40
    buckets. All branches read the same shuffled value counts, which Spark
    computes once. The wanted buckets, a few per key, are looked up in a scalar
    map, so no branch is joined by key; keys are model names, not data.
    """
    counts = (df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
              .groupBy(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
              .agg(F.count(F.lit(1)).alias("c")))
    # Both functions are monotone, so the order of the values is kept.
    counts = counts.withColumn("t", F.signum("v") * F.log1p(F.abs("v") * 1e15))
    span = counts.agg(F.struct(F.min("t").alias("lo"), F.max("t").alias("hi")).alias("s")).scalar()
    # One column holds the scalar, so that its plan is optimised once per branch.
    spanned = counts.withColumn("s", span)
    place = F.try_divide(F.col("t") - F.col("s.lo"), F.col("s.hi") - F.col("s.lo"))
    fine = F.coalesce(F.floor(place * float(1 << 2 * _BITS)), F.lit(0))
    spread = spanned.select("k", "v", "c", fine.alias("fine")).select(
        "k", "v", "c", F.shiftright("fine", _BITS).alias("b1"),
        F.col("fine").bitwiseAND(F.lit((1 << _BITS) - 1)).alias("b2"))

    of_key = Window.partitionBy("k")
    coarse = spread.groupBy("k", "b1").agg(F.sum("c").alias("c"))
    ranked = coarse.select("k", "b1", "c", F.sum("c").over(of_key).alias("n"),
                           F.sum("c").over(of_key.orderBy("b1")).alias("end"))
    position = (F.col("n") - 1) * F.col("p")
    wanted = (
        ranked.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position)))))
        .where((F.col("rank") >= F.col("end") - F.col("c")) & (F.col("rank") < F.col("end")))
        .select("k", "p", "rank", (position - F.floor(position)).alias("part"), "b1",
                (F.col("end") - F.col("c")).alias("below"))
    )
    target = ["k", "p", "rank", "part"]
    for path, level in ((["b1"], "b2"), (["b1", "b2"], "v")):
        # Only the few buckets that hold a wanted rank pass this lookup.
        sought = wanted.groupBy("k").agg(F.collect_list(F.struct("p", "rank", "part", "below", *path)).alias("w"))
        by_key = sought.agg(F.map_from_entries(F.collect_list(F.struct("k", "w")))).scalar()

        found = spread.withColumn("m", by_key).withColumn("w", F.explode(F.filter(F.try_element_at("m", F.col("k")), _same(path))))
        inside = (found.select("k", "w.p", "w.rank", "w.part", "w.below", *path, level, "c")
                  .groupBy(*target, *path, "below", level).agg(F.sum("c").alias("c")))
        upto = F.sum("c").over(Window.partitionBy(*target).orderBy(level)) + F.col("below")
        wanted = (inside.withColumn("end", upto)
                  .where((F.col("rank") >= F.col("end") - F.col("c")) & (F.col("rank") < F.col("end")))
                  .select(*target, *path, level, (F.col("end") - F.col("c")).alias("below")))
    return (wanted.groupBy(F.col("k").alias(key), "p", "part")
            .agg(F.min("v").alias("low"), F.max("v").alias("high")))


def _same(columns):
    """Whether a wanted bucket is the row's own."""
    def test(wanted):
        return reduce(and_, [wanted[c] == F.col(c) for c in columns])

    return test


SKETCH_K = 4096
#: Half the width of a bracket, as a share of the rows. A sketch of this size errs by less than 0.0013 in 99 of 100 cases.
MARGIN = 0.006
#: Groups up to this size are bracketed as a whole, so that rounding of ranks does not matter.
WHOLE = 2000


def present(value: str) -> Column:
    """The value as a double; NaN counts as missing."""
    number = F.col(value).cast("double")
    return F.when(~F.isnan(number), number)


def summary_of(value: str) -> Column:
    """Aggregate: sketch, count and range of a column, from which ``brackets`` are made."""
    v = present(value)
    return F.struct(F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias("sketch"), F.count(v).alias("n"),
                    F.min(v).alias("lo"), F.max(v).alias("hi"))


def merged_summaries(summary: str) -> Column:
    """Aggregate: the summary of several groups from their summaries."""
    part = lambda f: F.col(summary)[f]
    return F.struct(F.kll_merge_agg_double(part("sketch")).alias("sketch"), F.sum(part("n")).alias("n"),
                    F.min(part("lo")).alias("lo"), F.max(part("hi")).alias("hi"))


def brackets(summary: Column, probs) -> Column:
    """Per probability the two wanted ranks and a range of values that holds them."""
    n, lo, hi = (summary[c] for c in ("n", "lo", "hi"))

    def bound(rank: float, otherwise: Column) -> Column:
        if not 0 < rank < 1:
            return otherwise
        return F.when(n <= WHOLE, otherwise).otherwise(F.kll_sketch_get_quantile_double(summary["sketch"], F.lit(rank)))

    def one(p: float) -> Column:
        at = (n - 1) * F.lit(p)
        return F.struct(F.floor(at).alias("first"), F.ceil(at).alias("last"), (at - F.floor(at)).alias("part"),
                        bound(p - MARGIN, lo).alias("low"), bound(p + MARGIN, hi).alias("high"))

    return F.array(*[one(float(p)) for p in probs])


def select_ranks(df: DataFrame, key: str, value: str, by_key: Column, probs: dict[str, float], weight: str | None = None) -> DataFrame:
    """One row per key with a column per named probability, linearly interpolated.

    With ``weight`` a row counts that many times. ``by_key`` is a scalar map from key to its brackets (in the order of the sorted distinct
    probabilities); keys are model names, not data. Values outside all brackets are only counted, per gap
    between brackets, before anything is shuffled. A rank that its bracket misses, over
    ten deviations off, raises an error and is never answered by a neighbour.
    """
    order = sorted(set(probs.values()))
    rows = df.select(F.col(key).alias("k"), present(value).alias("v"), (F.col(weight) if weight else F.lit(1)).alias("w")).where("k is not null and v is not null")
    rows = rows.withColumn("b", F.try_element_at(by_key, F.col("k")))
    ends = [(F.col("b")[i]["low"], F.col("b")[i]["high"]) for i in range(len(order))]
    inside = reduce(or_, [F.col("v").between(low, high) for low, high in ends])
    # A value outside stands at the last bracket below it, after that bracket's own values.
    below = F.array_max(F.array(*[F.when(high < F.col("v"), high) for _, high in ends]))
    counts = (rows.select("k", F.when(inside, F.col("v")).otherwise(below).alias("v"), inside.alias("inside"), "w")
              .groupBy("k", "v", "inside").agg(F.sum("w").alias("c")))
    upto = F.sum("c").over(Window.partitionBy("k").orderBy(F.asc_nulls_first("v"), F.desc("inside"))
                           .rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("end", upto).withColumn("b", F.try_element_at(by_key, F.col("k")))
    sure = F.when(F.col("inside"), F.col("v")).otherwise(
        F.raise_error("a rank lies outside the bracket of its sketch; use order_statistics").cast("double"))
    found = []
    for name, p in probs.items():
        b = F.col("b")[order.index(p)]
        holds = lambda rank: (b[rank] >= F.col("end") - F.col("c")) & (b[rank] < F.col("end"))  # noqa: E731, B023
        low, high = (F.max(F.when(holds(r), sure)) for r in ("first", "last"))
        found.append((low + (high - low) * F.max(b["part"])).alias(name))
    return ranked.groupBy(F.col("k").alias(key)).agg(*found)


def with_quantiles(df: DataFrame, key: str, value: str, probs: dict[str, float], *aggregates: Column) -> DataFrame:
    """The aggregates per key, null keys left out, with the quantiles of a value beside them.

    Two passes over the rows: the aggregates and a sketch, then the brackets. The results of the first, one row per
    key, are one scalar, so that both uses of it are one computation.
    """
    first = (df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k"))
             .agg(F.struct(F.lit(1).alias("_one"), *aggregates).alias("a"), summary_of(value).alias("s")))
    every = df.sparkSession.range(1).select(first.agg(F.collect_list(F.struct("k", "a", "s"))).scalar().alias("e"))
    by_key = F.map_from_entries(F.transform(F.filter("e", lambda r: r["s"]["n"] > 0),
                                            lambda r: F.struct(r["k"], brackets(r["s"], sorted(set(probs.values()))))))
    found = select_ranks(df, key, value, every.select(by_key).scalar(), probs)
    as_map = F.map_from_entries(F.collect_list(F.struct(F.col(key), F.struct(*probs))))
    base = every.select(F.inline("e")).withColumn("q", F.try_element_at(found.agg(as_map).scalar(), F.col("k")))
    if aggregates:
        return base.select(F.col("k").alias(key), "a.*", "q.*").drop("_one")
    return base.where("s.n > 0").select(F.col("k").alias(key), "q.*")


def exact_quantiles(df: DataFrame, key: str, value: str, probs: dict[str, float]) -> DataFrame:
    """One row per key that has values, with a column per named probability, linearly interpolated."""
    return with_quantiles(df, key, value, probs)

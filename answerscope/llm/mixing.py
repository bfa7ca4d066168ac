"""Sources mixed to target weights by Poisson replication, then shuffled globally."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .native import apart, stored, unit_draw

PART = 16.0  # largest mean that is inverted at once; a larger one is a sum of equal parts


def rates(docs: DataFrame, weights: Mapping[str, float] | DataFrame | float = 0.5, epochs: float = 1.0,
          source: str = "source", text: str = "text") -> DataFrame:
    """Mean repetitions per source: ``source, size, weight, rate``.

    ``size`` is the number of characters. ``weights`` is a mapping, a table
    ``(source, weight)``, or a power of the size (0.5: a source four times as
    large gets twice the weight). A source gets the share of its weight of
    ``epochs`` times all characters; one without a weight or without
    characters has rate 0. A null source is a source like any other.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("size"))
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    elif isinstance(weights, Mapping):
        weight = F.lit(None).cast("double")
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(value)).otherwise(weight)
        sizes = sizes.withColumn("weight", weight)
    else:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), float(weights)))
    sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    totals = sizes.agg(F.struct(F.sum("size").alias("size"), F.sum("weight").alias("weight"))).scalar()
    share = F.try_divide("weight", F.col("_all.weight"))
    rate = F.try_divide(share * F.lit(float(epochs)) * F.col("_all.size"), F.col("size"))
    return sizes.withColumn("_all", totals).select("source", "size", "weight", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def cumulative(rate: Column) -> Column:
    """Poisson probabilities of at most 0, 1, 2 ... for a mean of up to ``PART``; the rest is below 2^-52."""
    steps = F.sequence(F.lit(1), F.lit(96))
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))

    def step(state, k):
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + p)).alias("sums"))

    return F.aggregate(steps, start, step)["sums"]


def poisson(sums: Column, parts: Column, *seed: Column) -> Column:
    """Invert the distribution at one hash-seeded draw per part and add up."""
    def one(part):
        draw = unit_draw(*seed, part.cast("string"))
        return F.aggregate(sums, F.lit(0), lambda n, s: n + (s <= draw).cast("int"))

    return F.aggregate(F.transform(F.sequence(F.lit(1), parts), one), F.lit(0), lambda a, b: a + b)


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | DataFrame | float = 0.5, epochs: float = 1.0,
                seed: int = 0, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Repeat each document a Poisson number of times with its source's mean, in a global shuffle.

    The number comes from the MD5 of seed, key and text's MD5, so it does not
    depend on partitions or on other documents, and different texts under one
    key are drawn and shuffled apart; a null key or text counts as empty. Only
    rows that share key, text and source get the same number. Returns the input's
    columns and ``copy`` (1, 2 ...) and ``shuffle_key``, in the order of the key within
    each partition, and partitions by its hash; input columns of these names
    are replaced. Rows of a source with rate 0 do not appear. An empty table
    gives an empty result. Runs one job for the sizes; the table of rates is
    written, so the planner knows its size and broadcasts it only if small.
    """
    table = rates(docs, weights, epochs, source, text).where("rate > 0")
    parts = F.ceil(F.col("rate") / PART).cast("int")
    table = stored(table.select(F.col("source").alias("_source"), parts.alias("_parts"),
                                cumulative(F.col("rate") / parts).alias("_sums")), "rates")
    made = ("copy", "shuffle_key")
    out = apart(docs, [key, text, source], made, lambda d: _repeated(d, table, seed, source, text, key))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def _identity(key: str, text: str) -> Column:
    parts = F.col(key).cast("string"), F.md5(F.col(text).cast("binary"))
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in parts])


def _repeated(docs: DataFrame, table: DataFrame, seed: int, source: str, text: str, key: str) -> DataFrame:
    own = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rows = docs.select(*own).withColumn("_draw", _identity(key, text))
    joined = rows.join(table, F.col(source).eqNullSafe(F.col("_source")))
    count = poisson(F.col("_sums"), F.col("_parts"), F.lit(str(seed)), F.col("_draw"))
    copies = joined.withColumn("_n", count).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    order = F.md5(F.concat_ws("|", F.lit(f"order{seed}"), "_draw", F.col("copy").cast("string")).cast("binary"))
    return copies.select(*own, F.col("copy").cast("bigint").alias("copy"), order.alias("shuffle_key"))

"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .native import stored

SALTS = 8


def _stars(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Each ``(u, v)`` of ``pairs`` with the least neighbour of ``u`` in ``edges``, ``u`` itself included.

    A vertex with very many neighbours is split over salts; its minimum is one row.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(
        "u", "m", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    return (pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
            .join(least, ["u", "salt"]).drop("salt"))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``id, component`` for every id of the edges ``a, b``; the component is its least id.

    Each round writes its edges to the shared folder, so lineage stays short
    and a lost executor costs one round. The number of rounds grows with the
    logarithm of the longest chain.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Now u > v in every edge: link the smaller neighbours of u, and u, to the least.
        small = _stars(large, large)
        edges = stored(small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                       .select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = edges.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops)

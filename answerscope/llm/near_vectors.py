"""Near copies of embeddings by a pivot-permutation index.

1. Rows with one label and one vector become a class with a count.
2. Reference points (pivots) come from a bounded sample. Every class is described by its
   ``NEAREST`` nearest pivots in order, and stands on the inverted list of each.
3. Classes of one label that meet on lists and share at least ``SHARED`` pivots are
   candidates; a pair is looked at only on the list of the first pivot it
   shares, and verified by the cosine in double precision.
4. Links are counted with the copies of both sides, and components follow from
   one edge per class and group of compared rows.

Long lists are cut into blocks, and a group of compared rows is two blocks. The sample also shows
where very many vectors crowd together. A crowd has a centre; two vectors within half
the linking angle of one centre are linked for certain, so a crowd of any size is counted by one aggregate and
never compared with itself, and crowds whose centres are too far apart for any
link never meet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..session import ship_package
from .components import components
from .native import stored
from .vectors import common_length, join_back, packed, unpacked, valid_rows

NEAREST = 8
SHARED = 2
PIVOTS = 8192  # at most; twice the square root of the number of classes, if that is less
SAMPLE = 8192
SAMPLE_BYTES = 32 << 20
CROWDS = 256
CROWD_SHARE = 0.002  # of the sample, and at least CROWD_LEAST rows of it
CROWD_LEAST = 8
BLOCK = 1024
SLACK = 1e-6  # radians, far above the rounding of angles
FOUND = "id bigint, links bigint, root bigint"


def _valid(batches, dim: int, dtype):
    for b in batches:
        places, values = valid_rows(b.column("vector"), dim)
        places, values = (a[(values != 0).any(axis=1)] for a in (places, values))
        x = np.full(b.num_rows, -1, np.int64)
        x[places] = np.arange(len(places))
        packed_rows = packed(values.astype(dtype)).take(pa.array(x, mask=x < 0))
        yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("key"), b.column("label"), packed_rows], ["uid", "key", "label", "x"])


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, initial=1e-300)[:, None]  # squares then neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def fit_pivots(sample: np.ndarray, count: int, apart: float = 0.9) -> np.ndarray:
    """Up to ``count`` sampled directions, no two of them with a cosine over ``apart``."""
    chosen = np.zeros((min(count, len(sample)), sample.shape[1]))
    n = 0
    for v in sample:
        if n == len(chosen):
            break
        if not n or (chosen[:n] @ v).max() <= apart:
            chosen[n] = v
            n += 1
    return chosen[:n]


def fit_centres(sample: np.ndarray, threshold: float) -> np.ndarray:
    """Mean directions of the places where a good share of the sample lies within the linking angle."""
    near = np.zeros(len(sample), np.int64)
    for a in range(0, len(sample), 1024):
        near[a:a + 1024] = (sample[a:a + 1024] @ sample.T >= threshold).sum(axis=1)
    least = max(CROWD_LEAST, CROWD_SHARE * len(sample))
    free, centres = np.ones(len(sample), bool), []
    for i in np.argsort(-near, kind="stable"):
        if near[i] < least or len(centres) == CROWDS:
            break
        if free[i]:
            members = (sample @ sample[i] >= threshold) & free
            centre = sample[members].sum(axis=0)
            centres.append(centre / np.linalg.norm(centre))
            free &= ~members
    return np.array(centres).reshape(len(centres), sample.shape[1])


def _indexed(batches, dim: int, dtype, pivots: np.ndarray, nearest: int, centres: np.ndarray, angle: float):
    """Each class with its nearest pivots in order, its crowd (-1: none) and the crowds that could hold links to that crowd."""
    apart = np.arccos(np.clip(centres @ centres.T, -1, 1))
    close = [np.flatnonzero((row <= 2 * angle + SLACK) & (np.arange(len(row)) != i)).tolist() for i, row in enumerate(apart)]
    for b in batches:
        u = unit(unpacked(b.column("x"), dim, dtype))
        order = np.argsort(-(u @ pivots.T), axis=1, kind="stable")[:, :nearest]
        crowd = np.full(len(u), -1, np.int32)
        if len(centres) and len(u):
            a = np.arccos(np.clip(u @ centres.T, -1, 1))
            first = a.argmin(axis=1)
            crowd = np.where(a[np.arange(len(u)), first] <= angle / 2 - SLACK, first, -1).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * order.shape[1], pa.int32()), pa.array(order.ravel().astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("id", "label", "copies", "x")), lists, pa.array(crowd), pa.array([close[c] if c >= 0 else [] for c in crowd], pa.list_(pa.int32()))],
            ["id", "label", "copies", "x", "pivots", "crowd", "close"])


def linked_pairs(u: np.ndarray, pivots: np.ndarray, other_u: np.ndarray, other_pivots: np.ndarray, p: int, shared: int, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, share enough pivots and have ``p`` as the first of them."""
    values = np.intersect1d(pivots, other_pivots)  # no other pivot is shared

    def bits(rows):
        place = np.minimum(np.searchsorted(values, rows), len(values) - 1)
        row, column = np.nonzero(values[place] == rows)
        out = np.zeros((len(rows), len(values)), np.float32)
        out[row, place[row, column]] = 1
        return out

    a, b = bits(pivots), bits(other_pivots)
    first = int(np.searchsorted(values, p))
    return (a @ b.T >= shared) & (a[:, :first] @ b[:, :first].T == 0) & (u @ other_u.T >= threshold)


def _compared(table: pa.Table, dim: int, dtype, shared: int, threshold: float) -> pa.Table:
    """Links between two blocks of a list, or inside one: per class their number, and one class of its group."""
    first = np.asarray(table.column("first"))
    same = bool(table.column("same")[0].as_py())
    ids, copies = np.asarray(table.column("id")), np.asarray(table.column("copies"))
    u = unit(unpacked(table.column("x"), dim, dtype))
    pivots = np.array(table.column("pivots").combine_chunks().flatten()).reshape(len(u), -1)
    left = np.arange(len(u)) if same else np.flatnonzero(first)
    right = left if same else np.flatnonzero(~first)
    links, root = np.zeros(len(u), np.int64), np.arange(len(u))
    if len(left) and len(right):
        found = linked_pairs(u[left], pivots[left], u[right], pivots[right], table.column("p")[0].as_py(), shared, threshold)
        if same:
            np.fill_diagonal(found, False)
        links[left] += found @ copies[right]
        if not same:
            links[right] += found.T @ copies[left]
        while found.any():
            least = root.copy()
            root[left] = np.minimum(root[left], np.where(found, root[right][None, :], len(u)).min(axis=1))
            root[right] = np.minimum(root[right], np.where(found, root[left][:, None], len(u)).min(axis=0))
            if (root == least).all():
                break
    some = np.flatnonzero(links)
    return pa.table({"id": ids[some], "links": links[some], "root": ids[root[some]]})


def _lists(indexed: DataFrame, dim: int, dtype, shared: int, threshold: float) -> DataFrame:
    """Links found on the inverted lists."""
    posted = indexed.select("label", F.explode("pivots").alias("p"), "id", "copies", "x", "pivots", "crowd", "close")
    sizes = posted.groupBy("label", "p", "crowd").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("label", "p").agg(
        F.collect_list(F.struct("crowd", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))).alias("parts"), F.sum("n").alias("n"))
    sizes = stored(sizes.where("n > 1"), "list-sizes")
    met = join_back(posted, sizes, ["label", "p"], "n", CROWDS * 8 + 64)
    number = F.pmod(F.xxhash64("id"), F.filter("parts", lambda q: q["crowd"] == F.col("crowd"))[0]["blocks"]).cast("int")
    may = lambda q: (F.col("crowd") < 0) | (q["crowd"] < 0) | F.array_contains("close", q["crowd"])
    blocks = F.flatten(F.transform(F.filter("parts", may), lambda q: F.transform(
        F.sequence(F.lit(0), q["blocks"] - 1), lambda y: F.struct(q["crowd"].alias("crowd"), y.alias("block")))))
    met = met.withColumn("own", F.struct("crowd", number.alias("block"))).withColumn("other", F.explode(blocks))
    pairs = met.select("label", "p", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                       (F.col("own") <= F.col("other")).alias("first"), (F.col("own") == F.col("other")).alias("same"), "id", "copies", "x", "pivots")
    # A block meets the others once from each side; inside a group `same` holds for all rows or for none.
    return pairs.groupBy("label", "p", "a", "b").applyInArrow(lambda t: _compared(t, dim, dtype, shared, threshold), FOUND)


def near_vectors(df: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 nearest: int = NEAREST, shared: int = SHARED, pivots: int | None = None) -> DataFrame:
    """``key, n_links, component_id, kept``: one row per row of the input.

    Rows of one label whose vectors have a cosine of ``threshold`` (over 0) or more are
    linked. ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest key that links reach, the own one included, and ``kept`` says that it is the own one.
    All links are verified, so none is below the threshold. A link is missed only if its two vectors share fewer than ``shared``
    of their ``nearest`` pivots; equal vectors and vectors of one crowd are always linked.

    The key is an integer. Rows with a null key, label or vector, a zero vector, null, NaN or infinite entries, or
    another length than most vectors are linked with nothing; a row without a key has no component and is kept. Rows that
    share a key are rows of their own. Other columns are not looked at. An empty table gives an empty result.

    Pivots and crowds are fitted to at most ``SAMPLE`` classes (fewer if they
    exceed ``SAMPLE_BYTES``); every row is indexed. ``pivots`` is their number, by default twice the square root of the
    number of classes up to ``PIVOTS``.
    """
    spark = df.sparkSession
    ship_package(spark)
    dim = common_length(df, vector)
    single = df.schema[vector].dataType == ArrayType(FloatType(), df.schema[vector].dataType.containsNull)
    dtype = np.float32 if single else np.float64
    given = df.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("bigint").alias("key"), F.col(label).cast("string").alias("label"),
                      F.col(vector).cast("array<double>").alias("vector"))
    # Numbered once: the table is written before the numbers are used.
    rows = stored(given.mapInArrow(lambda it: _valid(it, dim, dtype), "uid bigint, key bigint, label string, x binary"), "vectors")
    able = F.col("key").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()
    valid = rows.where(able)
    classes = stored(valid.groupBy("label", "x").agg(F.min("uid").alias("id"), F.min("key").alias("least"), F.count(F.lit(1)).alias("copies")), "vector-classes")

    total = classes.count()
    size = max(1, min(SAMPLE, SAMPLE_BYTES // max(1, 8 * dim)))
    sample = classes.orderBy(F.xxhash64("id")).limit(size).select("x").toArrow()
    sample = unit(unpacked(sample.column("x"), dim, dtype))
    points = fit_pivots(sample, min(PIVOTS, pivots or max(16, 2 * math.isqrt(total))))
    centres, angle = fit_centres(sample, threshold), math.acos(min(1.0, threshold))
    each = max(1, min(nearest, len(points)))
    indexed = stored(classes.select("id", "label", "copies", "x").mapInArrow(
        lambda it: _indexed(it, dim, dtype, points, each, centres, angle),
        "id bigint, label string, copies bigint, x binary, pivots array<int>, crowd int, close array<int>"), "vector-index")

    found = _lists(indexed, dim, dtype, min(shared, each), threshold)
    inside = indexed.where("crowd >= 0").select("label", "crowd", "id", "copies")
    crowds = inside.groupBy("label", "crowd").agg(F.sum("copies").alias("rows"), F.min("id").alias("root"), F.count(F.lit(1)).alias("n"))
    crowded = join_back(inside, stored(crowds, "crowds"), ["label", "crowd"], "n", 64)
    found = stored(found.unionByName(crowded.select("id", (F.col("rows") - F.col("copies")).alias("links"), "root")), "vector-links")

    parts = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = (classes.join(parts, "id", "left").join(counts, "id", "left")
             .select("label", "x", "copies", "least", F.coalesce("component", "id").alias("component"),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = stored(named, "vector-components")
    tops = stored(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    done = stored(join_back(named, tops, ["component"], "n", 32).select("label", "x", "copies", "n_links", "component_id"), "vector-results")
    out = join_back(valid.select("key", "label", "x"), done, ["label", "x"], "copies", dim * 8 + 64).select("key", "n_links", "component_id")
    # The condition is never null, so its negation takes exactly the other rows.
    alone = rows.where(~able).select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"))
    return out.unionByName(alone).select(F.col("key").alias(key), "n_links", "component_id",
                                         F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))

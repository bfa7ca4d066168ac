"""Hard negatives for anchors by shared candidate lists per anchor cluster.

1. Anchors are clustered by angle; centroids come from a bounded sample. A
   cluster of more than ``MEMBERS`` anchors is several blocks under one centroid.
2. A candidate at angle t from a centroid whose members lie within angle r of it has an inner
   product of at most |member| |candidate| cos(max(0, t - r)) with each of
   them. Every cluster has one list of candidates, sorted by this bound; Spark
   cuts it into segments and sorts it. Candidates whose bound no member can use are never listed.
3. All members of a block walk a segment together, a piece of it a time, and keep their best
   rows. A member leaves when the bound falls below what it holds already or
   may use at all; the rest of the list is certified to be useless to it.
4. The segments' best rows are merged per anchor.

The first walk looks for positives, the second for negatives inside the score bands
that the positives set. What a member can use starts from its fellow members.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ship_package
from .exchange import partitions_of
from .native import stored
from .vectors import LARGEST, common_length, packed, unpacked, valid_rows, whole_numbers

MEMBERS = 4096
CLUSTERS = 1024
CLUSTER_SIZE = 512
SEGMENT = 1 << 16
PIECE = 2048
SLACK = 1e-6  # of the bounds, far above the rounding of angles
NONE = -(1 << 63)
ROW = "uid bigint, key bigint, label string, anchor boolean, x binary"
MEMBER = "block int, part int, uid bigint, key bigint, label string, x binary, rank array<bigint>, score array<bigint>, low array<double>"
LIST = "block int, part int, segment int, bound double, uid bigint, key bigint, label string, x binary, rank array<bigint>, score array<bigint>, low array<double>"
FOUND = "anchor bigint, anchor_key bigint, slot int, positive bigint, positive_score bigint, uid bigint, key bigint, score bigint"


def _valid(batches, dim: int, scale: int):
    for b in batches:
        places, values = valid_rows(b.column("vector"), dim)
        rows = b.take(pa.array(places))
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("uid", "key", "label", "anchor")), packed(whole_numbers(values, scale))],
                                         ["uid", "key", "label", "anchor", "x"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; those beyond 64 bits are cut to the nearest."""
    norm = lambda m: math.sqrt(float((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    if norm(a) * norm(b) < 2.0 ** 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T
    return np.clip(whole, -2 * LARGEST + 1, 2 * LARGEST - 1).astype(np.int64)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; a zero vector stays zero."""
    x = x.astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    return x / np.maximum(norms, 1e-300)[:, None], norms


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over the distinct directions of a sample."""
    unit = np.unique(directions(sample)[0], axis=0)
    rng = np.random.default_rng(12)
    centres = unit[rng.permutation(len(unit))[:k]]
    for _ in range(rounds):
        near = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        moved, norms = directions(sums)
        centres = np.where(norms[:, None] > 1e-12, moved, centres)
    return centres


def angles(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angle of every row to every centre, and the rows' lengths."""
    unit, norms = directions(x)
    return np.arccos(np.clip(unit @ centres.T, -1, 1)), norms


class Best:
    """For members and their slots the ``k`` best rows so far: by score, then key, then row."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        # A slot takes scores in [low, high]; a slot without a use is an empty interval.
        self.low, self.high, self.k = low, high, k
        self.rows = np.zeros((0, 4), np.int64)  # member * slots + slot, score, key, row
        self.least = np.where(low <= high, low, np.inf)

    def add(self, active: np.ndarray, scores: np.ndarray, usable: np.ndarray, keys: np.ndarray, uids: np.ndarray) -> None:
        """Scores of the active members (rows) with candidates (columns)."""
        found = [self.rows]
        for slot in range(self.low.shape[1]):
            least, high = self.least[active, slot][:, None], self.high[active, slot][:, None]
            who, which = np.nonzero(usable & (scores >= least) & (scores <= high))
            found.append(np.column_stack((active[who] * self.low.shape[1] + slot, scores[who, which], keys[which], uids[which])))
        rows = np.concatenate(found)
        if len(rows) == len(self.rows):
            return
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        self.rows = rows[place < self.k]
        last = rows[place == self.k - 1]
        self.least.ravel()[last[:, 0]] = np.maximum(self.least.ravel()[last[:, 0]], last[:, 1])


def _limits(scores, k: int, low: np.ndarray, high: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """The lower limit of each slot after a look at some candidates: the ``k``-th best of them, or ``low``."""
    out = low.copy()
    for slot in range(low.shape[1]):
        inside = usable & (scores >= low[:, [slot]]) & (scores <= high[:, [slot]])
        if scores.shape[1] >= k:
            best = np.sort(np.where(inside, scores.astype(np.float64), -np.inf), axis=1)[:, -k]
            out[:, slot] = np.maximum(out[:, slot], best)
    return out


def _bands(table, low_percent: int | None, high_percent: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``low, high`` of each member and slot, and the positives' keys and scores; one open slot if there are no positives yet."""
    ranks, scores = (table.column(c).to_pylist() for c in ("rank", "score"))
    if low_percent is None:
        m = len(ranks)
        return np.full((m, 1), -np.inf), np.full((m, 1), np.inf), np.zeros((m, 1), np.int64), np.zeros((m, 1), np.int64)
    slots = max(map(len, ranks), default=0)
    low, high = np.full((len(ranks), slots), np.inf), np.full((len(ranks), slots), -np.inf)
    key, score = np.zeros((len(ranks), slots), np.int64), np.zeros((len(ranks), slots), np.int64)
    for i, (r, s) in enumerate(zip(ranks, scores)):
        # Whole scores with low_percent * positive <= 100 * score <= high_percent * positive.
        low[i, :len(s)] = [-(-low_percent * v // 100) for v in s]
        high[i, :len(s)] = [high_percent * v // 100 for v in s]
        key[i, :len(r)], score[i, :len(s)] = r, s
    return low, high, key, score


def _usable(labels: np.ndarray, uids: np.ndarray, other_labels: np.ndarray, other_uids: np.ndarray, same: bool) -> np.ndarray:
    codes = pd.factorize(np.concatenate((labels, other_labels)))[0]
    equal = codes[:len(labels), None] == codes[None, len(labels):]
    return equal & (uids[:, None] != other_uids[None, :]) if same else ~equal


def _columns(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.asarray(table.column(c)) for c in ("uid", "key", "label"))


def _start(table: pa.Table, dim: int, k: int, percents) -> pa.Table:
    """Members of a block with the limits that their fellows give them."""
    x = unpacked(table.column("x"), dim)
    uids, _, labels = _columns(table)
    low, high, _, _ = _bands(table, *percents)
    limits = np.empty_like(low)
    for a in range(0, len(x), 512):
        part = slice(a, a + 512)
        limits[part] = _limits(products(x[part], x), k, low[part], high[part], _usable(labels[part], uids[part], labels, uids, percents[0] is None))
    at = table.schema.get_field_index("low")
    return table.set_column(at, "low", pa.array([list(map(float, r)) for r in limits], pa.list_(pa.float64())))


def _needs(batches, dim: int, centres: np.ndarray, percents):
    """Per block: the widest angle of its members to the centroid, and the least bound that one of them can use."""
    for b in batches:
        x, block = unpacked(b.column("x"), dim), np.asarray(b.column("block"))
        unit, norms = directions(x)
        angle = np.arccos(np.clip((unit * centres[block]).sum(axis=1), -1, 1)) if len(x) else np.zeros(0)
        # A slot that takes nothing (low above high) needs nothing.
        _, high, _, _ = _bands(b, *percents)
        lows = b.column("low").to_pylist()
        least = np.array([min((v for v, h in zip(row, hs) if v <= h), default=math.inf) for row, hs in zip(lows, high)])
        need = np.where(norms > 0, least / np.maximum(norms, 1e-300), np.where(least <= 0, -math.inf, math.inf))
        yield pa.RecordBatch.from_arrays([b.column("block"), b.column("part"), pa.array(angle), pa.array(need)], ["block", "part", "angle", "need"])


def _listed(batches, dim: int, centres: np.ndarray, radius: np.ndarray, need: np.ndarray, parts: np.ndarray, segments: int):
    """Each candidate on the list of every cluster that can use it."""
    for b in batches:
        x, uid = unpacked(b.column("x"), dim), np.asarray(b.column("uid"))
        angle, norms = angles(x, centres)
        bound = norms[:, None] * (np.cos(np.maximum(0, angle - radius)) + SLACK)
        row, block = np.nonzero(bound >= need)
        times = parts[block]
        row, block, bound = np.repeat(row, times), np.repeat(block, times), np.repeat(bound[row, block], times)
        part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        at = pa.array(row)
        void = lambda kind: pa.nulls(len(row), pa.list_(kind))
        yield pa.RecordBatch.from_arrays(
            [pa.array(block, pa.int32()), pa.array(part, pa.int32()), pa.array(uid[row] % segments, pa.int32()), pa.array(bound),
             *(b.column(c).take(at) for c in ("uid", "key", "label", "x")), void(pa.int64()), void(pa.int64()), void(pa.float64())],
            ["block", "part", "segment", "bound", "uid", "key", "label", "x", "rank", "score", "low"])


class _Walk:
    """The members of one block on their way through one segment of the list."""

    def __init__(self, table: pa.Table, dim: int, k: int, percents):
        self.x, self.dim, self.same = unpacked(table.column("x"), dim), dim, percents[0] is None
        self.uids, self.keys, self.labels = _columns(table)
        self.norms = directions(self.x)[1]
        low, high, self.positive, self.positive_score = _bands(table, *percents)
        start = np.array(table.column("low").to_pylist(), np.float64).reshape(low.shape)
        self.best = Best(np.where(low <= high, np.maximum(low, start), np.inf), high, k)

    def step(self, batch) -> bool:
        """Take a piece of the list; false if no member can use what follows it."""
        bounds = np.asarray(batch.column("bound"))
        for a in range(0, len(bounds), PIECE):
            active = np.flatnonzero(self.norms * bounds[a] >= self.best.least.min(axis=1, initial=math.inf))
            if not len(active):
                return False
            piece = batch.slice(a, PIECE)
            uids, keys, labels = _columns(piece)
            scores = products(self.x[active], unpacked(piece.column("x"), self.dim))
            self.best.add(active, scores, _usable(self.labels[active], self.uids[active], labels, uids, self.same), keys, uids)
        return True

    def result(self) -> pa.RecordBatch:
        slots = self.best.low.shape[1]
        who, slot = np.divmod(self.best.rows[:, 0], max(1, slots))
        columns = [self.uids[who], self.keys[who], slot.astype(np.int32), self.positive[who, slot], self.positive_score[who, slot],
                   self.best.rows[:, 3], self.best.rows[:, 2], self.best.rows[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns],
                                          ["anchor", "anchor_key", "slot", "positive", "positive_score", "uid", "key", "score"])


def _walked(batches, dim: int, k: int, percents):
    """Rows come by block, part and segment, members (bound infinity) first, then candidates by falling bound."""
    here, members, walk, going = None, [], None, True
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.column_stack([np.asarray(b.column(c)) for c in ("block", "part", "segment")])
        is_member = np.isinf(np.asarray(b.column("bound")))
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (is_member[1:] != is_member[:-1])) + 1
        for a, e in zip(np.r_[0, cuts], np.r_[cuts, b.num_rows]):
            if here != tuple(keys[a]):
                if walk:
                    yield walk.result()
                here, members, walk, going = tuple(keys[a]), [], None, True
            if is_member[a]:
                members.append(b.slice(a, e - a))
            elif going and members:
                walk = walk or _Walk(pa.Table.from_batches(members).combine_chunks(), dim, k, percents)
                going = walk.step(b.slice(a, e - a))
    if walk:
        yield walk.result()


def _search(rows: DataFrame, members: DataFrame, dim: int, centres: np.ndarray, total: int, k: int, percents, label: str) -> DataFrame:
    """The ``k`` best rows per member and slot."""
    started = stored(members.groupBy("block", "part").applyInArrow(lambda t: _start(t, dim, k, percents), MEMBER), label)
    needs = (started.mapInArrow(lambda it: _needs(it, dim, centres, percents), "block int, part int, angle double, need double")
             .groupBy("block").agg(F.max("angle").alias("angle"), F.min("need").alias("need"), (F.max("part") + 1).alias("parts")))
    # One row per centroid, of which there are at most CLUSTERS.
    radius, need, parts = np.zeros(len(centres)), np.full(len(centres), math.inf), np.zeros(len(centres), np.int64)
    for r in needs.collect():
        radius[r.block], need[r.block], parts[r.block] = r.angle + SLACK, r.need, r.parts
    blocks = max(1, int(parts.sum()))
    segments = int(max(1, total // SEGMENT, partitions_of(rows) // blocks))
    listed = rows.mapInArrow(lambda it: _listed(it, dim, centres, radius, need, parts, segments), LIST)
    walkers = started.select("block", "part", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"),
                             F.lit(math.inf).alias("bound"), "uid", "key", "label", "x", "rank", "score", "low")
    walks = min(blocks * segments, max(partitions_of(rows), blocks * total // (SEGMENT * 4)))
    lists = (listed.unionByName(walkers).repartition(int(walks), "block", "part", "segment")
             .sortWithinPartitions("block", "part", "segment", F.desc("bound")))
    found = lists.mapInArrow(lambda it: _walked(it, dim, k, percents), FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "key", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
                   key: str = "vec_id", vector: str = "embedding", label: str = "label", cluster_size: int = CLUSTER_SIZE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Entries become ``floor(scale * entry)``, scores are integer inner products, and
    higher scores come first, then smaller keys. The rows for which the column
    ``anchors`` is true are anchors. An anchor's positives are its best ``positives`` other rows
    of its label; for each, the best ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score`` are returned.

    The key is an integer. Rows with a null key, label or vector, with null, NaN or infinite entries, or of another
    length than most vectors take no part. Rows that share a key are rows of
    their own: each can be the other's positive, and if they are anchors each has its results.
    A positive of negative score has no negatives. Scores beyond 64
    bits are cut to the nearest number. Other columns are not looked at. An empty table gives an empty result.

    ``cluster_size`` is about how many anchors share a list, up to
    ``CLUSTERS`` lists; centroids are fitted to at most 16 sampled anchors a
    cluster. Neither changes the result.
    """
    spark = df.sparkSession
    ship_package(spark)
    dim = common_length(df, vector)
    given = df.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("bigint").alias("key"), F.col(label).cast("string").alias("label"),
                      F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("vector"))
    given = given.where("key is not null and label is not null and vector is not null")
    # Numbered once: the table is written before the numbers are used.
    rows = stored(given.mapInArrow(lambda it: _valid(it, dim, scale), ROW), "candidates")
    total, count = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    k = max(1, min(CLUSTERS, -(-count // cluster_size)))
    sample = rows.where("anchor").orderBy(F.xxhash64("uid")).limit(16 * k).select("x").toArrow()
    centres = fit_centroids(unpacked(sample.column("x"), dim), k) if count else np.zeros((1, dim))

    def nearest(batches):
        for b in batches:
            block = angles(unpacked(b.column("x"), dim), centres)[0].argmin(axis=1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block.astype(np.int32))], [*b.schema.names, "block"])

    placed = rows.where("anchor").select("uid", "key", "label", "x").mapInArrow(nearest, "uid bigint, key bigint, label string, x binary, block int")
    sizes = {r.block: r["count"] for r in placed.groupBy("block").count().collect()}  # one per centroid
    splits = F.array(*[F.lit(-(-sizes.get(i, 1) // MEMBERS)) for i in range(len(centres))])
    void = [F.lit(None).cast(f"array<{t}>").alias(n) for n, t in (("rank", "bigint"), ("score", "bigint"), ("low", "double"))]
    members = placed.select("block", F.pmod(F.xxhash64("uid"), F.element_at(splits, F.col("block") + 1)).cast("int").alias("part"),
                            "uid", "key", "label", "x", *void)

    best = _search(rows, members, dim, centres, total, positives, (None, None), "anchors")
    best = stored(best.select(F.col("anchor").alias("uid"), "rank", "key", "score"), "positives")
    # At most `positives` per anchor, in order of rank.
    ranked = best.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "key", "score"))).alias("p"))
    second = (members.drop("rank", "score").join(ranked, "uid")
              .select("block", "part", "uid", "key", "label", "x", F.col("p.key").alias("rank"), F.col("p.score").alias("score"), "low"))
    found = _search(rows, second, dim, centres, total, negatives, (low, high), "anchors-with-positives")
    return found.select(F.col("anchor_key").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
                        F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

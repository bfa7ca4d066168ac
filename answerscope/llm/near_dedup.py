"""Near copies by Jaccard similarity of word shingles, with SetSketch registers.

1. Every text gets ``REGISTERS`` registers: the smallest of exponentially
   distributed hashes of its shingles, rounded down on a logarithmic scale with
   base ``BASE`` and cut to 16 bits. Registers of parts merge by maximum. Texts
   with equal shingle sets become one class.
2. Registers are banded; classes that share a band meet. In each bucket one
   member, chosen by hash, is the pivot: its pairs with the others are
   estimated by maximum likelihood over how many registers are greater, smaller
   and equal, given both set sizes. The estimates only choose; only pairs whose
   sizes rule a link out are left.
3. Each class verifies one pair on full sets, with the pivot that is first in
   one global order, so a large group forms a star. Components follow.
4. Buckets that still hold several components are searched for links between
   them: small buckets by their pairs, large ones
   blockwise: the members outside a bucket's largest component, on full sets,
   against blocks of all members of the buckets around that component. Only links are emitted. Components follow again.

No step makes all pairs of a group, and none leaves out a pair of different
components that shares a band. The bands follow the threshold: two sets that
reach it share no band with a probability of at most ``MISS``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..session import ship_package
from .arrays import U64, WORD_BASE, Words, mix, pieces, rolling, span_hashes
from .components import components
from .native import apart, row_key, stored

REGISTERS = 128
MISS = 1e-6
BASE = 1.001
RATE = 20.0  # of the exponential hashes; the largest possible register then stays in reach of one element
TOP = 0xFFFE
SMALL_BUCKET = 64
BLOCK = 512
_ODD = mix(np.arange(1, REGISTERS + 1, dtype=U64)) | U64(1)
_SHIFT = mix(np.arange(1001, 1001 + REGISTERS, dtype=U64))


# --- sets and registers ------------------------------------------------------

def shingle_sets(texts, shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    Words are separated by ASCII white space, A-Z in lower case. A text of
    fewer words than a shingle, but not none, has one shingle of all its words.
    """
    column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    words = Words(column, "lowered")
    sums = words.sums()
    every = rolling(sums, shingle, WORD_BASE)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(every[a:b - shingle + 1]))
        elif b > a:
            out.append(mix(span_hashes(sums, np.array([a]), np.array([b]), WORD_BASE) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, one row per set; zeros for an empty one."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        every = np.concatenate([sets[i] for i in some])
        begins = np.cumsum([0, *[len(sets[i]) for i in some]])[:-1]
        least = np.empty((len(some), REGISTERS), U64)
        for k in range(REGISTERS):
            least[:, k] = np.minimum.reduceat((every ^ _SHIFT[k]) * _ODD[k], begins)
        exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 64) / RATE
        out[some] = np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, TOP).astype(np.uint16)
    return out


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of register rows, given the set sizes."""
    greater, smaller = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - greater - smaller
    u = n_a / (n_a + n_b)
    v = 1 - u

    def share(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j):
        p, q = share(np.maximum(u - v * j, 1e-12)), share(np.maximum(v - u * j, 1e-12))
        return greater * np.log(p) + smaller * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        one, two = low + (high - low) / 3, high - (high - low) / 3
        up = likelihood(one) < likelihood(two)
        low, high = np.where(up, one, low), np.where(up, high, two)
    return (low + high) / 2


def banding(percent: int) -> tuple[int, int]:
    """Number of bands and registers in each: as long as ``MISS`` allows, four at most, and as few as it needs.

    Registers are equal with a probability of the similarity at least.
    """
    for rows in (4, 3, 2, 1):
        bands = math.ceil(math.log(MISS) / math.log1p(-(min(percent, 99) / 100) ** rows))
        if bands * rows <= REGISTERS:
            return bands, rows
    raise ValueError(f"a threshold of {percent} percent needs more than {REGISTERS} registers")


def similar(n_a, n_b, common, percent: int):
    """Whether the exact similarity reaches the threshold, in whole numbers."""
    return 100 * common >= percent * (n_a + n_b - common)


# --- tasks -----------------------------------------------------------------

def _sketch(batches, shingle: int):
    for batch in batches:
        for piece in pieces(batch, "text"):
            sets = shingle_sets(piece.column("text"), shingle)
            rows = registers(sets)
            # Sums over a set name it, whatever the order; two lanes of 64 bits.
            lanes = [np.array([f(s).sum(dtype=U64) if len(s) else 0 for s in sets], U64).view(np.int64)
                     for f in (mix, lambda s: mix(s ^ U64(0x5851F42D4C957F2D)))]
            yield pa.RecordBatch.from_arrays(
                [piece.column("key"), piece.column("r1"), piece.column("r2"), pa.array([len(s) for s in sets], pa.int64()),
                 *map(pa.array, lanes), pa.array([r.tobytes() for r in rows], pa.binary())],
                names=["key", "r1", "r2", "n", "s1", "s2", "registers"])


def _sets(batches, shingle: int):
    for batch in batches:
        for piece in pieces(batch, "text"):
            sets = shingle_sets(piece.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([piece.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["rep", "shingles"])


def _matrix(column, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _estimated(batches):
    for batch in batches:
        if not len(batch):
            continue
        close = estimate(_matrix(batch.column("ra"), np.uint16, REGISTERS), _matrix(batch.column("rb"), np.uint16, REGISTERS),
                         np.asarray(batch.column("na"), float), np.asarray(batch.column("nb"), float))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(close)], names=["a", "b", "estimate"])


def _verified(batches, percent: int):
    for batch in batches:
        links = []
        for a, b in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
            x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
            both = np.sort(np.concatenate((x, y)))
            links.append(bool(similar(len(x), len(y), int((both[1:] == both[:-1]).sum()), percent)))
        keep = pa.array(links, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """Links between the asking members and a block's members: one for each asker and component."""
    asks = np.asarray(table.column("asks"))
    ids, parts = np.asarray(table.column("rep")), np.asarray(table.column("component"))
    sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
    here = np.flatnonzero(~asks)
    out = []
    if len(here):
        sizes = np.array([len(sets[i]) for i in here])
        owner = np.repeat(np.arange(len(here)), sizes)
        every = np.concatenate([sets[i] for i in here])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        for i in np.flatnonzero(asks):
            low, high = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
            each = high - low
            at = np.repeat(low - np.cumsum(each) + each, each) + np.arange(each.sum())
            common = np.bincount(owner[at], minlength=len(here))
            good = similar(len(sets[i]), sizes, common, percent) & (parts[here] != parts[i])
            linked = np.flatnonzero(good)
            _, firsts = np.unique(parts[here][linked], return_index=True)
            out += [(int(ids[i]), int(ids[here[j]])) for j in linked[firsts]]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


# --- operator ----------------------------------------------------------------

LINK = "a bigint, b bigint"


def _bands(classes: DataFrame, percent: int) -> DataFrame:
    """``bucket, rep``: a row per class and band."""
    bands, rows = banding(percent)
    hashes = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", 2 * rows * i + 1, 2 * rows)) for i in range(bands)])
    return classes.select("rep", F.explode(hashes).alias("bucket"))


def _able(percent: int):
    """Whether the sizes allow a link: two sets share no more than the smaller one has."""
    return F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")


def _able_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of the pairs whose sizes allow a link."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_able(percent)).select("a", "b")


def _estimates(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``a, b, estimate`` of the pairs whose sizes allow a link."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(_able(percent))
    return joined.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimated, f"{LINK}, estimate double")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"s{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(lambda b: _verified(b, percent), LINK)


def _across(buckets: DataFrame, parts: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a bucket."""
    members = stored(buckets.join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "members")
    split = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("c1"), F.max("component").alias("c2"))
    split = stored(split.where("c1 <> c2").select("bucket", "m"), "split-buckets")
    small = members.join(split.where(F.col("m") <= SMALL_BUCKET), "bucket").select("bucket", "rep", "component")
    other = small.select("bucket", F.col("rep").alias("b"), F.col("component").alias("cb"))
    pairs = (small.join(other, "bucket").where((F.col("rep") < F.col("b")) & (F.col("component") != F.col("cb")))
             .select(F.col("rep").alias("a"), "b").distinct())
    by_pairs = _links(_able_pairs(pairs, classes, percent), sets, percent)
    rows = members.join(split.where(F.col("m") > SMALL_BUCKET).select("bucket"), "bucket")
    main = (rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("main")))
    # Buckets around the same component hold much the same members; those meet once.
    rows = stored(rows.join(main, "bucket").select("main", "rep", "component").distinct(), "large-buckets")
    outside = F.col("component") != F.col("main")
    in_blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = rows.join(rows.groupBy("main").agg(in_blocks(F.count(F.lit(1))).alias("blocks"),
                                              in_blocks(F.count_if(outside)).alias("ask_blocks")), "main")
    # A group is a block of asking members and a block of members, so its size is bounded.
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64(F.lit(n), "rep"), n).cast("int").alias(n)
    own = rows.where("ask_blocks > 0").select("main", each("ask_blocks").alias("ask_blocks"), one("blocks"), "rep", "component", F.lit(False).alias("asks"))
    asking = rows.where(outside).select("main", one("ask_blocks"), each("blocks").alias("blocks"), "rep", "component", F.lit(True).alias("asks"))
    by_blocks = (own.unionByName(asking).join(sets, "rep").groupBy("main", "ask_blocks", "blocks")
                 .applyInArrow(lambda t: _block_links(t, percent), LINK))
    return by_pairs.unionByName(by_blocks)


def near_dedup(docs: DataFrame, shingle: int = 3, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The input's columns with ``n_shingles``, ``component_id`` and ``kept``.

    Two rows are linked if 100 times the shingles they share is at least
    ``percent`` times those they have; ``component_id`` is the smallest key
    that links reach, the own one included, and ``kept`` says that it is the
    own one. Null and empty texts have no shingles and are linked with nothing.
    The key is an integer; rows without one are linked with nothing, have no
    component and are kept. Rows that share a key are documents of their own.
    Columns of the input with these names are replaced. An
    empty table gives an empty result. Runs some twenty jobs; each writes a
    small table to the shared folder, so a lost executor repeats one of them.
    """
    return apart(docs, [key, text], ("n_shingles", "component_id", "kept"), lambda d: _with_components(d, shingle, percent, text, key))


def _with_components(docs: DataFrame, shingle: int, percent: int, text: str, key: str) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), *row_key(key, text), F.col(text).alias("text"))
    sketch_schema = StructType([StructField(n, LongType()) for n in ("key", "r1", "r2", "n", "s1", "s2")]
                               + [StructField("registers", BinaryType())])
    sketches = stored(rows.mapInArrow(lambda b: _sketch(b, shingle), sketch_schema), "sketches")
    linked = sketches.where(F.col("key").isNotNull() & (F.col("n") > 0)).withColumn("rep", F.xxhash64("n", "s1", "s2"))
    classes = stored(linked.groupBy("rep", "n").agg(F.min(F.struct("key", "r1", "r2")).alias("least"),
                                                    F.first("registers").alias("registers"))
                     .select("rep", "n", "least.*", "registers"), "classes")

    bands = _bands(classes, percent)
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min_by("rep", F.xxhash64("rep")).alias("pivot")).where("m > 1")
    buckets = stored(bands.join(shared.select("bucket", "pivot"), "bucket"), "buckets")
    # Only classes that share a bucket go on. Their list grows with the corpus, so it is never broadcast.
    wanted = stored(classes.join(buckets.select("rep").distinct(), "rep", "left_semi"), "wanted")
    texts = rows.select("r1", "r2", "text").join(wanted.select("rep", "r1", "r2").hint("merge"), ["r1", "r2"])
    sets = stored(texts.dropDuplicates(["r1", "r2"]).select("rep", "text")
                  .mapInArrow(lambda b: _sets(b, shingle), "rep bigint, shingles binary"), "shingle-sets")

    pairs = buckets.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    close = _estimates(pairs, wanted, percent)
    best = close.groupBy("a").agg(F.max_by("b", F.struct(F.col("estimate") >= percent / 100, F.xxhash64("b"))).alias("b"))

    links = stored(_links(best, sets, percent), "links")
    parts = components(links).withColumnRenamed("id", "rep")
    more = stored(_across(buckets.drop("pivot"), parts, wanted, sets, percent), "links")
    parts = components(links.unionByName(more)).withColumnRenamed("id", "rep")

    named = classes.join(parts, "rep", "left").select("rep", "key", F.coalesce("component", "rep").alias("component"))
    least = named.groupBy("component").agg(F.min("key").alias("component_id"))
    named = named.join(least, "component").select("rep", "component_id")
    by_row = linked.select("r1", "r2", "rep").join(named, "rep").select("r1", "r2", "component_id").distinct()
    sizes = sketches.select("r1", "r2", F.col("n").alias("n_shingles")).distinct().join(by_row, ["r1", "r2"], "left")
    own = [c for c in docs.columns if c not in ("n_shingles", "component_id", "kept")]
    out = docs.select(*own, *[c.alias(f"_{n}") for c, n in zip(row_key(key, text), ("r1", "r2"))])
    out = out.join(sizes.withColumnsRenamed({"r1": "_r1", "r2": "_r2"}), ["_r1", "_r2"])
    component = F.coalesce("component_id", F.col(key).cast("bigint"))
    return out.select(*own, "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col(key) == component, F.lit(True)).alias("kept"))

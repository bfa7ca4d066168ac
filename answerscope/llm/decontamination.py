"""Benchmark passages in training texts, found with a positional inverted index.

The index is a table of shards. A shard holds some megabytes of documents; its
words have running positions, with a gap between texts that no phrase bridges,
and every term (a 64-bit hash of the word) has the sorted list of its
positions. The index is written once and can be asked any number of times.

The test windows come in blocks, and every shard meets every block. In a shard
the lists of a window's two rarest terms are intersected after each is shifted
by the term's offset in the window; the few places left are checked against
the other terms' lists. A place where all terms stand at their offsets is an
exact match.

A place of a window in a text where ``NEAR_SHARE`` of the terms stand within
``slop`` of their offsets is a proximity match. The terms that may miss and one
more are the rarest, absent ones first; one of them must stand, so a place is
sought around each place of these. Words of other texts do not count.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from ..session import scratch_path, ship_package
from .arrays import Words, pieces
from .native import apart, stored

SHARD_BYTES = 4 << 20
GAP = 256  # positions between texts; windows and slop stay below it
BLOCK_WINDOWS = 50_000
NEAR_SHARE = 0.8
NEAR_PLACES = 1 << 18  # places that are tried at once


# --- index -----------------------------------------------------------------

def _shard(table: pa.RecordBatch) -> pa.RecordBatch:
    words = Words(table.column("text"), "alphanumeric")
    sizes = np.diff(words.first)
    first = np.concatenate(([0], np.cumsum(sizes + GAP)[:-1])) if len(sizes) else np.zeros(0, np.int64)
    places = (np.arange(len(words.hashes)) + np.repeat(first - words.first[:-1], sizes)).astype(np.uint32)
    order = np.argsort(words.hashes, kind="stable")
    ranked = words.hashes[order]
    at = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
    # Differences wrap around at each new term; adding up restores the lists.
    gaps = np.diff(places[order], prepend=np.uint32(0))
    return pa.RecordBatch.from_arrays(
        [pa.array([uuid.uuid4().hex]), pa.array([table.column("key").to_pylist()], pa.list_(table.column("key").type)),
         pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([first.astype(np.int64).tobytes()], pa.binary()),
         pa.array([ranked[at].tobytes()], pa.binary()), pa.array([at.astype(np.uint32).tobytes()], pa.binary()),
         pa.array([gaps.tobytes()], pa.binary())],
        names=["shard", "keys", "sizes", "first", "terms", "begins", "gaps"])


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """Write the index of all words of all rows and return its table of shards.

    Without ``path`` it goes to the shared scratch folder. No shuffle: a task
    indexes the rows it reads.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = StructType([StructField("shard", StringType()), StructField("keys", ArrayType(rows.schema["key"].dataType)),
                         StructField("sizes", ArrayType(LongType()))]
                        + [StructField(n, BinaryType()) for n in ("first", "terms", "begins", "gaps")])

    def shards(batches):
        for batch in batches:
            for piece in pieces(batch, "text", SHARD_BYTES):
                yield _shard(piece)

    path = path or scratch_path(spark, "positional-index")
    rows.mapInArrow(shards, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


# --- test windows ----------------------------------------------------------

def _blocks(batches, width: int):
    """Rows of up to ``BLOCK_WINDOWS`` windows: item names, item of each window, its length and its terms."""
    names, items, lengths, terms = [], [], [], []

    def row():
        out = pa.RecordBatch.from_arrays(
            [pa.array([list(names)], pa.list_(pa.string())), pa.array([np.array(items, np.int32).tobytes()], pa.binary()),
             pa.array([np.array(lengths, np.int32).tobytes()], pa.binary()),
             pa.array([np.array(terms, np.uint64).reshape(-1).tobytes()], pa.binary())],
            names=["names", "items", "lengths", "window_terms"])
        for x in (names, items, lengths, terms):
            x.clear()
        return out

    for batch in batches:
        words = Words(batch.column("text"), "alphanumeric")
        for i, name in enumerate(batch.column("item").to_pylist()):
            own = words.hashes[words.first[i]:words.first[i + 1]]
            for begin in range(max(1, len(own) - width + 1) if len(own) else 0):
                if not names or names[-1] != name or begin == 0:
                    names.append(name)
                window = own[begin:begin + width]
                items.append(len(names) - 1)
                lengths.append(len(window))
                terms.append(np.pad(window, (0, width - len(window))))
                if len(items) >= BLOCK_WINDOWS:
                    yield row()
                    # A long item goes on in the next block under its name.
    if items:
        yield row()


def test_windows(items: DataFrame, width: int, text: str = "text", item: str = "item_id") -> DataFrame:
    """Blocks of the items' windows; an item of fewer words, but not none, is one window."""
    ship_package(items.sparkSession)
    rows = items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda b: _blocks(b, width),
                           "names array<string>, items binary, lengths binary, window_terms binary")


# --- search ----------------------------------------------------------------

class _Lists:
    """The lists of one shard as one sorted array of (term number, position)."""

    def __init__(self, terms: bytes, begins: bytes, gaps: bytes):
        self.terms = np.frombuffer(terms, np.uint64)
        self.places = np.cumsum(np.frombuffer(gaps, np.uint32), dtype=np.uint32)
        self.begins = np.append(np.frombuffer(begins, np.uint32), len(self.places)).astype(np.int64)
        number = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.begins))
        self.keys = (number << 32) | self.places

    def look_up(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and list lengths, 0 where a term is not in the shard."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return at, np.where(self.terms[at] == terms, self.begins[at + 1] - self.begins[at], 0)

    def near(self, number: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """Whether the terms stand within ``slop`` of the places."""
        return self.between(number, place - slop, place + slop)

    def between(self, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the terms stand at a place from ``low`` to ``high``."""
        least = (number << 32) | np.maximum(low, 0)
        at = np.minimum(np.searchsorted(self.keys, least), len(self.keys) - 1)
        found = self.keys[at]
        return (found >= least) & (found <= ((number << 32) | np.maximum(high, 0))) & (high >= 0)


def _probe(lists: _Lists, number: np.ndarray, counts: np.ndarray, window: np.ndarray, offset: np.ndarray):
    """Every place of one term for each window: the place in the list of windows, and the place in the shard."""
    sizes = counts[window, offset]
    row = np.repeat(np.arange(len(window)), sizes)
    step = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, lists.places[lists.begins[number[window, offset]][row] + step].astype(np.int64)


def _exact(lists: _Lists, number: np.ndarray, counts: np.ndarray, lengths: np.ndarray):
    """Places and windows of exact matches."""
    inside = np.arange(number.shape[1]) < lengths[:, None]
    alive = np.flatnonzero(((counts > 0) | ~inside).all(1) & (lengths > 0))
    order = np.argsort(np.where(inside, counts, np.iinfo(np.int64).max), axis=1, kind="stable")
    row, place = _probe(lists, number, counts, alive, order[alive, 0])
    window = alive[row]
    start = place - order[window, 0]
    for k in range(1, number.shape[1]):  # the second rarest list first, and on with the places left
        j = order[window, k]
        keep = ~inside[window, j] | lists.near(number[window, j], start + j, 0)
        window, start = window[keep], start[keep]
    return start, window


def _near(lists: _Lists, number: np.ndarray, counts: np.ndarray, lengths: np.ndarray, slop: int, first: np.ndarray):
    """Texts and windows of proximity matches."""
    width = number.shape[1]
    inside = np.arange(width) < lengths[:, None]
    needed = np.ceil(NEAR_SHARE * lengths).astype(np.int64)
    alive = np.flatnonzero(((counts > 0).sum(1) >= needed) & (lengths > 0))
    order = np.argsort(np.where(inside, counts, np.iinfo(np.int64).max), axis=1, kind="stable")
    begins, ends = first, np.append(first[1:] - 1, np.iinfo(np.uint32).max)
    found = [np.zeros((2, 0), np.int64)]

    def stands(window, rank, start, text, far):
        """Whether the term of this rank is in the text, at most ``far`` from its offset."""
        term = order[window, rank]
        low, high = np.maximum(start + term - far, begins[text]), np.minimum(start + term + far, ends[text])
        return (rank < lengths[window]) & (counts[window, term] > 0) & lists.between(number[window, term], low, high)

    for k in range(width):
        # The rarest term of a match has rank k, so the k rarer ones count as missed.
        probed = alive[(k <= lengths - needed)[alive]]
        probed = probed[counts[probed, order[probed, k]] > 0]
        each = counts[probed, order[probed, k]]
        parts = (np.cumsum(each) - each) // NEAR_PLACES
        for part in np.unique(parts):
            some = probed[parts == part]
            row, place = _probe(lists, number, counts, some, order[some, k])
            window, text = some[row], np.searchsorted(first, place, side="right") - 1
            start = place - order[window, k]
            misses = np.full(len(window), k, np.int64)
            for j in range(k + 1, width):  # twice slop: the probed term may stand slop away itself
                misses += (j < lengths[window]) & ~stands(window, j, start, text, 2 * slop)
                keep = misses <= lengths[window] - needed[window]
                window, text, start, misses = window[keep], text[keep], start[keep], misses[keep]
            good = np.zeros(len(window), bool)
            for shift in range(-slop, slop + 1):
                good |= sum(stands(window, j, start + shift, text, slop).astype(np.int64) for j in range(k, width)) >= needed[window]
            found.append(np.unique(np.stack((text[good], window[good])), axis=1))
    return tuple(np.concatenate(found, axis=1))


def _by_text(texts: np.ndarray, values: np.ndarray, n: int):
    """Distinct (text, value) pairs, as the texts and where each one's values begin and end."""
    pairs = np.unique(np.stack((texts, values)), axis=1) if len(texts) else np.zeros((2, 0), np.int64)
    return pairs[1], np.searchsorted(pairs[0], np.arange(n + 1))


FOUND = "shard string, ordinal int, hits array<bigint>, items array<string>, near_items array<string>"


def _search(batches, width: int, slop: int):
    for batch in batches:
        for row in batch.to_pylist():
            lists = _Lists(row["terms"], row["begins"], row["gaps"])
            lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
            items = np.frombuffer(row["items"], np.int32).astype(np.int64)
            terms = np.frombuffer(row["window_terms"], np.uint64).reshape(-1, width)
            first = np.frombuffer(row["first"], np.int64)
            number, counts = lists.look_up(terms)
            counts = np.where(np.arange(width) < lengths[:, None], counts, 0)
            start, window = _exact(lists, number, counts, lengths)
            near_text, near_window = _near(lists, number, counts, lengths, slop, first)
            n = len(first)
            text_of = lambda p: np.searchsorted(first, p, side="right") - 1
            text = text_of(start)
            each = lengths[window]
            words = np.repeat(start, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            hits, h = _by_text(np.repeat(text, each), words, n)
            exact, e = _by_text(text, items[window], n)
            near, m = _by_text(near_text, items[near_window], n)
            some = np.flatnonzero((np.diff(h) > 0) | (np.diff(m) > 0))
            names = np.array(row["names"], object)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * len(some), pa.string()), pa.array(some, pa.int32()),
                 pa.array([(hits[h[i]:h[i + 1]] - first[i]).tolist() for i in some], pa.list_(pa.int64())),
                 pa.array([names[exact[e[i]:e[i + 1]]].tolist() for i in some], pa.list_(pa.string())),
                 pa.array([names[near[m[i]:m[i + 1]]].tolist() for i in some], pa.list_(pa.string()))],
                names=["shard", "ordinal", "hits", "items", "near_items"])


def search(index: DataFrame, items: DataFrame, width: int = 10, slop: int = 2, text: str = "text",
           item: str = "item_id") -> DataFrame:
    """All matches of the items' windows, one row per indexed row.

    Returns ``key, n_words, hits`` (word places inside an exact match, sorted),
    ``items`` (names of items with an exact match, sorted as strings) and
    ``near_items`` (with a proximity match; exact ones are among them).
    """
    if not 1 <= width < GAP or not 0 <= slop < GAP // 2:
        raise ValueError(f"width must be below {GAP} and slop below {GAP // 2}")
    # Written, so that the planner knows the size; it broadcasts the blocks only if they are small.
    blocks = stored(test_windows(items, width, text, item), "test-windows")
    pairs = index.select("shard", "first", "terms", "begins", "gaps").crossJoin(blocks)
    found = pairs.mapInArrow(lambda b: _search(b, width, slop), FOUND)
    gather = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
    by_row = found.groupBy("shard", "ordinal").agg(*[gather(c).alias(c) for c in ("hits", "items", "near_items")])
    rows = index.select("shard", F.posexplode(F.arrays_zip("keys", "sizes")).alias("ordinal", "row"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return rows.join(by_row, ["shard", "ordinal"], "left").select(
        F.col("row.keys").alias("key"), F.col("row.sizes").alias("n_words"),
        empty("hits", "bigint"), empty("items", "string"), empty("near_items", "string"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 2, text: str = "text",
                  key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """Index the documents and look for the items: ``key, n_words, hits, items, near_items``.

    Words are ASCII letters (in lower case), digits and all other characters
    beyond ASCII. Null and empty texts have no words and no matches; an item
    without words matches nothing; equal windows of several items count for
    each of them; items with one name count once. Every input row, repeated
    ones and those without a key too, has its own row. Other columns are not
    read.
    """
    return search(build_index(docs, text, key), items, width, slop, text, item).withColumnRenamed("key", key)


def clean_documents(docs: DataFrame, items: DataFrame, width: int = 10, text: str = "text", key: str = "doc_id",
                    item: str = "item_id") -> DataFrame:
    """The rows without an exact match, in the columns of ``docs``.

    Rows are told apart by a hash of key and text, so missing and repeated keys
    do no harm; equal rows share their verdict.
    """
    def without(rows: DataFrame) -> DataFrame:
        named = rows.withColumn("_row", F.xxhash64(key, text))
        found = decontaminate(named, items, width, 0, text, "_row", item).where(F.size("hits") > 0)
        return named.join(stored(found.select("_row").distinct(), "leaks"), "_row", "left_anti")

    return apart(docs, [key, text], (), without)

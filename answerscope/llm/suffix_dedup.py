"""Byte strings that occur earlier, removed; the first occurrence stays.

Bucket-pointer refinement over a sparse set of suffixes. The bucket identifier
of a q-gram is built by doubling: the identifier of 2L bytes comes from those
of L bytes at a place and L places later, down to exact 8-byte codes, and each
level reuses the one before. Identifiers are content hashes, so all tasks agree
on them without an exchange.

1. Of all suffixes, those enter whose q-gram identifier is the least among the
   ``width - q + 1`` places of some window; every window of ``width`` bytes
   holds one, and equal windows hold the same ones. Buckets (q-grams) with one
   member in the corpus are finished.
2. The others are refined by the identifiers of the ``width``-byte strings at
   the ends of their surroundings, an earlier and a later offset: members that
   agree there agree in every window around them, so all but the first are
   repeats. A bucket that stays whole is finished too.
3. The first members of buckets that split are refined to the single windows:
   identifiers of the q-grams at a place and q places later. All but the first
   window of a class are repeats.

A q-gram with more members than ``crowd`` is not gathered in one place: its
members are split by their step 2 identifiers at once, and go on to step 3.
Every step sends one entry per chunk and class (see ``exchange``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package
from . import exchange
from .arrays import ALL_ONES, U64, covered, mix, utf8

_ONE, _TWO = U64(0x9FB21C651E98DF25), U64(0xD1B54A32D192ED03)
KEY_BITS = 32


def _refine(ids: np.ndarray, step: int) -> np.ndarray:
    """Identifiers of the strings that are ``step`` bytes longer, from pairs ``step`` apart."""
    n = len(ids) - step
    if n <= 0:
        return np.zeros(0, U64)
    out = ids[:n] * _ONE
    out += ids[step:] * _TWO
    out ^= out >> U64(29)
    return out


def _codes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    n = len(data) - 7
    if n <= 0:
        return np.zeros(0, U64)
    return np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(U64)


def _identifiers(codes: np.ndarray, have: int, want: int) -> np.ndarray:
    while have < want:
        step = min(have, want - have)
        codes, have = _refine(codes, step), have + step
    return codes


def _extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Least (or greatest) value of each window, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values, have = pick(values[:-step], values[step:]), have + step
    return values


class _Suffixes:
    """The sampled suffixes of a chunk, in the order of keys and places."""

    def __init__(self, table: pa.Table, width: int):
        self.q, self.width = width // 2, width
        order = pc.sort_indices(table.select(["_key", "text"]), null_placement="at_end",
                                sort_keys=[("_key", "ascending"), ("text", "ascending")])
        self.table = table.take(order)
        self.keys = self.table.column("_key").fill_null(np.iinfo(np.int64).max).to_numpy()
        self.bytes, self.offsets = utf8(self.table.column("text"))
        self.codes = _codes(self.bytes)
        self.grams = mix(_identifiers(self.codes, 8, self.q))
        n = len(self.grams)
        lengths = np.diff(self.offsets)
        long = lengths >= width
        # Room after each place inside its text; short texts have no window.
        valid = np.zeros(len(self.bytes) + 1, np.int8)
        np.add.at(valid, self.offsets[:-1][long], 1)
        np.add.at(valid, self.offsets[1:][long] - self.q + 1, -1)
        valid = np.cumsum(valid[:n], dtype=np.int8) > 0
        shown = np.where(valid, self.grams, U64(ALL_ONES))
        span = width - self.q + 1
        if n >= span:
            least = _extreme(shown, span, np.minimum)
            # Windows over the end of a text would show their neighbours' values.
            best = np.full(n, U64(0))
            inner = np.zeros(len(self.bytes) + 1, np.int8)
            np.add.at(inner, self.offsets[:-1][long], 1)
            np.add.at(inner, self.offsets[1:][long] - width + 1, -1)
            inner = np.cumsum(inner[:len(least)], dtype=np.int8) > 0
            least[~inner] = 0
            padded = np.concatenate((np.zeros(span - 1, U64), least, np.zeros(span - 1, U64)))
            best = _extreme(padded, span, np.maximum)[:n]
            self.at = np.flatnonzero(valid & (best == self.grams))
        else:
            self.at = np.zeros(0, np.int64)
        text = np.searchsorted(self.offsets, self.at, side="right") - 1
        self.left = np.minimum(span - 1, self.at - self.offsets[text])
        self.right = np.minimum(span - 1, self.offsets[text + 1] - self.at - self.q)
        self.key = self.keys[text]
        self.gram = self.grams[self.at]

    def wholes(self) -> np.ndarray:
        """Identifiers of all strings of ``width`` bytes."""
        return mix(_identifiers(self.grams, self.q, self.width))

    def surroundings(self, wholes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Identifiers of the strings from ``left`` before to ``right`` after the suffixes' q-grams."""
        first, last = self.at[at] - self.left[at], self.at[at] + self.q + self.right[at] - self.width
        edge = (self.left[at] * (self.width + 1) + self.right[at]).astype(U64)
        return mix(wholes[first] * _ONE + wholes[last] * _TWO + edge)

    def asked_grams(self, owners: int):
        """Sorted distinct keys of the sampled q-grams, their counts, and each suffix's own key."""
        keys = exchange.owner_keys(self.gram, self.gram & U64(0xFFFFFFFF), owners, KEY_BITS)
        known, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        return known, inverse, counts

    def asked_classes(self, owners: int, answers: pa.Table, wholes: np.ndarray):
        """Members of repeated buckets: first of each class in this chunk, and the later ones."""
        known, inverse, _ = self.asked_grams(owners)
        repeated, crowded = _two_bits(answers, exchange.by_owner(known, KEY_BITS, owners))
        at = np.flatnonzero(repeated[inverse])
        ids, crowd = self.surroundings(wholes, at), crowded[inverse[at]]
        owner = np.where(crowd, mix(self.gram[at] ^ ids), self.gram[at]) % U64(owners)
        order = np.lexsort((ids, self.gram[at]))  # stable: places stay in order within a class
        g, c = self.gram[at][order], ids[order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1]))) if len(g) else np.zeros(0, bool)
        first = np.zeros(len(at), bool)
        first[order[new]] = True
        return at, ids, crowd, owner, first

    def asked_windows(self, chosen: np.ndarray, wholes: np.ndarray, owners: int):
        """Windows around the chosen suffixes: places, identifiers, owners, first of each in this chunk."""
        marks = np.zeros(len(self.bytes) + 1, np.int32)
        np.add.at(marks, self.at[chosen] - self.left[chosen], 1)
        np.add.at(marks, self.at[chosen] + self.q + self.right[chosen] - self.width + 1, -1)
        places = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        ids = wholes[places]
        second = np.zeros(len(places), U64)
        for k in range(5):  # exact bytes at five offsets, independent of the identifiers
            second = second * _TWO + self.codes[places + (self.width - 8) * k // 4]
        owner = mix(second) % U64(owners)
        order = np.lexsort((ids, owner))
        o, h = owner[order], ids[order]
        new = np.concatenate(([True], (o[1:] != o[:-1]) | (h[1:] != h[:-1]))) if len(o) else np.zeros(0, bool)
        first = np.zeros(len(places), bool)
        first[order[new]] = True
        return places, ids, owner, first


def _two_bits(answers: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = np.zeros(bounds[-1], bool), np.zeros(bounds[-1], bool)
    for owner, bits in zip(answers.column("owner").to_pylist(), answers.column("bits").to_pylist()):
        a, b = bounds[owner], bounds[owner + 1]
        both = np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * (b - a))
        one[a:b], two[a:b] = both[:b - a], both[b - a:]
    return one, two


def _packed(*flags: np.ndarray) -> bytes:
    return np.packbits(np.concatenate(flags)).tobytes()


def _spans(bounds: np.ndarray) -> list[tuple[int, int]]:
    return [(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if b > a]


def _ask_grams(chunk: int, table: pa.Table, width: int, owners: int) -> pa.Table:
    known, _, counts = _Suffixes(table, width).asked_grams(owners)
    bounds = exchange.by_owner(known, KEY_BITS, owners)
    low, counts = known.astype(np.uint32), np.minimum(counts, 0xFFFF).astype(np.uint16)
    return exchange.ask_rows(chunk, bounds, [low[a:b].tobytes() for a, b in _spans(bounds)],
                             [counts[a:b].tobytes() for a, b in _spans(bounds)])


def _answers(table: pa.Table, sizes: list[int], *flags: np.ndarray) -> pa.Table:
    cuts = np.cumsum([0, *sizes])
    return pa.table({"chunk": table.column("chunk"), "owner": table.column("owner"),
                     "bits": pa.array([_packed(*[f[a:b] for f in flags]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})


def _columns(table: pa.Table, name: str, kind) -> tuple[np.ndarray, list[int]]:
    parts = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    return np.concatenate(parts), [len(x) for x in parts]


def _answer_grams(table: pa.Table, crowd: int) -> pa.Table:
    """Two bits for each key: has it two members, has it more than ``crowd``?"""
    keys, sizes = _columns(table, "keys", np.uint32)
    counts, _ = _columns(table, "flags", np.uint16)
    _, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, weights=counts)[inverse]
    return _answers(table, sizes, total > 1, total > crowd)


def _ask_classes(chunk: int, table: pa.Table, answers: pa.Table, width: int, owners: int) -> pa.Table:
    s = _Suffixes(table, width)
    at, ids, crowd, owner, first = s.asked_classes(owners, answers, s.wholes())
    keep = np.flatnonzero(first)
    keep = keep[np.argsort(owner[keep], kind="stable")]
    bounds = np.searchsorted(owner[keep], np.arange(owners + 1, dtype=U64))
    gram, ids, key, crowd = s.gram[at][keep], ids[keep], s.key[at][keep], crowd[keep]
    return exchange.ask_rows(chunk, bounds, [gram[a:b].tobytes() + ids[a:b].tobytes() + key[a:b].tobytes() for a, b in _spans(bounds)],
                             [_packed(crowd[a:b]) for a, b in _spans(bounds)])


def _answer_classes(table: pa.Table) -> pa.Table:
    """Two bits for each member: is it a repeat, is it the first of a class in a bucket that splits?"""
    table = table.sort_by("chunk")
    parts = [np.frombuffer(x, U64).reshape(3, -1) for x in table.column("keys").to_pylist()]
    sizes = [p.shape[1] for p in parts]
    gram, ids, key = np.concatenate(parts, axis=1)
    crowd = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(table.column("flags").to_pylist(), sizes)]).astype(bool)
    order = np.lexsort((key.view(np.int64), ids, gram))
    g, c = gram[order], ids[order]
    bucket = np.concatenate(([True], g[1:] != g[:-1]))
    new = bucket | np.concatenate(([True], c[1:] != c[:-1]))
    at = np.flatnonzero(bucket)
    classes = np.add.reduceat(new.astype(np.int64), at)[np.cumsum(bucket) - 1]
    repeat, split = np.zeros(len(gram), bool), np.zeros(len(gram), bool)
    repeat[order] = ~new
    split[order] = new & ((classes > 1) | crowd[order])
    return _answers(table, sizes, repeat, split)


def _resolved(s: _Suffixes, answers: pa.Table, owners: int, wholes: np.ndarray):
    """Suffixes whose windows are all repeats, and those to refine further."""
    kinds = answers.column("kind").to_numpy()
    at, _, _, owner, first = s.asked_classes(owners, answers.filter(pa.array(kinds == 0)), wholes)
    keep = np.flatnonzero(first)
    keep = keep[np.argsort(owner[keep], kind="stable")]
    bounds = np.searchsorted(owner[keep], np.arange(owners + 1, dtype=U64))
    repeat, split = _two_bits(answers.filter(pa.array(kinds == 1)), bounds)
    whole = ~first
    whole[keep] |= repeat
    refine = np.zeros(len(at), bool)
    refine[keep] = split
    enough = s.left + s.right + s.q >= s.width
    return at[whole & enough[at]], at[refine & enough[at]]


def _ask_windows(chunk: int, table: pa.Table, answers: pa.Table, width: int, owners: int) -> pa.Table:
    s = _Suffixes(table, width)
    wholes = s.wholes()
    _, refine = _resolved(s, answers, owners, wholes)
    places, ids, owner, first = s.asked_windows(refine, wholes, owners)
    text = np.searchsorted(s.offsets, places, side="right") - 1
    keep = np.flatnonzero(first)
    keep = keep[np.argsort(owner[keep], kind="stable")]
    bounds = np.searchsorted(owner[keep], np.arange(owners + 1, dtype=U64))
    ids, key = ids[keep], s.keys[text[keep]].astype(np.int64)
    return exchange.ask_rows(chunk, bounds, [ids[a:b].tobytes() for a, b in _spans(bounds)],
                             [key[a:b].tobytes() for a, b in _spans(bounds)])


def _answer_windows(table: pa.Table) -> pa.Table:
    """One bit for each window: does it occur earlier?"""
    table = table.sort_by("chunk")
    ids, sizes = _columns(table, "keys", U64)
    key, _ = _columns(table, "flags", np.int64)
    order = np.lexsort((key, ids))
    h = ids[order]
    again = np.zeros(len(ids), bool)
    again[order] = np.concatenate(([False], h[1:] == h[:-1]))
    return _answers(table, sizes, again)


def _remove(table: pa.Table, answers: pa.Table, width: int, owners: int) -> pa.Table:
    s = _Suffixes(table, width)
    wholes = s.wholes()
    kinds = answers.column("kind").to_numpy()
    whole, refine = _resolved(s, answers, owners, wholes)
    places, _, owner, first = s.asked_windows(refine, wholes, owners)
    keep = np.flatnonzero(first)
    keep = keep[np.argsort(owner[keep], kind="stable")]
    bounds = np.searchsorted(owner[keep], np.arange(owners + 1, dtype=U64))
    again = ~first
    again[keep] = exchange.joined_bits(answers.filter(pa.array(kinds == 2)), bounds)
    n = len(s.bytes)
    gone = covered(places[again], width, n)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, s.at[whole] - s.left[whole], 1)
    np.add.at(change, s.at[whole] + s.q + s.right[whole], -1)
    gone |= np.cumsum(change[:-1]) > 0
    kept, removed, spans = [], [], []
    for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist()):
        here = gone[a:b]
        kept.append(s.bytes[a:b][~here].tobytes())
        edges = np.flatnonzero(np.diff(np.concatenate(([0], here.astype(np.int8), [0]))))
        removed.append(int(here.sum()))
        spans.append(edges.tolist())
    out = s.table.select(["_key"])
    out = out.append_column("n_bytes", pa.array(np.diff(s.offsets), pa.int64()))
    out = out.append_column("n_removed", pa.array(removed, pa.int64()))
    out = out.append_column("removed_spans", pa.array(spans, pa.list_(pa.int64())))
    return out.append_column("kept", pa.array(kept, pa.binary()))


def suffix_dedup(docs: DataFrame, width: int = 100, text: str = "text", key: str = "doc_id", crowd: int = 20_000) -> DataFrame:
    """Remove every byte that a string of ``width`` bytes covers which also starts earlier.

    Earlier means a smaller key, or the same text and an earlier place; rows
    with the same key are in a fixed order of their own, rows without a key
    come last. Returns one row per input row: the key, ``n_bytes``,
    ``n_removed``, ``removed_spans`` (byte places where removed runs begin and
    end, in turn) and ``kept`` (the remaining bytes; a character may be cut).
    Null counts as empty; texts shorter than ``width`` lose nothing; a repeated
    row loses all its full windows, the first copy none of them. The key is an
    integer, ``width`` at least 16. Other columns are not read.
    """
    if width < 16:
        raise ValueError("width must be at least 16 bytes")
    ship_package(docs.sparkSession)
    base, owners = exchange.in_chunks(docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("text")),
                                      ["_key", "text"], key="_key")

    def asked(function, answers=None):
        if answers is None:
            return base.groupBy("chunk").applyInArrow(lambda g, t: function(g[0].as_py(), t, width, owners), exchange.ASK)
        return base.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
            lambda g, t, a: function(g[0].as_py(), t, a, width, owners), exchange.ASK)

    def answered(asks, function, kind):
        return asks.groupBy("owner").applyInArrow(function, exchange.ANSWER).withColumn("kind", F.lit(kind))

    grams = answered(asked(_ask_grams), lambda t: _answer_grams(t, crowd), 0)
    classes = answered(asked(_ask_classes, grams), _answer_classes, 1)
    known = grams.unionByName(classes)
    windows = answered(asked(_ask_windows, known), _answer_windows, 2)
    done = base.groupBy("chunk").cogroup(known.unionByName(windows).groupBy("chunk")).applyInArrow(
        lambda t, a: _remove(t, a, width, owners),
        "_key bigint, n_bytes bigint, n_removed bigint, removed_spans array<bigint>, kept binary")
    return done.withColumnRenamed("_key", key)

"""Repeated word sequences, removed wherever they stand.

Fixed-block anchors: every text is cut into non-overlapping blocks of half a
window; the blocks' hashes are the index. Every rolling window of block length
probes it. A window of ``width`` words that occurs twice holds a whole block of
its twin, so it holds a hit. Hits are then extended to either side: each
window of ``width`` words that contains a hit asks whether it occurs again, and
the repeated windows of a text merge into its maximal repeats.

Both questions go from chunks of documents to owners of hashes (``exchange``).
The probes carry 32 bits and their owner; a false hit there costs an extension
and nothing else. The extended windows carry 64 bits and their owner, which is
taken from an independent hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package
from . import exchange
from .arrays import SECOND_BASE, U64, WORD_BASE, Words, covered, rolling, spread

PROBE_BITS = 32


def _block(width: int) -> int:
    """Blocks so short that any ``width`` words contain a whole one."""
    return max(1, (width + 1) // 2)


def _probes(words: Words, width: int, owners: int):
    """Keys of all rolling windows of block length, and which are blocks of the index."""
    size = _block(width)
    keys = exchange.owner_keys(rolling(words.sums(), size, WORD_BASE),
                               rolling(words.sums(SECOND_BASE), size, SECOND_BASE), owners, PROBE_BITS)
    valid = words.inside_text(size)
    place = np.arange(len(words.hashes)) - np.repeat(words.first[:-1], np.diff(words.first))
    return keys, valid, valid & (place[:len(valid)] % size == 0)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and which occur more than once."""
    if not len(keys):
        return keys, np.zeros(0, bool)
    keys = np.sort(keys)
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys))) > 1


def _contains(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys


def _ask_probes(chunk: int, table: pa.Table, width: int, owners: int) -> pa.Table:
    keys, valid, block = _probes(Words(table.column("text")), width, owners)
    known, twice = _distinct(keys[valid])
    anchor = _contains(np.unique(keys[block]), known)
    bounds = exchange.by_owner(known, PROBE_BITS, owners)
    low = (known & U64((1 << PROBE_BITS) - 1)).astype(np.uint32)
    spans = [(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if b > a]
    return exchange.ask_rows(chunk, bounds, [low[a:b].tobytes() for a, b in spans],
                             [np.packbits(np.concatenate((anchor[a:b], twice[a:b]))).tobytes() for a, b in spans])


def _answer(table: pa.Table, kind, anchored: bool) -> pa.Table:
    """One bit per key: does it occur twice in all (and, if asked, as a block)?"""
    keys = [np.frombuffer(k, kind) for k in table.column("keys").to_pylist()]
    flags = table.column("flags").to_pylist()
    sizes = [len(k) for k in keys]
    per = 2 if anchored else 1
    bits = [np.unpackbits(np.frombuffer(f, np.uint8), count=per * n).astype(bool) for f, n in zip(flags, sizes)]
    every, twice = np.concatenate(keys), np.concatenate([b[-n:] for b, n in zip(bits, sizes)])
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    good = np.add.reduceat(1 + twice[order].astype(np.int64), at) > 1
    if anchored:
        blocks = np.concatenate([b[:n] for b, n in zip(bits, sizes)])
        good &= np.add.reduceat(blocks[order].astype(np.int64), at) > 0
    out = np.zeros(len(every), bool)
    out[order] = good[group]
    cuts = np.cumsum([0, *sizes])
    return pa.table({"chunk": table.column("chunk"), "owner": table.column("owner"),
                     "bits": pa.array([np.packbits(out[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})


def _extended(words: Words, answers: pa.Table, width: int, owners: int):
    """Places and hashes of the windows that contain a hit."""
    keys, valid, _ = _probes(words, width, owners)
    known, _ = _distinct(keys[valid])
    found = known[exchange.joined_bits(answers, exchange.by_owner(known, PROBE_BITS, owners))]
    hit = np.zeros(len(words.hashes), bool)
    hit[:len(keys)] = valid & _contains(found, keys)
    whole = words.inside_text(width)
    starts = np.flatnonzero(whole & spread(hit, width - _block(width) + 1)[:len(whole)])
    owner = rolling(words.sums(SECOND_BASE), width, SECOND_BASE)[starts] % U64(owners)
    return starts, owner, rolling(words.sums(), width, WORD_BASE)[starts]


def _sorted_windows(owner: np.ndarray, hashes: np.ndarray):
    """Order of the windows by owner and hash, first places and counts of equal ones."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.concatenate(([True], (o[1:] != o[:-1]) | (h[1:] != h[:-1]))) if len(o) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return order, new, at, np.diff(np.append(at, len(o)))


def _ask_windows(chunk: int, table: pa.Table, answers: pa.Table, width: int, owners: int) -> pa.Table:
    _, owner, hashes = _extended(Words(table.column("text")), answers, width, owners)
    order, _, at, counts = _sorted_windows(owner, hashes)
    owner, hashes, twice = owner[order][at], hashes[order][at], counts > 1
    bounds = np.searchsorted(owner, np.arange(owners + 1, dtype=U64))
    spans = [(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if b > a]
    return exchange.ask_rows(chunk, bounds, [hashes[a:b].tobytes() for a, b in spans],
                             [np.packbits(twice[a:b]).tobytes() for a, b in spans])


def _remove(table: pa.Table, answers: pa.Table, width: int, owners: int) -> pa.Table:
    words = Words(table.column("text"))
    kinds = answers.column("kind").to_numpy()
    starts, owner, hashes = _extended(words, answers.filter(pa.array(kinds == 0)), width, owners)
    order, new, at, _ = _sorted_windows(owner, hashes)
    bounds = np.searchsorted(owner[order][at], np.arange(owners + 1, dtype=U64))
    again = exchange.joined_bits(answers.filter(pa.array(kinds == 1)), bounds)
    repeated = np.zeros(len(starts), bool)
    repeated[order] = again[np.cumsum(new) - 1] if len(starts) else False
    gone = covered(starts[repeated], width, len(words.hashes))
    data, texts, removed, spans = words.bytes.tobytes(), [], [], []
    for i in range(len(table)):
        a, b = words.first[i], words.first[i + 1]
        kept = np.flatnonzero(~gone[a:b]) + a
        texts.append(b" ".join([data[s:e] for s, e in zip(words.starts[kept].tolist(), words.ends[kept].tolist())]).decode())
        removed.append(int(b - a - len(kept)))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone[a:b].astype(np.int8), [0]))))
        spans.append(edges.tolist())
    out = table.drop_columns(["chunk", "text"])
    out = out.append_column("n_words", pa.array(np.diff(words.first), pa.int64()))
    out = out.append_column("n_removed", pa.array(removed, pa.int64()))
    out = out.append_column("removed_spans", pa.array(spans, pa.list_(pa.int64())))
    return out.append_column("kept_text", pa.array(texts, pa.string()))


def substring_dedup(docs: DataFrame, width: int = 35, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Remove every word that a repeated window of ``width`` words covers.

    Returns one row per input row: the key, ``n_words``, ``n_removed``,
    ``removed_spans`` (word places where removed runs begin and end, in turn)
    and ``kept_text`` (kept words joined by one space). Words are separated by
    ASCII white space and kept as they are. Null and empty texts have no words
    and an empty ``kept_text``; texts shorter than the window lose nothing;
    a repeated row is a second text, so both lose all their full windows. Rows
    without a key are treated like any other. Other columns are not read.
    """
    if width < 1:
        raise ValueError("width must be at least 1")
    ship_package(docs.sparkSession)
    base, owners = exchange.in_chunks(docs.select(F.col(key).alias("_key"), F.col(text).alias("text")),
                                      ["_key", "text"], key="_key")

    def ask_probes(group, table):
        return _ask_probes(group[0].as_py(), table, width, owners)

    def ask_windows(group, table, answers):
        return _ask_windows(group[0].as_py(), table, answers, width, owners)

    hits = (base.groupBy("chunk").applyInArrow(ask_probes, exchange.ASK)
            .groupBy("owner").applyInArrow(lambda t: _answer(t, np.uint32, True), exchange.ANSWER))
    again = (base.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(ask_windows, exchange.ASK)
             .groupBy("owner").applyInArrow(lambda t: _answer(t, np.uint64, False), exchange.ANSWER))
    answers = hits.withColumn("kind", F.lit(0)).unionByName(again.withColumn("kind", F.lit(1)))
    key_type = dict(docs.dtypes)[key]
    done = base.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda table, found: _remove(table, found, width, owners),
        f"_key {key_type}, n_words bigint, n_removed bigint, removed_spans array<bigint>, kept_text string")
    return done.withColumnRenamed("_key", key)

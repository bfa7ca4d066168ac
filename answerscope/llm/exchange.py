"""Ask the owners of keys, without a row per key.

Documents are dealt into chunks of some megabytes. A chunk sends each owner
(a slice of the key space) one row with the sorted distinct keys it holds, and
the owner answers with one bit per key in the same order. Keys are distinct in
a chunk before they are sent, so a key that fills a third of the corpus costs
its owner one entry per chunk. The number of chunks follows the bytes of the
corpus, the number of owners the chunks, so tasks stay of one size. A row goes
from a chunk to an owner only if there are keys to ask for, so there are never
more rows than keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

U64 = np.uint64
CHUNK_BYTES = 2 << 20
ASK = "owner bigint, chunk bigint, keys binary, flags binary"
ANSWER = "chunk bigint, owner bigint, bits binary"


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_chunks(docs: DataFrame, columns: list[str], text: str = "text", key: str = "doc_id") -> tuple[DataFrame, int]:
    """The columns with a chunk number, and the number of owners.

    Runs one job that adds up the bytes of the texts. The chunk is a hash of
    id and text, so missing ids do not meet in one chunk.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = partitions_of(docs)
    chunks = max(parts, size // CHUNK_BYTES + 1)
    return docs.select(*columns, F.pmod(F.xxhash64(key, text), F.lit(chunks)).alias("chunk")), max(parts, chunks // 16)


def owner_keys(hashes: np.ndarray, second: np.ndarray, owners: int, bits: int) -> np.ndarray:
    """``owner << bits | key``; the owner comes from the second hash, so it adds to the key's bits."""
    key = hashes >> U64(64 - bits)
    return ((second % U64(owners)) << U64(bits)) | key


def by_owner(keys: np.ndarray, bits: int, owners: int) -> np.ndarray:
    """Bounds of each owner's part of sorted keys: ``owners + 1`` places."""
    return np.searchsorted(keys, np.arange(owners + 1, dtype=U64) << U64(bits))


def ask_rows(chunk: int, bounds: np.ndarray, keys: list[bytes], flags: list[bytes], names=("owner", "chunk", "keys", "flags")) -> pa.Table:
    owner = np.flatnonzero(np.diff(bounds))
    return pa.table({names[0]: pa.array(owner, pa.int64()), names[1]: pa.array(np.full(len(owner), chunk), pa.int64()),
                     names[2]: pa.array(keys, pa.binary()), names[3]: pa.array(flags, pa.binary())})


def joined_bits(rows: pa.Table, bounds: np.ndarray) -> np.ndarray:
    """The answers to one chunk, put back into the order of its keys."""
    out = np.zeros(bounds[-1], bool)
    for owner, bits in zip(rows.column("owner").to_pylist(), rows.column("bits").to_pylist()):
        a, b = bounds[owner], bounds[owner + 1]
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    return out

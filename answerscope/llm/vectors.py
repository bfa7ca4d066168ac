"""Vectors of embeddings: which are valid, their packed form, and joins on whole vectors.

A vector is valid if it is not null, has the length that most vectors have
(the smaller one on a tie) and holds only finite entries. Inside the operators
it is a binary value, eight bytes an entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .exchange import partitions_of

LARGEST = 1 << 62  # integer entries beyond this are cut to it
HOT_BYTES = 64 << 20  # broadcast at most


def common_length(df: DataFrame, vector: str) -> int:
    """The length of most vectors that are not empty, 0 if there is none (runs a job)."""
    sizes = df.select(F.size(vector).alias("n")).where("n > 0").groupBy("n").count()
    found = sizes.orderBy(F.desc("count"), "n").first()
    return found.n if found else 0


def valid_rows(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the valid vectors in a column of double arrays, and the vectors."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    places = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    values = column.filter(fits).flatten().to_numpy(zero_copy_only=False).reshape(len(places), dim)
    good = np.isfinite(values).all(axis=1)
    return places[good], values[good]


def whole_numbers(values: np.ndarray, scale: int, offset: int = 0) -> np.ndarray:
    """``floor(scale * value) + offset``; beyond ``LARGEST`` the nearest number in reach."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * values)
    return np.clip(scaled, -float(LARGEST), float(LARGEST)).astype(np.int64) + offset


def packed(matrix: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    data = np.ascontiguousarray(matrix)
    width = data.shape[1] * data.itemsize
    offsets = np.arange(len(data) + 1, dtype=np.int64) * width
    big = pa.Array.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return big.cast(pa.binary())


def unpacked(column, dim: int, dtype=np.int64) -> np.ndarray:
    """The rows of a matrix from their binary values."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros((len(column), dim), dtype)
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(dtype).reshape(len(column), dim)


def join_back(rows: DataFrame, groups: DataFrame, on: list[str], count: str, row_bytes: int) -> DataFrame:
    """``rows`` joined with one row per group; ``count`` says how many rows a group has.

    Groups with more rows than an even share of a partition, of which there
    are at most as many as partitions, are broadcast, so their rows stay where they are; all
    other groups are small and are joined by a shuffle.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    share = max(1, total // max(1, min(partitions_of(rows), HOT_BYTES // max(1, row_bytes))))
    large = F.broadcast(groups.where(F.col(count) > share))
    small = groups.where(F.col(count) <= share)
    rest = rows.join(large.select(*on), on, "left_anti").join(small, on)
    return rows.join(large, on).unionByName(rest)

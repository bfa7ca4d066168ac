"""Whitening of embeddings by a covariance in which every distinct vector has a weight.

1. Entries become whole numbers, and rows with identical vectors become one
   row with a count. A vector weighs its count or one.
2. Weighted sums per dimension are exact integers. Tasks multiply their
   vectors, centred first, with themselves (one matrix product a batch) and emit one matrix
   each; Spark adds them up.
3. The eigenvectors of that one small matrix are found on the driver; each
   distinct vector is whitened once.
4. The results are joined back to the rows. The covariance of the whitened
   vectors is measured in the same way as the first one.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..session import ship_package
from .native import stored
from .vectors import common_length, join_back, packed, unpacked, valid_rows, whole_numbers

EXACT = pa.decimal128(38, 0)
CELLS = "i int, j int, v double"


def _exact(values) -> pa.Array:
    """Integers as decimals; those of more than 38 digits as null."""
    return pa.array([Decimal(int(v)) if abs(int(v)) < 10 ** 38 else None for v in values], EXACT)


def _whole(batches, dim: int, scale: int, offset: int):
    for b in batches:
        places, values = valid_rows(b.column("vector"), dim)
        yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(places)), packed(whole_numbers(values, scale, offset))], ["key", "x"])


def _weights(batch, by_count: bool) -> np.ndarray:
    copies = np.asarray(batch.column("copies"))
    return copies if by_count else np.ones(len(copies), np.int64)


def _sums(batches, dim: int, by_count: bool):
    """Per dimension the exact weighted sum of a task's vectors."""
    total, weight = [0] * dim, 0
    for b in batches:
        x, w = unpacked(b.column("x"), dim), _weights(b, by_count)
        weight += int(w.sum())
        if len(x) and float(np.abs(x).max()) * float(w.sum()) >= 2.0 ** 62:
            x, w = x.astype(object), w.astype(object)
        total = [a + int(s) for a, s in zip(total, (x * w[:, None]).sum(axis=0) if len(x) else [])] or total
    yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([weight] * dim, pa.int64()), _exact(total)], ["i", "n", "s"])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n``; the whole part is subtracted from integers, so no digit is lost."""
    base = np.array([s // n for s in sums], np.int64)
    return (x - base).astype(np.float64) - np.array([(s % n) / n for s in sums])


def _cells(product: np.ndarray):
    d = len(product)
    i, j = np.divmod(np.arange(d * d), d)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(product.ravel())], ["i", "j", "v"])


def _products(batches, d: int, rows):
    """The sum of weighted outer products of a task's centred vectors."""
    total = np.zeros((d, d))
    for b in batches:
        centred, w = rows(b)
        total += centred.T @ (centred * w[:, None])
    yield _cells(total)


def _covariance(table: DataFrame, d: int, n: int, rows) -> np.ndarray:
    """Spark adds up the tasks' matrices; the driver gets one of ``d`` times ``d``."""
    parts = table.mapInArrow(lambda it: _products(it, d, rows), CELLS).groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = parts.toArrow()
    out = np.zeros((d, d))
    out[np.asarray(found.column("i")), np.asarray(found.column("j"))] = np.asarray(found.column("v"))
    return out / n


def _deviation(x: np.ndarray, n: int, sums: list[int]):
    """Sum over dimensions of ``(n * x - sums) ** 2``, exact."""
    base, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    far = float(np.abs((x - base).astype(np.float64)).max(initial=0)) * n + float(rest.max(initial=0))
    moved = n * ((x - base) if far * far * x.shape[1] < 2.0 ** 62 else (x.astype(object) - base)) - rest
    return (moved * moved).sum(axis=1)


def _whitened(batches, dim: int, n: int, sums: list[int], axes: np.ndarray):
    for b in batches:
        x = unpacked(b.column("x"), dim)
        z = _centred(x, n, sums) @ axes
        yield pa.RecordBatch.from_arrays([b.column("x"), b.column("copies"), packed(z), _exact(_deviation(x, n, sums))],
                                         ["x", "copies", "z", "deviation"])


def whiten(df: DataFrame, components: int = 16, weights: str = "one", scale: int = 64, offset: int = 1_000_000,
           key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, n, deviation, whitened, explained, identity_error``: one row per valid row of the input.

    An entry ``c`` becomes ``floor(scale * c) + offset``. ``weights`` is ``one``
    (each distinct vector once) or ``count`` (as often as it occurs); ``n`` is the total weight.
    ``whitened`` and ``explained`` are arrays over the components, at most
    ``components`` of them by falling eigenvalue; ``deviation`` is the exact sum over dimensions of
    ``(n * x - S) ** 2`` with S the weighted sums, null beyond 38 digits; ``identity_error`` is one measured value: the
    largest entry of the whitened vectors' covariance minus the identity.

    Rows with a null vector, with null, NaN or infinite entries, or of another
    length than most vectors are left out. Null and repeated keys are kept as
    they are, each row has its own result. Directions without variance (an
    eigenvalue of rounding size) are no components, so a table with one
    distinct vector gives rows with empty arrays and an error of 0, an empty table no
    rows. Equal eigenvalues come in any order. Other columns are not returned, so their names cannot clash.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"weights: {weights}")
    by_count = weights == "count"
    ship_package(df.sparkSession)
    dim = common_length(df, vector)
    given = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    schema = StructType([StructField("key", given.schema["key"].dataType), StructField("x", BinaryType())])
    rows = given.mapInArrow(lambda it: _whole(it, dim, scale, offset), schema)
    fit = stored(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "distinct-vectors")

    found = fit.mapInArrow(lambda it: _sums(it, dim, by_count), "i int, n bigint, s decimal(38,0)")
    found = sorted(found.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).collect())
    n, sums = (int(found[0].n), [int(r.s) for r in found]) if found else (0, [])
    if n:
        v = _covariance(fit, dim, n, lambda b: (_centred(unpacked(b.column("x"), dim), n, sums), _weights(b, by_count)))
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        order = np.argsort(-values)[:components]
        order = order[values[order] > values.max() * dim * np.finfo(float).eps * 4]
        axes, explained = vectors[:, order] / np.sqrt(values[order]), values[order] / max(np.trace(v), np.finfo(float).tiny)
    else:
        n, sums, axes, explained = 1, [0] * dim, np.zeros((dim, 0)), np.zeros(0)

    k = axes.shape[1]
    white = stored(fit.mapInArrow(lambda it: _whitened(it, dim, n, sums, axes), "x binary, copies bigint, z binary, deviation decimal(38,0)"), "whitened")
    error = 0.0
    if k:
        def weighed(b):
            return unpacked(b.column("z"), k, np.float64), _weights(b, by_count)

        def totals(batches):
            total = np.zeros(k)
            for b in batches:
                z, w = weighed(b)
                total += w @ z
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], ["i", "s"])

        means = white.mapInArrow(totals, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
        mean = np.array([r.s for r in means]) / n
        measured = _covariance(white, k, n, lambda b: (weighed(b)[0] - mean, weighed(b)[1]))
        error = float(np.abs(measured - np.eye(k)).max())

    def opened(batches):
        for b in batches:
            z = unpacked(b.column("z"), k, np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * k, pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("deviation"), lists], ["key", "deviation", "whitened"])

    joined = join_back(rows, white, ["x"], "copies", dim * 8 + k * 8 + 64).select("key", "deviation", "z")
    out = StructType([schema["key"], *StructType.fromDDL("deviation decimal(38,0), whitened array<double>")])
    return joined.mapInArrow(opened, out).select(
        F.col("key").alias(key), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(float(e)) for e in explained]).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))

"""Column helpers that several operators share; JVM expressions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGITS_52 = 13  # hexadecimal digits that a double holds exactly


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def row_key(*columns) -> list[Column]:
    """Two 64-bit hashes of a row's columns; rows with the same values share them."""
    return [F.xxhash64(*columns).alias("r1"), F.xxhash64(F.lit("second"), *columns).alias("r2")]


def unit_draw(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, the same on every engine."""
    joined = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, DIGITS_52), 16, 10).cast("double") / float(16 ** DIGITS_52)


def apart(docs: DataFrame, used: list[str], made: tuple[str, ...], run) -> DataFrame:
    """``run`` on the columns that it uses; all others go along as one struct under a new name, so no name can clash.

    Returns the columns of ``docs`` in their order, without those that ``run`` makes, then these.
    """
    used = list(dict.fromkeys(used))
    rest = [c for c in docs.columns if c not in used]
    order = [c for c in docs.columns if c not in made]
    if not rest:
        return run(docs).select(*order, *made)
    own = f"rest_{uuid.uuid4().hex}"
    packed = docs.select(*used, F.struct(*[F.col(f"`{c}`") for c in rest]).alias(own))
    return run(packed).select(*[F.col(c) if c in used else F.col(own)[c].alias(c) for c in order], *made)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends, and its size is known."""
    from ..session import scratch_path

    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

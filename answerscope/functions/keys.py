"""Fixed-width keys, so that shuffles carry 32 bytes and not whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PAIR_KEY = "pair_key"
ROW_KEY = "row_id"


def pair_key(question: Column, context: Column) -> Column:
    """SHA-256 of a (question, context) pair as 32 bytes.

    The length prefix keeps ("ab", "c") and ("a", "bc") apart. A pair with a
    null side has a key too, with a zero byte before it (see ``is_complete``).
    """
    def side(text: Column) -> Column:
        return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    digest = F.unhex(F.sha2(F.concat(side(question), F.lit("|"), side(context)), 256))
    whole = question.isNotNull() & context.isNotNull()
    return F.when(whole, digest).otherwise(F.concat(F.lit(b"\x00"), digest))


def pair_of(df: DataFrame) -> Column:
    """The stored key column if the table has one, so that no text is read; else the key itself."""
    return F.col(PAIR_KEY) if PAIR_KEY in df.columns else pair_key(F.col("question"), F.col("context"))


def row_of(df: DataFrame) -> Column:
    """What tells an input row from all others, never null.

    Tables written by a run have it as a column, made once when the shards were
    loaded. Elsewhere it is the id together with the pair, since ids may be
    missing or come from several shards.
    """
    if ROW_KEY in df.columns:
        return F.col(ROW_KEY)
    named = F.coalesce(F.col("_id").cast("string"), F.lit("")) if "_id" in df.columns else F.lit("")
    return F.concat_ws("|", named, pair_id(pair_of(df)))


def with_row(df: DataFrame) -> DataFrame:
    return df.withColumn("_row", row_of(df))


def is_complete(key: Column) -> Column:
    """Whether both sides of the pair are present."""
    return F.octet_length(key) == 32


def pair_id(key: Column) -> Column:
    """Printable form of a pair key."""
    return F.lower(F.hex(key))


def answer_key(answer: Column) -> Column:
    """SHA-256 of an answer as 32 bytes; null stays null."""
    return F.unhex(F.sha2(answer, 256))


def seeded_order(seed: int, *parts: Column) -> Column:
    """Reproducible stand-in for a seeded random order: sort by this string."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))

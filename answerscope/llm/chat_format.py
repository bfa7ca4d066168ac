"""Logged chats: snapshots that a longer log continues are dropped, the rest are rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .native import stored

BLOCK = 256  # turns per block: no task needs more turns of one conversation in order at once
# The names of roles in the rendered text.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "bot": "assistant", "gpt": "assistant",
         "system": "system", "tool": "tool"}


def _content() -> list:
    """Two hashes of a turn's role and text; they also order turns that share a number."""
    parts = (F.coalesce("role", F.lit("\0")), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    return [F.xxhash64(*parts).alias("c1"), F.xxhash64(F.lit("second"), *parts).alias("c2")]


def _turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
                        F.col(role).alias("role"), F.col(text).alias("text")).where(F.col("conv_id").isNotNull())
    return rows.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))


def turn_prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """Every distinct turn's rank and the rolling hash of all turns up to it; no text is shuffled.

    The hash is a sum over ranks, so it is added up in two steps: within
    blocks of the turn number, and over the blocks of a conversation. Rows:
    ``conv_id, rank, h1, h2``. Repeated rows count once; turns with one number
    are ordered by the hash of role and text, null numbers come first.
    """
    rows = _turns(turns, conv, turn, role, text).select("conv_id", "block", "turn", *_content()).distinct()
    within = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "c1", "c2")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.row_number().over(within))
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rows = rows.join(starts, ["conv_id", "block"]).withColumn("rank", F.col("start") + F.col("place"))
    # Sums of 52-bit numbers as decimals: no overflow however long the conversation.
    rows = rows.withColumns({t: F.shiftrightunsigned(F.xxhash64(F.lit(t), "rank", "c1", "c2"), 12).cast("decimal(38,0)")
                             for t in ("t1", "t2")})
    sums = rows.groupBy("conv_id", "block").agg(*[F.sum(t).cast("decimal(38,0)").alias(f"s{t}") for t in ("t1", "t2")])
    zero = F.lit(0).cast("decimal(38,0)")
    carried = sums.select("conv_id", "block", *[F.coalesce(F.sum(f"s{t}").over(before).cast("decimal(38,0)"), zero).alias(f"b{t}")
                                                for t in ("t1", "t2")])
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(carried, ["conv_id", "block"])
    return rows.select("conv_id", "rank", *[(F.sum(t).over(running) + F.col(f"b{t}")).cast("decimal(38,0)").alias(h)
                                            for t, h in (("t1", "h1"), ("t2", "h2"))])


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies``: one conversation of each that no longer one continues.

    Equal conversations are first collapsed to the smallest id; those whose
    whole hash is a proper prefix of another are anti-joined away.
    """
    last = prefixes.groupBy("conv_id").agg(F.max("rank").alias("n_turns"))
    marked = prefixes.join(last, "conv_id")
    whole = (marked.where(F.col("rank") == F.col("n_turns")).groupBy("n_turns", "h1", "h2")
             .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")))
    proper = marked.where(F.col("rank") < F.col("n_turns")).select(F.col("rank").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(proper, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "copies")


def chat_format(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """Render the maximal conversations, one row for each block of up to 256 turn numbers.

    Returns ``conv_id, part, n_turns, copies, part_turns, rendered``: ``part``
    counts a conversation's rows from 0, so a conversation of any length never
    meets in one row; joined in order the parts are the whole chat. Roles are
    mapped to ``ROLES`` (others are kept in lower case, null is ``unknown``), a
    null text is empty. Rows without ``conv_id`` belong to no conversation and
    are left out. An empty table gives an empty result; extra columns are not
    read.
    """
    hashes = stored(turn_prefixes(turns, conv, turn, role, text), "turn-prefixes")
    chosen = stored(maximal_conversations(hashes), "conversations")
    rows = _turns(turns, conv, turn, role, text).select("conv_id", "block", "turn", *_content(), "role", "text")
    name = F.lower(F.coalesce("role", F.lit("unknown")))
    mapped = F.coalesce(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[name], name)
    said = F.concat(F.lit("<|im_start|>"), mapped, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    entry = F.struct("turn", "c1", "c2", said.alias("said"))
    parts = (rows.join(chosen, "conv_id").groupBy("conv_id", "n_turns", "copies", "block")
             .agg(F.sort_array(F.collect_set(entry)).alias("entries")))
    order = Window.partitionBy("conv_id").orderBy("block")
    return parts.select("conv_id", (F.row_number().over(order) - 1).cast("bigint").alias("part"),
                        F.col("n_turns").cast("bigint").alias("n_turns"), "copies",
                        F.size("entries").cast("bigint").alias("part_turns"),
                        F.array_join(F.transform("entries", lambda e: e["said"]), "").alias("rendered"))

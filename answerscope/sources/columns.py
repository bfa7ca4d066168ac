"""Bring the columns of inputs and results to the canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import ROW_KEY, pair_id, pair_key
from ..functions.statistics import to_number
from ..functions.text import char_count, word_overlap
from ..schema import CSV_NULL_TOKENS, REQUIRED_RESULT_COLUMNS, RESULT_ALIASES
from ..session import scratch_path


def normalize_input(df: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Give an input table the columns ``question`` and ``context``.

    ``query`` and ``text`` are taken if either is missing. With ``fuzzy`` any
    column whose name contains text/context or query/question will do; of
    several candidates the last one wins, as in a left-to-right rename.
    Raises ``ValueError`` when a column is still missing.
    """
    if {"question", "context"} <= set(df.columns):
        return df
    if {"query", "text"} <= set(df.columns):
        return df.drop("question", "context").withColumnsRenamed({"query": "question", "text": "context"})
    if fuzzy:
        context = [c for c in df.columns if "text" in c.lower()]
        question = [c for c in df.columns if c not in context and ("query" in c.lower() or "question" in c.lower())]
        if context and question:
            renames = {context[-1]: "context", question[-1]: "question"}
            stale = [c for c in ("question", "context") if c in df.columns and c not in renames]
            return df.drop(*stale).withColumnsRenamed(renames)
    raise ValueError(f"no question/context (or query/text) columns among {df.columns}")


def result_aliases(columns) -> dict[str, str]:
    """Canonical name -> the column that carries it, ignoring case."""
    by_lower = {c.lower(): c for c in columns}
    found = {}
    for canonical, names in RESULT_ALIASES.items():
        hit = next((by_lower[n] for n in names if n in by_lower), None)
        if hit is not None:
            found[canonical] = hit
    return found


def normalize_results(df: DataFrame) -> DataFrame:
    """Results under canonical names, numbers as doubles, overlap present.

    Raises ``ValueError`` that lists the required columns that are missing.
    """
    found = result_aliases(df.columns)
    missing = [c for c in REQUIRED_RESULT_COLUMNS if c not in found]
    if missing:
        raise ValueError(f"required columns missing: {', '.join(missing)}")
    taken = set(found.values())
    out = df.select(
        *[F.col(f"`{source}`").alias(name) for name, source in found.items()],
        *[F.col(f"`{c}`") for c in df.columns if c not in taken and c.lower() not in found],
    )
    out = out.withColumn("score", to_number(F.col("score")))
    if "_id" not in out.columns:
        # Analyses order and match rows by an id; the pair is the best there is.
        out = out.withColumn("_id", pair_id(pair_key(F.col("question"), F.col("context"))))
    if "overlap" in found:
        return out.withColumn("overlap", to_number(F.col("overlap")))
    return out.withColumn("overlap", word_overlap(F.col("answer"), F.col("context")))


def annotate(df: DataFrame) -> DataFrame:
    """Add ``overlap``, ``context_length`` and ``question_length``.

    A missing answer column counts as null, missing texts as empty.
    """
    defaults = {"answer": F.lit(None).cast("string"), "context": F.lit(""), "question": F.lit("")}
    absent = {c: v for c, v in defaults.items() if c not in df.columns}
    if absent:
        df = df.withColumns(absent)
    return df.withColumns({
        "overlap": word_overlap(F.col("answer"), F.col("context")),
        "context_length": char_count(F.col("context")),
        "question_length": char_count(F.col("question")),
    })


def with_row_id(df: DataFrame, prefix: str = "") -> DataFrame:
    """Number the rows as ``row_id``; ``_id`` stays as it is, and is that number where it is missing.

    The numbers follow the partitions, so store them before they are used twice.
    """
    numbered = df.withColumn(ROW_KEY, F.concat(F.lit(prefix), F.monotonically_increasing_id().cast("string")))
    known = F.col("_id").cast("string") if "_id" in df.columns else F.lit(None).cast("string")
    return numbered.withColumn("_id", F.coalesce(known, F.col(ROW_KEY)))


def null_tokens_to_null(df: DataFrame, columns=None) -> DataFrame:
    """Turn the CSV spellings of "missing" into nulls."""
    columns = [c for c in (columns or df.columns) if dict(df.dtypes)[c] == "string"]
    return df.withColumns({
        c: F.when(~F.col(f"`{c}`").isin(*CSV_NULL_TOKENS), F.col(f"`{c}`")) for c in columns
    })


def head_rows(df: DataFrame, count: int, order=("_shard", "_id")) -> DataFrame:
    """The first ``count`` input rows in a stated order (CSV has none of its own).

    Nulls come first. Rows with equal keys follow two hashes of all columns;
    rows equal in those count as copies of one row. The last row that is wanted is found on keys and
    hashes alone, in one job (see ``_last_wanted``), and the result is a filter against
    it, so texts are read once and never shuffled. Copies of that last row, of which
    only some may be wanted, are made from one of them. A count of 0 or less gives no row.
    """
    keys = [c for c in order if c in df.columns]
    place = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)], *_row_hashes(df).values())
    last = _last_wanted(df.select(place.alias("place")), count)
    if last is None:
        return df
    own = [F.col(f"`{c}`") for c in df.columns]
    bound = last.select("place").scalar()
    before = df.where((place < bound) & F.lit(count > 0)).select(*own)
    copies = _times(df.where(place == bound).limit(1).select(F.struct(*own).alias("row")), last.select("copies").scalar())
    return before.unionByName(copies.select("row.*"))


COPIES_PER_ROW = 1 << 16  # one row is multiplied in two steps of at most this many copies each


def _row_hashes(df: DataFrame) -> dict[str, Column]:
    columns = [F.col(f"`{c}`") for c in df.columns]
    return {"h1": F.xxhash64(*columns).alias("h1"), "h2": F.xxhash64(F.lit("second"), *columns).alias("h2")}


def _last_wanted(places: DataFrame, count: int) -> DataFrame | None:
    """One row: the place of the last wanted row and its wanted copies; None if there are no more rows than wanted.

    Equal places are counted before they are shuffled, so a repeated row is one row. The counts are cut into ranges
    and written; sums per range, one small row each, tell the range where ``count`` is reached,
    and the rows of that range alone are added up one by one.
    """
    spark = places.sparkSession
    path = scratch_path(spark, "places")
    counted = places.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = counted.repartitionByRange(parts, "place").withColumn("part", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    upto = Window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranged.groupBy("part").agg(F.sum("n").alias("n"), F.min("place").alias("least"))
    ends = sums.withColumn("end", F.sum("n").over(upto.orderBy("least")))
    wanted = max(count, 1)
    reached = ends.where(F.col("end") >= wanted).orderBy("end").limit(1).select("part", (F.col("end") - F.col("n")).alias("below")).first()
    if reached is None:
        return None
    end = F.sum("n").over(upto.orderBy("place")) + F.lit(reached["below"])
    inside = ranged.where(F.col("part") == reached["part"]).withColumn("end", end)
    start = F.col("end") - F.col("n")
    last = inside.where((F.col("end") >= wanted) & (start < wanted)).select(
        "place", F.greatest(F.lit(count) - start, F.lit(0)).cast("long").alias("copies"))
    last.write.parquet(f"{path}-last")
    return spark.read.schema(last.schema).parquet(f"{path}-last")


def _times(one: DataFrame, copies: Column) -> DataFrame:
    """A single row ``row`` as often as ``copies`` says, made by many tasks if that is often."""
    batch = F.lit(COPIES_PER_ROW)
    some = one.withColumn("copies", copies)
    batches = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / batch)),
                          lambda i: F.least(batch.cast("long"), F.col("copies") - i * batch))
    spread = some.where("copies > 0").select("row", F.posexplode(batches).alias("batch", "size")).repartition("batch")
    return spread.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size")))).select("row")

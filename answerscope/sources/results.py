"""Stored runs: find the latest one, read it, and read run ids as times."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import CONSOLIDATED_COLUMNS, CONSOLIDATED_SCHEMA
from .columns import normalize_results, null_tokens_to_null

RUN_ID_PATTERN = r"^\d{8}_\d{6}$"
RESULTS_STEM = "results_consolidated"


def run_time(run_id: Column) -> Column:
    """Timestamp of a run id ``yyyyMMdd_HHmmss``, null if it is none."""
    shaped = F.when(run_id.rlike(RUN_ID_PATTERN), run_id)
    return F.try_to_timestamp(shaped, F.lit("yyyyMMdd_HHmmss"))


def run_label(run_id: Column) -> Column:
    """``dd/MM/yyyy - HH:mm:ss`` of a run id; an invalid id stays as it is."""
    return F.coalesce(F.date_format(run_time(run_id), "dd/MM/yyyy - HH:mm:ss"), run_id)


def latest_run(df: DataFrame, column: str = "run_id") -> DataFrame:
    """Rows of the newest well-formed run id.

    The maximum is a scalar subquery, so on a table partitioned by run id
    only the newest partition is read for the rows.
    """
    newest = df.where(F.col(column).rlike(RUN_ID_PATTERN)).agg(F.max(column)).scalar()
    return df.where(F.col(column) == newest)


def find_latest_results(spark: SparkSession, root: str) -> str | None:
    """Path of the newest stored result, or None (runs small listing jobs).

    Order of preference: the highest folder named like a run id, with
    ``.csv.gz`` before ``.csv``; then the most recently written result one
    folder down; then the most recent uncompressed result at any depth. The
    write time of a result stands for that of its folder.
    """
    root = root.rstrip("/")
    name = rf"/({RESULTS_STEM}\.csv(\.gz)?)(/|$)"
    for pattern in (f"{root}/*/{RESULTS_STEM}.csv*", root):
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        # A result is a file of that name, or a folder of that name with part files.
        found = files.where(F.regexp_count("path", F.lit(name)) > 0).select(
            F.concat(F.regexp_extract("path", rf"^(.*?){name}", 1), F.lit("/"), F.regexp_extract("path", name, 1))
            .alias("result"), "modificationTime")
        packed = F.col("result").endswith(".gz")
        folder = F.element_at(F.split("result", "/"), -2)
        run = F.when(folder.rlike(RUN_ID_PATTERN), folder)
        if pattern == root:
            found = found.where(~packed)
            order = [F.desc("modificationTime"), F.col("result")]
        else:
            order = [run.desc_nulls_last(), F.when(run.isNotNull(), packed).desc_nulls_last(),
                     F.desc("modificationTime"), packed.desc(), F.col("result")]
        best = found.orderBy(*order).select("result").first()
        if best is not None:
            return root + best.result.split(root.split(":")[-1], 1)[1]
    return None


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    """A consolidated result under canonical names and types.

    Parquet is read as it is. CSV (plain or gzip, told by the extension) is
    read as text, missing-value tokens become null, numbers are parsed with
    anything else as null. CSV columns are taken by their own header. A
    ``.csv`` that is absent is looked for as ``.csv.gz``.
    """
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        options = dict(header="true", multiLine="true", quote='"', escape='"',
                       ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
        reader = spark.read.options(**options)
        try:
            raw = reader.csv(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND" or path.endswith(".gz"):
                raise
            raw = reader.csv(f"{path}.gz")
        raw = null_tokens_to_null(raw)
        typed = normalize_results(raw)
        lengths = [c for c in ("context_length", "question_length") if c in typed.columns]
        return typed.withColumns({c: F.col(c).try_cast("int") for c in lengths})
    return normalize_results(spark.read.parquet(path))


def ordered_projection(df: DataFrame, *more: str) -> DataFrame:
    """The consolidated columns in their fixed order and types; absent ones are left out."""
    kinds = {f.name: f.dataType for f in CONSOLIDATED_SCHEMA}
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in CONSOLIDATED_COLUMNS if c in df.columns], *more)

"""CSV shards: find, select, read, tag and union.

A shard is either one ``*.csv`` file in a flat folder or one partition folder
``_shard=<name>``, which may hold many files. Both give the column ``_shard``.
"""

from __future__ import annotations

import csv
import fnmatch
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .columns import null_tokens_to_null

_PARTITION = r"/_shard=([^/]+)/"
_EXTRA = "_surplus_field"
DEFAULT_SHARD = "shard_055"  # fixed value
CSV_READ_OPTIONS = {
    "header": "true", "multiLine": "true", "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    "enforceSchema": "true", "mode": "PERMISSIVE",
}


def shard_name(path: Column) -> Column:
    """Shard of a file path: its ``_shard=`` folder, else its file name."""
    folder = F.regexp_extract(path, _PARTITION, 1)
    return F.when(folder != "", _decoded(folder)).otherwise(F.element_at(F.split(path, "/"), -1))


def file_shard() -> Column:
    """Shard of the file a row was read from."""
    return shard_name(_decoded(F.col("_metadata.file_path")))


def _decoded(path: Column) -> Column:
    """Undo the percent-encoding of metadata paths and partition folders."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of all shards: ``_shard, path, length``; file contents are not read.

    A file of no bytes gives no row in a scan, so it is found in the listing,
    which the driver holds for any scan.
    """
    out = spark.createDataFrame([], "_shard string, path string, length long")
    for pattern in (f"{folder}/*.csv", f"{folder}/_shard=*/*.csv"):
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found = files.select("path", "length")
        listed = spark.createDataFrame([(p,) for p in files.inputFiles()], "path string").select(_decoded(F.col("path")).alias("path"))
        empty = listed.join(found, "path", "left_anti").withColumn("length", F.lit(0).cast("long"))
        # A partition folder may itself end in .csv; its files match the second pattern only.
        in_folder = F.regexp_extract("path", _PARTITION, 1) != ""
        files = found.unionByName(empty).where(in_folder if "_shard=" in pattern else ~in_folder)
        out = out.unionByName(files.select(shard_name(F.col("path")).alias("_shard"), "path", "length"))
    return out


def shard_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Shards in name order with their file count and size."""
    return (shard_files(spark, folder).groupBy("_shard")
            .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
            .orderBy("_shard"))


def selection_filter(selection, column: str = "_shard") -> Column:
    """Row predicate for ``"all"``, a glob, or a list of names and globs.

    ``"all"`` inside a list selects everything; an empty selection nothing.
    """
    if not selection:
        return F.lit(False)
    items = [selection] if isinstance(selection, str) else list(selection)
    if "all" in items:
        return F.lit(True)
    names = [i for i in items if not re.search(r"[*?\[]", i)]
    globs = [i for i in items if i not in names]
    chosen = F.col(column).isin(*names) if names else F.lit(False)
    for glob in globs:
        chosen = chosen | F.col(column).rlike(glob_to_regex(glob))
    return chosen


def glob_to_regex(glob: str) -> str:
    """Anchored Java pattern for a shell glob."""
    body = fnmatch.translate(glob)
    body = re.sub(r"^\(\?s:(.*)\)\\[Zz]$", r"\1", body, flags=re.S)
    return f"(?s)^{body}$"


def stem(column: str = "_shard") -> Column:
    """Shard name without ``.csv``."""
    return F.regexp_replace(F.col(column), r"\.csv$", "")


def with_suffix(name: str = DEFAULT_SHARD) -> str:
    """``shard_055`` and ``shard_055.csv`` name the same shard."""
    return name if name.endswith(".csv") else f"{name}.csv"


def shard_stems(df: DataFrame, glob: str = "shard_*.csv") -> DataFrame:
    """Distinct stems of the shards whose name matches ``glob``, in order."""
    return (df.where(selection_filter(glob)).select(stem().alias("stem"))
            .distinct().orderBy("stem"))


def shard_exists(spark: SparkSession, folder: str, name: str = DEFAULT_SHARD) -> bool:
    """Whether a shard of that stem or name is present (runs a small job)."""
    hits = shard_files(spark, folder).where(F.col("_shard") == with_suffix(name))
    return not hits.isEmpty()


def _headers(spark: SparkSession, paths: list[str]) -> list:
    """Group files by their header line (runs a job; one task per file).

    A session of its own puts every file into a partition of its own, and
    each task stops after the first rows, so no file is read whole.
    """
    probe = spark.newSession()
    probe.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 50))
    probe.conf.set("spark.sql.files.openCostInBytes", str(1 << 50))
    probe.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")

    def first_row(batches):
        for batch in batches:
            yield batch.slice(0, 1)
            return

    lines = (probe.read.text(paths)
             .select(_decoded(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("header"))
             .mapInArrow(first_row, "path string, header string"))
    return lines.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect()


def _field_names(header: str) -> list[str]:
    return next(csv.reader([header.lstrip("\N{ZERO WIDTH NO-BREAK SPACE}")]))


def load_shards(spark: SparkSession, folder: str, selection="all", skip_bad: bool = True) -> DataFrame:
    """Selected shards as one table of strings, tagged with ``_shard``.

    Files are read once per distinct header, so differing column orders are
    united by name and absent columns become null. Quoted line breaks are
    kept. With ``skip_bad`` a shard with a row of too many fields is left out
    whole, all its files; ``skipped_shards`` lists such shards. Runs one job for
    the headers and one that parses every file once into the shared folder.
    """
    return load_and_check(spark, folder, selection)[0] if skip_bad else _parsed(spark, folder, selection).drop(_EXTRA)


def load_and_check(spark: SparkSession, folder: str, selection="all") -> tuple[DataFrame, DataFrame]:
    """The good shards as by ``load_shards``, and the shards left out: ``_shard, bad_rows``.

    A shard of no bytes has nothing to load; it is listed with 0 bad rows.
    """
    parsed = _parsed(spark, folder, selection)
    path = scratch_path(spark, "parsed-shards")
    parsed.write.parquet(path)
    stored = spark.read.schema(parsed.schema).parquet(path)
    # Reads the marker and the shard alone.
    bad = stored.where(F.col(_EXTRA).isNotNull()).groupBy("_shard").agg(F.count(F.lit(1)).alias("bad_rows"))
    empty = (shard_files(spark, folder).where(selection_filter(selection)).groupBy("_shard").agg(F.sum("length").alias("n"))
             .where("n = 0").select("_shard", F.lit(0).cast("long").alias("bad_rows")))
    return stored.join(bad, "_shard", "left_anti").select(*[c for c in parsed.columns if c != _EXTRA]), bad.unionByName(empty)


def skipped_shards(spark: SparkSession, folder: str, selection="all") -> DataFrame:
    """Shards ``load_shards`` leaves out: ``_shard, bad_rows``."""
    return load_and_check(spark, folder, selection)[1]


def _parsed(spark: SparkSession, folder: str, selection) -> DataFrame:
    out = None
    for names, paths in _selected_groups(spark, folder, selection):
        part = _read_group(spark, names, paths)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], f"_shard string, {_EXTRA} string")


def _selected_groups(spark, folder, selection):
    files = shard_files(spark, folder).where(selection_filter(selection))
    paths = [r.path for r in files.where("length > 0").select("path").orderBy("path").collect()]
    if not paths:
        return []
    return [(_field_names(r.header), r.paths) for r in _headers(spark, paths)]


def _read_group(spark: SparkSession, names: list[str], paths: list[str]) -> DataFrame:
    columns = [n for n in names if n != "_shard"]
    schema = ", ".join(f"`{n}` string" for n in [*names, _EXTRA])
    raw = spark.read.schema(schema).options(**CSV_READ_OPTIONS).csv(paths)
    tagged = raw.select(*[F.col(f"`{c}`") for c in columns], _EXTRA, file_shard().alias("_shard"))
    return null_tokens_to_null(tagged, columns)

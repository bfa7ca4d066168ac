"""Consolidated results, metrics documents and exports.

Outputs are folders of part files, as Spark writes them; the result table is
never gathered. Only reports of a few rows are written by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..functions.keys import PAIR_KEY, ROW_KEY, pair_of
from ..operators.compare import summary_columns, wide_compare
from ..operators.distributions import CORRELATED, correlation_matrix
from ..session import REPEATED_TEXTS
from ..sources.results import RESULTS_STEM, ordered_projection

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_predictions(df: DataFrame, table: str, run_id: str, batch: int = 0) -> None:
    """Store a run, or one batch of a streamed run, as a partition of ``table``.

    Writing the same batch again replaces it, so a repeated job leaves one copy.
    The key of the (question, context) pair is stored beside the columns, so
    that agreement and disagreement read 32 bytes per row and no text, and so
    is the row id that tells input rows apart.
    """
    keyed = df.withColumn(PAIR_KEY, pair_of(df))
    rows = [ROW_KEY] if ROW_KEY in df.columns else []
    stored = ordered_projection(keyed, PAIR_KEY, *rows).withColumns({"run_id": F.lit(run_id), "batch": F.lit(batch)})
    (stored.write.mode("overwrite").options(**REPEATED_TEXTS)
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "batch").parquet(table))


def write_results_csv(df: DataFrame, run_folder: str, gzip: bool = False, rows_per_file: int = 1_000_000) -> str:
    """Export a run as CSV; with gzip the files are bounded, as they cannot be split."""
    path = f"{run_folder}/{RESULTS_STEM}.csv{'.gz' if gzip else ''}"
    options = {**CSV_OPTIONS, "maxRecordsPerFile": str(rows_per_file)}
    if gzip:
        options["compression"] = "gzip"
    ordered_projection(df).write.mode("overwrite").options(**options).csv(path)
    return path


def write_shards(df: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Write inputs as CSV shards, one folder per ``_shard``.

    Rows are brought together by shard, so that a task writes few files;
    adaptive execution splits a shard that is large into several tasks.
    """
    (df.hint("rebalance", "_shard").write.mode(mode).partitionBy("_shard").options(**CSV_OPTIONS).csv(folder))


def metrics_json(document: DataFrame) -> DataFrame:
    """The nested metrics document as one JSON text; nulls are written."""
    whole = F.struct(*document.columns)
    return document.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("value"))


def write_metrics_json(document: DataFrame, path: str) -> None:
    metrics_json(document).coalesce(1).write.mode("overwrite").text(path)


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def document_models(document: DataFrame) -> DataFrame:
    """The per-model part of a metrics document as rows."""
    return document.select(F.explode("per_model").alias("model", "s")).select("model", "s.*")


def summary_lines(document: DataFrame, digits: int | None = None) -> DataFrame:
    """Lines ``ord, line`` of the Markdown summary of a metrics document: overall, then each model.

    ``digits`` rounds the means; without it they are written in full.
    """
    def number(name: str) -> Column:
        return _shown(F.col(name) if digits is None else F.round(name, digits))

    def block(source: DataFrame, major: Column, lines) -> DataFrame:
        return source.select(major.alias("_major"), F.posexplode(F.array(*lines)).alias("_minor", "line"))

    title = F.lit("# Metrics Summary")
    top = block(document.select("overall.*"), F.lit(""), [
        title, F.lit(""), F.lit("## Overall"),
        F.concat(F.lit("- total_predictions: "), _shown(F.col("total_predictions"))),
        F.concat(F.lit("- avg_overlap: "), number("avg_overlap")),
        F.lit(""), F.lit("## Per Model")])
    models = block(document_models(document), F.concat(F.lit("m"), F.col("model")), [
        F.concat(F.lit("### "), F.col("model")),
        F.concat(F.lit("- count: "), _shown(F.col("count"))),
        *[F.concat(F.lit(f"- {c}: "), number(c)) for c in ("mean_score", "median_score", "avg_overlap")]])
    both = top.unionByName(models)
    order = F.row_number().over(_by_position())
    return both.select(order.alias("ord"), "line")


def _by_position():
    # Seven lines and five per model: a report, not data.
    return Window.orderBy("_major", "_minor")


def write_summary(document: DataFrame, path: str) -> None:
    summary_lines(document).orderBy("ord").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_per_model_csv(document: DataFrame, path: str) -> None:
    (document_models(document).select("model", "count", "mean_score", "median_score", "avg_overlap")
     .orderBy("model").coalesce(1).write.mode("overwrite").options(**CSV_OPTIONS).csv(path))


def write_wide(df: DataFrame, a: str, b: str, folder: str) -> None:
    """The wide comparison as CSV and its summary, taken while the rows are written, as text."""
    seen = Observation()
    wide = wide_compare(df, a, b, with_text=True).observe(seen, *summary_columns(a, b))
    wide.write.mode("overwrite").options(**CSV_OPTIONS).csv(f"{folder}/wide.csv")
    found = seen.get
    kinds = ", ".join(f"`{c}` {'double' if c.startswith('mean_') else 'bigint'}" for c in found)
    summary = df.sparkSession.createDataFrame([tuple(found.values())], kinds)
    lines = summary.select(F.explode(F.array(*[
        F.concat(F.lit(f"{c}: "), _shown(F.col(f"`{c}`"))) for c in summary.columns])).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(f"{folder}/metadata.txt")


def write_correlation_csv(df: DataFrame, path: str) -> None:
    """The correlation matrix as a square table."""
    cells = correlation_matrix(df)
    order = {n: i for i, n in enumerate(c for c in CORRELATED if c in df.columns)}
    rank = F.create_map(*[F.lit(x) for n, i in order.items() for x in (n, i)])
    square = cells.groupBy("var1").agg(*[F.max(F.when(F.col("var2") == n, F.col("r"))).alias(n) for n in order])
    (square.orderBy(rank[F.col("var1")]).withColumnRenamed("var1", "metric")
     .coalesce(1).write.mode("overwrite").options(**CSV_OPTIONS).csv(path))

"""The corpus pipeline over ``documents``: clean, remove common lines, near copies and leaks, then mix sources.

Each stage takes what the one before kept, written as Parquet and read again;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from answerscope.llm import decontamination, line_dedup, mixing, near_dedup, quality_rules
from answerscope.llm.native import stored


def _with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns, with a new text and its length."""
    new = {"text": F.col(text).alias("text"), "n_chars": F.length(text).cast("bigint").alias("n_chars")}
    return docs.select(*[new.get(c, F.col(c)) for c in columns])


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go from the texts, documents that lose too much go as a whole."""
    return _with_text(quality_rules.quality_rules(docs).where("kept"), docs.columns, "clean_text")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go from all of them; every document stays."""
    return _with_text(line_dedup.line_dedup(docs, least=10), docs.columns, "kept_text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles, the one with the smallest id stays.

    Exactly one row of a group stays, also where rows share an id or have none: such
    tables are numbered first, and ids only order the rows of a group, null ids last.
    Rows without words are no copies of each other and all stay.
    """
    unclear = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 or doc_id is null")
    if unclear.isEmpty():
        return near_dedup.near_dedup(docs, shingle=5, percent=80).where("kept").select(*docs.columns)
    number = f"number_{uuid.uuid4().hex}"
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "pipeline-numbered")
    found = near_dedup.near_dedup(numbered, shingle=5, percent=80, key=number)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", number)).alias("first")
    chosen = stored(found.groupBy("component_id").agg(first).select(f"first.{number}"), "pipeline-chosen")
    return numbered.join(chosen, number, "left_semi").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed by the square root of their sizes; each copy is a row."""
    return mixing.mix_sources(docs, weights=0.5, seed=9)


STAGES = [("quality rules", clean_lines), ("line dedup", drop_common_lines), ("near dedup", drop_near_copies),
          ("decontamination", drop_leaks), ("mixing", mix)]
# Near copies need connected components over similarities of sets; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

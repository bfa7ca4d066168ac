"""Question-answering inputs and stand-in predictions from the document tables.

Every document is a context; the question is the benchmark item its id maps
to, null if there is none. Three rule-based predictors take the place of
neural ones, so that all analytics run on whole tables and whole texts:

* ``lead``    the first sentence of the context;
* ``lexical`` the sentence sharing most question words, the first on ties;
* ``echo``    the question itself with a pseudo-score, missing where ``_id``
  is a multiple of 13.

A score is the share of the question's distinct words found in the answer,
null for a question without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import PAIR_KEY, ROW_KEY, pair_key
from ..functions.text import BLANK_RUN, char_count, distinct_words, share_found, words_in_answers

STAND_IN_MODELS = ("lead", "lexical", "echo")
SENTENCE_END = r"[.\n]+\s*"


def qa_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input rows ``_id, row_id, title, context, question, _shard``.

    A file too small to fill the cores is spread over them; larger tables are
    read as they lie. No document is lost if item ids have gaps.
    The side to broadcast, if any, is left to the planner's size check.
    """
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if documents.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        documents = documents.repartition("doc_id")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = benchmark.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    questions = benchmark.select("item_id", F.col("text").alias("question"))
    return (documents.withColumn("item_id", F.pmod("doc_id", items)).join(questions, "item_id", "left")
            .select(F.col("doc_id").alias("_id"), F.col("doc_id").cast("string").alias(ROW_KEY), F.col("lang").alias("title"),
                    F.col("text").alias("context"), "question", F.concat("source", F.lit(".csv")).alias("_shard")))


def predictions(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """The long table: one row per input and model, with ``keyed`` also the key of its pair.

    All work on the context is done before rows are multiplied by model, and
    every column is its own expression, so a query pays only for what it uses.
    """
    sentences = F.array_remove(F.split("context", SENTENCE_END), "")
    asked = F.size("_asked")
    lowered = F.array_remove(F.split("_lower", SENTENCE_END), "")
    matched = F.transform(lowered, lambda s: F.try_divide(F.size(F.array_intersect("_asked", F.split(s, BLANK_RUN))), asked))
    echoed = F.col("_id") % 13 != 0
    prepared = (
        qa_inputs(spark, sf_dir)
        .withColumns({"_sentences": sentences, "_asked": distinct_words(F.col("question")),
                      "_lower": F.lower("context")})
        .withColumns({"_matched": matched, "_words": F.split("_lower", BLANK_RUN)})
        .withColumns({
            "_lead": F.try_element_at("_sentences", F.lit(1)),
            "_lead_score": F.try_element_at("_matched", F.lit(1)),
            "_lexical_score": F.array_max("_matched"),
            "_echo": F.when(echoed, F.col("question")),
            "_echo_score": F.when(echoed, F.col("_id") * 7919 % 1000 / 1000.0),
        })
        .withColumns({"_lexical": F.try_element_at(
            "_sentences", F.array_position("_matched", F.col("_lexical_score")).cast("int"))})
        .withColumns({f"_{m}_words": distinct_words(F.col(f"_{m}")) for m in STAND_IN_MODELS})
        .withColumns({"_found": words_in_answers(F.col("_words"), F.array(*[f"_{m}_words" for m in STAND_IN_MODELS]))})
        .withColumns({f"_{m}_overlap": share_found(F.col(f"_{m}_words"), F.col("_found")) for m in STAND_IN_MODELS})
        .withColumns({"context_length": char_count(F.col("context")),
                      "question_length": char_count(F.col("question"))})
    )
    if keyed:
        prepared = prepared.withColumn(PAIR_KEY, pair_key(F.col("question"), F.col("context")))
    long = prepared.withColumn("model", F.explode(F.array(*[F.lit(m) for m in STAND_IN_MODELS])))

    def by_model(suffix: str):
        first, *rest = STAND_IN_MODELS
        out = F.when(F.col("model") == first, F.col(f"_{first}{suffix}"))
        for m in rest:
            out = out.when(F.col("model") == m, F.col(f"_{m}{suffix}"))
        return out

    return long.select(
        "_id", ROW_KEY, "title", "context", "question", "_shard", "context_length", "question_length", "model",
        by_model("").alias("answer"), by_model("_score").alias("score"),
        by_model("_overlap").alias("overlap"), F.lit("").alias("error"), *([PAIR_KEY] if keyed else []))

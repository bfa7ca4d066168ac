"""Column names, schemas and fixed vocabularies shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per input row and model, in the order the consolidated table is written.
CONSOLIDATED_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("_shard", T.StringType()),
    T.StructField("context_length", T.IntegerType()),
    T.StructField("question_length", T.IntegerType()),
    T.StructField("model", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("overlap", T.DoubleType()),
    T.StructField("error", T.StringType()),
])

CONSOLIDATED_COLUMNS = tuple(f.name for f in CONSOLIDATED_SCHEMA)

# Model key -> public checkpoint name.
MODEL_REGISTRY = {
    "distilbert": "distilbert-base-cased-distilled-squad",
    "roberta": "deepset/roberta-base-squad2",
    "bert": "bert-large-uncased-whole-word-masking-finetuned-squad",
}

# Checkpoint tried when the first one does not load.
MODEL_FALLBACKS = {
    "distilbert": "distilbert-base-uncased-distilled-squad",
    "roberta": "deepset/bert-base-cased-squad2",
}

# Accepted spellings of the result columns, first match wins.
RESULT_ALIASES = {
    "question": ("question", "query", "prompt"),
    "answer": ("answer", "prediction", "generated_answer"),
    "context": ("context", "passage", "source_text"),
    "score": ("score", "model_score", "confidence"),
    "overlap": ("overlap", "word_overlap", "token_overlap"),
    "model": ("model", "model_name"),
}

# Without these a result is refused.
REQUIRED_RESULT_COLUMNS = ("question", "answer", "context", "score")

# CSV tokens the pandas reader takes as missing.
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

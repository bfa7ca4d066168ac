"""How far models disagree on a (question, context) pair, and samples of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import PAIR_KEY, answer_key, is_complete, pair_id, pair_of, seeded_order, with_row
from ..functions.text import preview
from ..session import written
from .ranking import best_model_extremes

SEED = 42


def with_pair(df: DataFrame) -> DataFrame:
    return df.withColumn("_pair", pair_of(df))


def disagreement_level(models: Column, answers: Column, complete: Column) -> Column:
    """Class of a pair from its numbers of distinct models and answers.

    A pair with a null side cannot be looked up again and counts as having
    too few models. More answers than models (repeated rows) is partial.
    """
    return (F.when(~complete | (models < 2), "insufficient_models")
            .when(answers == models, "full_disagreement")
            .when(answers > 1, "partial_disagreement")
            .otherwise("no_disagreement"))


def _pair_classes(df: DataFrame, marked: bool = False) -> DataFrame:
    """One row per pair, keyed by ``_pair``. A null answer equals ``""`` here.

    Rows are first counted per (pair, answer, model), which spreads a pair with
    very many rows over tasks; keys, counts and model names are all that is
    shuffled. With ``marked`` the rows flagged ``_excluded`` are counted too.
    """
    answer = F.col("_answer") if "_answer" in df.columns else answer_key(F.coalesce("answer", F.lit("")))
    sums = [F.count(F.lit(1)).alias("_rows")] + ([F.count_if("_excluded").alias("_excluded")] if marked else [])
    return _classes_of_counts(df.groupBy(pair_of(df).alias("_pair"), answer.alias("_answer"), _named_model().alias("_model")).agg(*sums))


def _named_model() -> Column:
    """The model's name; a missing model counts as one, so it gets a value of its own."""
    return F.coalesce(F.concat(F.lit("m"), F.col("model")), F.lit("-"))


def _classes_of_counts(each: DataFrame) -> DataFrame:
    """The classes from rows counted per ``_pair``, ``_answer`` and ``_model``, each combination once."""
    sums = [F.sum("_rows").alias("n_rows"), F.count_distinct("_answer").alias("n_answers"), F.count_distinct("_model").alias("n_models")]
    if "_excluded" in each.columns:
        sums.append(F.sum("_excluded").alias("n_excluded"))
    level = disagreement_level(F.col("n_models"), F.col("n_answers"), is_complete(F.col("_pair")))
    return each.groupBy("_pair").agg(*sums).withColumn("level", level)


def disagreement_of_counts(counts: DataFrame, models) -> DataFrame:
    """As ``disagreement``, from rows counted by ``_pair``, ``_answer`` and ``model`` in ``_rows`` (several counts add up).

    With the models named, a pair's number of models is a sum of flags, so
    all that is grouped are pairs and their answers, and counts stored by pair need no exchange.
    """
    answer = F.coalesce("_answer", answer_key(F.lit("")))
    flags = {f"_m{i}": F.max(F.when(F.col("model") == m, 1).otherwise(0)) for i, m in enumerate(models)}
    each = counts.groupBy("_pair", answer.alias("_answer")).agg(F.sum("_rows").alias("_rows"), *[f.alias(n) for n, f in flags.items()])
    n_models = sum([F.max(n) for n in flags], F.lit(0)).cast("bigint")
    classes = each.groupBy("_pair").agg(F.sum("_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_answers"), n_models.alias("n_models"))
    return _shown_classes(classes.withColumn("level", disagreement_level(F.col("n_models"), F.col("n_answers"), is_complete(F.col("_pair")))))


def _shown_classes(classes: DataFrame) -> DataFrame:
    return classes.select(pair_id(F.col("_pair")).alias("pair_id"), "n_rows", "n_models", "n_answers", "level")


def disagreement(df: DataFrame) -> DataFrame:
    """Every pair with its counts and class."""
    return _shown_classes(_pair_classes(df))


def sample_pairs(df: DataFrame, count: int = 5, seed: int = SEED) -> DataFrame:
    """Reproducible sample of disagreeing pairs: ``_pair, pair_id, level, position``.

    Candidates have a row outside the best model's ten best and ten worst.
    Pairs with full disagreement come first, partial ones fill up. The order
    within a tier and the final shuffle follow a seeded hash of the pair. The table is read
    once: keys and numbers are written for the passes over it (runs a job).
    """
    return sample_of(sample_rows(df), count, seed)


def sample_rows(df: DataFrame) -> DataFrame:
    """What a sample of pairs needs of each row, without texts, written to the shared folder."""
    answer = answer_key(F.coalesce("answer", F.lit("")))
    return written(with_row(df).select("_row", "_id", "model", "score", "overlap", pair_of(df).alias(PAIR_KEY), answer.alias("_answer")), "pair-rows")


def sample_of(df: DataFrame, count: int = 5, seed: int = SEED) -> DataFrame:
    """As ``sample_pairs``, from ``sample_rows``."""
    narrow = df.select("_row", "_id", "model", "score", "overlap")
    ends = [best_model_extremes(narrow, largest).select("_row", "model") for largest in (True, False)]
    # At most 20 rows; a row that is both best and worst counts once.
    excluded = ends[0].unionByName(ends[1]).distinct().withColumn("_excluded", F.lit(True))
    marked = df.join(excluded, ["_row", "model"], "left")
    tier = F.when(F.col("level") == "full_disagreement", 0).when(F.col("level") == "partial_disagreement", 1)
    chosen = (_pair_classes(marked, marked=True).withColumn("_tier", tier)
              .where(F.col("_tier").isNotNull() & (F.col("n_rows") > F.col("n_excluded")))
              .withColumn("pair_id", pair_id(F.col("_pair")))
              .orderBy("_tier", seeded_order(seed, F.col("pair_id")), "pair_id").limit(count))
    shuffled = Window.orderBy(seeded_order(seed, F.lit("shuffle"), F.col("pair_id")), "pair_id")
    return chosen.select("_pair", "pair_id", "level", F.row_number().over(shuffled).alias("position"))


LOOKED_UP = 10  # as many values as a Parquet filter takes one by one


def pair_members(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """All rows of the given pairs (``_pair``), each with its pair's columns.

    A few pairs are found first (runs a job, which takes at most ``LOOKED_UP`` + 1 of them) and looked
    up by value. With stored keys, files and row groups without them are skipped; without, the filter
    reaches the inputs, before anything is computed from their texts but the key. More pairs are joined.
    """
    few = pairs.limit(LOOKED_UP + 1).collect()
    if len(few) <= LOOKED_UP:
        small = df.sparkSession.createDataFrame(few, pairs.schema)
        return with_pair(df.where(pair_of(df).isin([r["_pair"] for r in few]))).join(small, "_pair")
    return with_pair(df).join(pairs, "_pair")


def side_by_side(df: DataFrame, pairs: DataFrame, text_limit: int = 200) -> DataFrame:
    """Per pair and model the first row, models in name order.

    The first row is found by an aggregate that combines before the shuffle,
    so a pair with very many rows needs no sort in one task.
    """
    shown = F.struct("_id", "answer", "score", "overlap", "question",
                     preview(F.col("context"), text_limit).alias("context_preview"))
    first = (pair_members(df, pairs).groupBy("_pair", "pair_id", "level", "position", "model")
             .agg(F.min(shown).alias("r")))
    return first.select("position", "pair_id", "level", "model", "r.question", "r.context_preview",
                        "r.answer", "r.score", "r.overlap").orderBy("position", "model")


def disagreement_sample(df: DataFrame, count: int = 5, seed: int = SEED) -> DataFrame:
    """The sampled pairs with their question and context."""
    pairs = sample_pairs(df, count, seed)
    texts = pair_members(df, pairs).groupBy("position", "pair_id", "level").agg(
        F.min(F.struct("question", "context")).alias("t"))
    return texts.select("position", "pair_id", "level", "t.question", "t.context").orderBy("position")

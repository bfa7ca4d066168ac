"""Row filters of the two analysis views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def keyword_match(keyword: str, literal: bool = False) -> Column:
    """Keyword in the question or the answer, ignoring case.

    The keyword is a regular expression and is lower-cased as a whole, so a
    class such as ``\\D`` turns into ``\\d``; ``literal`` searches plain text.
    """
    sought = keyword.lower()
    hit = (lambda c: F.contains(F.lower(c), F.lit(sought))) if literal else (lambda c: F.lower(c).rlike(sought))
    return (F.coalesce(hit(F.coalesce(F.col("question"), F.lit(""))), F.lit(False))
            | F.coalesce(hit(F.coalesce(F.col("answer"), F.lit(""))), F.lit(False)))


def filter_home(df: DataFrame, min_score: float = 0.0, min_overlap: float = 0.0,
                models=None, keyword: str = "", literal: bool = False) -> DataFrame:
    """Lower bounds with missing numbers as 0, models, and a keyword.

    ``models=None`` means no choice was made; an empty list keeps no row.
    """
    return df.where(home_condition(df, min_score, min_overlap, models, keyword, literal))


def home_condition(df: DataFrame, min_score: float = 0.0, min_overlap: float = 0.0,
                   models=None, keyword: str = "", literal: bool = False) -> Column:
    """The condition of ``filter_home`` on a row."""
    keep = (F.coalesce("score", F.lit(0.0)) >= min_score) & (F.coalesce("overlap", F.lit(0.0)) >= min_overlap)
    if models is not None and "model" in df.columns:
        keep = keep & F.col("model").isin(list(models))
    if keyword:
        keep = keep & keyword_match(keyword, literal)
    return keep


def filter_advanced(df: DataFrame, score_range=None, length_range=None, models=None) -> DataFrame:
    """Closed ranges; rows with a missing number are dropped.

    A range left out is the observed one, which keeps every row that has the
    number. An empty or missing model choice does not filter.
    """
    keep = _within("score", score_range)
    if "question_length" in df.columns:
        keep = keep & _within("question_length", length_range)
    if models and "model" in df.columns:
        keep = keep & F.col("model").isin(list(models))
    return df.where(keep)


def _within(column: str, bounds) -> Column:
    return F.col(column).isNotNull() if bounds is None else F.col(column).between(*bounds)


def observed_ranges(df: DataFrame) -> DataFrame:
    """Smallest and largest score and question length, the defaults of the ranges."""
    return df.agg(F.min("score").alias("score_min"), F.max("score").alias("score_max"),
                  F.min("question_length").alias("length_min"), F.max("question_length").alias("length_max"))


def retention(df: DataFrame, keep: Column) -> DataFrame:
    """Rows kept, all rows, and the kept share in percent, in one pass."""
    kept = F.count_if(F.coalesce(keep, F.lit(False)))
    total = F.count(F.lit(1))
    return df.agg(kept.alias("kept"), total.alias("total"), (F.try_divide(kept, total) * 100).alias("kept_pct"))

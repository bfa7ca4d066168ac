"""Best and worst rows, globally and per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import with_row
from ..session import written
from .metrics import best_model

# Ties follow this order.
IDENTITY = ("_id", "model")
_SALTS = 256
LOOKED_UP = 10  # so many rows are looked up by value, more are joined


def extremes(df: DataFrame, by: str = "score", count: int = 10, largest: bool = True, ties=IDENTITY) -> DataFrame:
    """The ``count`` rows with the largest or smallest value; missing ones last."""
    first = F.desc_nulls_last(by) if largest else F.asc_nulls_last(by)
    return df.orderBy(first, *ties).limit(count)


def best_model_rows(df: DataFrame) -> DataFrame:
    """Rows of the model with the highest mean overlap, found on the same table."""
    name = best_model(df).select("model").scalar()
    return df.where(F.col("model") == name)


def best_model_extremes(df: DataFrame, largest: bool, count: int = 10) -> DataFrame:
    """Best or worst rows of that model, or of the table if it names no models.

    Of a table with texts the numbers are written once (runs a job) and the rows found on these;
    the table is then filtered by row, so nothing else of it is computed again.
    """
    if "model" not in df.columns:
        return extremes(df, "score", count, largest, ties=("_id",))
    if not has_texts(df):
        return extremes(best_model_rows(df), "score", count, largest)
    return extreme_of(df, written(with_row(df).select("_row", "_id", "model", "score", "overlap"), "extreme-rows"), largest, count)


def has_texts(df: DataFrame) -> bool:
    return not {"question", "context", "answer"}.isdisjoint(df.columns)


def extreme_of(df: DataFrame, numbers: DataFrame, largest: bool, count: int = 10) -> DataFrame:
    """Rows of ``df`` that are extremes of the best model by its ``numbers`` (``_row, _id, model, score, overlap``)."""
    found = extremes(best_model_rows(numbers), "score", count, largest).select("_row", "model")
    rows = with_row(df)
    if count <= LOOKED_UP:
        # By value (runs a job): that filter reaches the inputs, before anything is computed from their texts.
        few = found.collect()
        rows = rows.where(F.col("_row").isin([r["_row"] for r in few]) & F.col("model").isin([r["model"] for r in few]))
    else:
        rows = rows.join(found, ["_row", "model"], "left_semi")
    return extremes(rows.select(*df.columns), "score", count, largest)


def top_per_group(df: DataFrame, group: str, order: list[Column], count: int, spread_by: list[str]) -> DataFrame:
    """First ``count`` rows per group without gathering a group in one task.

    Groups are models, so each may hold a third of all rows. Each is cut to
    ``count`` rows within 256 slices first; Spark also drops rows beyond the
    limit before the shuffle. The second step sees at most 256 * count rows.
    """
    slices = df.withColumn("_slice", F.pmod(F.xxhash64(*spread_by), F.lit(_SALTS)))
    within = Window.partitionBy(group, "_slice").orderBy(*order)
    overall = Window.partitionBy(group).orderBy(*order)
    return (slices.withColumn("_rank", F.row_number().over(within)).where(F.col("_rank") <= count)
            .withColumn("_rank", F.row_number().over(overall)).where(F.col("_rank") <= count)
            .drop("_slice").withColumnRenamed("_rank", "rank"))


def extreme_rows(df: DataFrame, models=None, count: int = 10) -> DataFrame:
    """Per model its best and worst ``count`` rows: ``_id, model, end, rank, score``."""
    return _extreme_rows(df, models, count).drop("_row")


def _extreme_rows(df: DataFrame, models, count: int) -> DataFrame:
    base = with_row(df.where(F.col("model").isin(list(models)) if models else F.col("model").isNotNull()))
    base = base.select("_row", "_id", "model", "score")
    ties = [F.col("_id"), F.col("_row")]
    best = top_per_group(base, "model", [F.desc_nulls_last("score"), *ties], count, ["_row"])
    worst = top_per_group(base, "model", [F.asc_nulls_last("score"), *ties], count, ["_row"])
    return (best.withColumn("end", F.lit("top")).unionByName(worst.withColumn("end", F.lit("bottom")))
            .select("_row", "_id", "model", "end", "rank", "score"))


def extreme_inputs(df: DataFrame, models=None, count: int = 10) -> DataFrame:
    """``_row, _id`` of the inputs that are an extreme of at least one model."""
    return _extreme_rows(df, models, count).select("_row", "_id").distinct()


def extreme_ids(df: DataFrame, models=None, count: int = 10) -> DataFrame:
    """The ids of those inputs, one for each."""
    return extreme_inputs(df, models, count).select("_id")

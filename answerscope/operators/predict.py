"""Run several predictors over every input row and capture their errors.

Python sees the question, a possibly shortened context and, if a predictor
asks for them, further columns; it returns short answers. All other columns
stay in the JVM, so a context is sent to Python once for all models and never
back. This is the only Python code that touches rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import char_count, once, overlap_with, split_lower, truncate, words, words_in_answers
from ..schema import MODEL_FALLBACKS, MODEL_REGISTRY
from ..session import ship_package

RESULT_TYPE = ("array<struct<model:string, answer:string, score:double, start:int, end:int, "
               "error:string, model_error:string>>")


class Predictor:
    """Interface of a predictor; one instance lives in each Python worker."""

    def load_model(self) -> None:
        """Load weights; an exception here takes the whole model out of the run."""

    def predict(self, questions: Sequence[str], contexts: Sequence[str]) -> list[dict]:
        """One dict per row with ``answer``, ``score`` and optionally ``start``, ``end``, ``error``."""
        raise NotImplementedError

    def predict_rows(self, rows: pd.DataFrame) -> list[dict]:
        """As ``predict``, for predictors that use further columns."""
        return self.predict(rows["question"].tolist(), rows["context"].tolist())

    def get_metadata(self) -> dict:
        return {"class": type(self).__name__}


class TransformersPredictor(Predictor):
    """Adapter to an extractive QA checkpoint; needs the transformers package on the executors."""

    def __init__(self, checkpoint: str, device: int = -1) -> None:
        self.checkpoint, self.device, self.pipe = checkpoint, device, None

    def load_model(self) -> None:
        from transformers import pipeline  # optional dependency

        self.pipe = pipeline("question-answering", model=self.checkpoint, tokenizer=self.checkpoint, device=self.device)

    def predict(self, questions, contexts):
        found = self.pipe([{"question": q, "context": c} for q, c in zip(questions, contexts)])
        return [found] if isinstance(found, dict) else found

    def get_metadata(self) -> dict:
        return {**super().get_metadata(), "checkpoint": self.checkpoint, "device": self.device}


@dataclass(frozen=True)
class Model:
    """A named model and the predictors to try for it, in order."""

    key: str
    candidates: tuple[Callable[[], Predictor], ...]
    # Tells workers that are reused across tasks which loaded instance is theirs.
    token: str = field(default_factory=lambda: uuid.uuid4().hex)


def _checkpoint(name: str) -> Callable[[], Predictor]:
    return lambda: TransformersPredictor(name)


def registered_models() -> dict[str, Model]:
    """The built-in registry, each with its fallback checkpoint where there is one."""
    names = {k: [v, *([MODEL_FALLBACKS[k]] if k in MODEL_FALLBACKS else [])] for k, v in MODEL_REGISTRY.items()}
    return {k: Model(k, tuple(_checkpoint(n) for n in v)) for k, v in names.items()}


def select_names(selection, available: Sequence[str]) -> list[str]:
    """Names chosen by ``"all"``, one name or a list.

    Unknown names are ignored; order and repeats of the request are kept;
    ``"all"`` inside a list selects everything; nothing selects nothing.
    """
    if not selection:
        return []
    wanted = [selection] if isinstance(selection, str) else list(selection)
    if "all" in wanted:
        # Names before "all" do not matter: everything is selected once.
        return list(available)
    return [w for w in wanted if w in available]


def select_models(selection, registry: dict[str, Model] | None = None) -> list[Model]:
    registry = registered_models() if registry is None else registry
    return [registry[name] for name in select_names(selection, list(registry))]


_LOADED: dict[str, Predictor] = {}


def _load(model: Model) -> Predictor:
    """First candidate that loads; kept for later tasks of this worker."""
    if model.token in _LOADED:
        return _LOADED[model.token]
    failure: Exception | None = None
    for make in model.candidates:
        try:
            predictor = make()
            predictor.load_model()
        except Exception as e:
            failure = e
            continue
        _LOADED[model.token] = predictor
        return predictor
    raise failure or RuntimeError(f"model {model.key} has no predictor")


def _predict_batch(predictor: Predictor, rows: pd.DataFrame) -> list[dict]:
    """Results for one batch; if it fails, every row of it carries the message."""
    try:
        found = predictor.predict_rows(rows)
        found = [found] if isinstance(found, dict) else list(found)
        if len(found) != len(rows):
            raise ValueError(f"{len(found)} results for {len(rows)} rows")
    except Exception as e:
        found = [{"answer": "", "score": 0.0, "error": str(e)}] * len(rows)
    return [{"answer": r.get("answer", ""), "score": _number(r.get("score", 0.0)),
             "start": r.get("start"), "end": r.get("end"), "error": r.get("error", "")} for r in found]


def _number(value):
    return None if value is None or value != value else float(value)


def load_failures(spark: SparkSession, models: Sequence[Model]) -> dict[str, str]:
    """Try to load every model in one worker: model -> message for those that do not load (runs a job)."""
    models = list(models)
    ship_package(spark)

    def attempt(batches):
        for _ in batches:
            pass
        failed = []
        for m in models:
            try:
                _load(m)
            except Exception as e:
                failed.append((m.key, str(e)))
            finally:
                # A worker holds only what its own tasks use.
                _LOADED.pop(m.token, None)
        yield pd.DataFrame(failed, columns=["model", "error"])

    rows = spark.range(1).coalesce(1).mapInPandas(attempt, "model string, error string").collect()
    return {r.model: r.error for r in rows}


def _task_attempts(spark: SparkSession) -> int:
    """How often Spark tries a task; a local session tries once unless its master says otherwise."""
    master = spark.sparkContext.master
    local = re.fullmatch(r"local(?:\[[^,\]]+(?:,\s*(\d+))?\])?", master)
    return int(local[1] or 1) if local else int(spark.sparkContext.getConf().get("spark.task.maxFailures", "4"))


def fan_out(df: DataFrame, models: Sequence[Model], batch_size: int = 32, context_limit: int | None = None,
            extra: Sequence[str] = (), retry_load: bool = False, annotate: bool = False) -> DataFrame:
    """Every input row once per model, with ``model, answer, score, start, end, error, model_error``.

    With ``annotate`` also ``overlap``, ``context_length`` and ``question_length``;
    a context is split into words once for all models.

    Rows stay in their partitions: the number of partitions, not of models,
    sets the parallelism, and nothing is shuffled. A batch is ``batch_size``
    consecutive rows of a partition. A model that cannot be loaded yields
    ``model_error`` on its rows; see ``failed_models`` and ``without_models``.
    With ``retry_load`` it first fails the task, before any row is computed, which
    Spark then tries elsewhere; only the last attempt yields ``model_error``.
    """
    if not models:
        raise ValueError("no models selected")
    models = list({m.key: m for m in models}.values())
    names = ["question", "context", *extra]
    ship_package(df.sparkSession)
    attempts = _task_attempts(df.sparkSession) if retry_load else 1

    @F.pandas_udf(RESULT_TYPE)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        ready, broken = {}, {}
        for m in models:
            try:
                ready[m.token] = _load(m)
            except Exception as e:
                if TaskContext.get().attemptNumber() + 1 < attempts:
                    raise
                broken[m.token] = str(e)
        for columns in batches:
            rows = pd.concat(columns, axis=1, keys=names)
            out = [[] for _ in range(len(rows))]
            for m in models:
                if m.token in broken:
                    for cell in out:
                        cell.append({"model": m.key, "model_error": broken[m.token]})
                    continue
                for start in range(0, len(rows), batch_size):
                    part = rows.iloc[start:start + batch_size]
                    for cell, r in zip(out[start:start + batch_size], _predict_batch(ready[m.token], part)):
                        cell.append({"model": m.key, **r})
            yield pd.Series(out)

    shown = F.col("context") if context_limit is None else truncate(F.col("context"), context_limit)
    answers = run.asNondeterministic()("question", shown, *extra)
    found = df.select("*", answers.alias("_answers"))
    if not annotate:
        return found.select(*df.columns, F.inline("_answers"))
    fields = ("model", "answer", "score", "start", "end", "error", "model_error")
    found_words = words_in_answers(split_lower(F.col("context")), F.transform("_answers", lambda a: words(a["answer"])))
    scored = once(found_words, lambda seen: F.transform("_answers", lambda a: F.struct(
        *[a[f].alias(f) for f in fields], overlap_with(a["answer"], seen).alias("overlap"))))
    sizes = [char_count(F.col(c)).alias(f"{c}_length") for c in ("context", "question")]
    own = [c for c in df.columns if c not in ("context_length", "question_length", "overlap")]
    return found.select(*own, *sizes, scored.alias("_scored")).select(*own, "context_length", "question_length", F.inline("_scored"))


def failed_models(raw: DataFrame) -> DataFrame:
    """Models that could not be loaded: ``model, model_error, rows``."""
    return (raw.where(F.col("model_error").isNotNull()).groupBy("model")
            .agg(F.min("model_error").alias("model_error"), F.count(F.lit(1)).alias("rows")))


def without_models(raw: DataFrame, failed: Sequence[str]) -> DataFrame:
    """Predictions of the other models; a failed model is left out whole."""
    kept = raw.where(~F.col("model").isin(list(failed))) if failed else raw
    return kept.where(F.col("model_error").isNull()).drop("model_error")

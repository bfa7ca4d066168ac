"""An evaluation run from shards to reports, and the three analysis views."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import PAIR_KEY, answer_key, pair_of, with_row
from ..functions.text import clean_overlap
from ..operators import compare, disagreement, distributions, filters, metrics, predict, ranking
from ..session import written
from ..sinks import reports
from ..sinks.run_store import RunStore
from ..sources.columns import head_rows, normalize_input, with_row_id
from ..sources.shards import load_and_check


@dataclass
class EvaluationRun:
    run_id: str
    results: DataFrame
    metrics: DataFrame
    failures: dict[str, str]
    run_folder: str
    skipped: DataFrame


def run_evaluation(spark: SparkSession, shards: str, output: str, selection="all",
                   models: Sequence[predict.Model] | None = None, batch_size: int = 32,
                   max_samples: int | None = None, context_limit: int | None = None,
                   extra: Sequence[str] = (), run_id: str | None = None, csv: str | None = None) -> EvaluationRun:
    """Load shards, run every model, store the predictions, write the reports.

    Models that do not load are found first and left out; a model that breaks later is left
    out too, reported in ``failures``, and the others' predictions are complete and not computed again.
    The predictions are written once and published as a whole (see ``RunStore``); the metrics
    document is made from the states stored beside them, and the other reports from the document. ``skipped``
    lists the shards that were left out (see ``skipped_shards``).
    ``csv`` may be ``"csv"`` or ``"csv.gz"`` for an export beside the table.
    """
    models = predict.select_models("all") if models is None else list(models)
    if not models:
        raise ValueError("no models selected")
    inputs, skipped = load_and_check(spark, shards, selection)
    if max_samples:
        inputs = head_rows(inputs, max_samples)
    inputs = with_row_id(normalize_input(inputs))
    failures = predict.load_failures(spark, models)
    good = [m for m in models if m.key not in failures]
    if not good:
        raise RuntimeError(f"no model could be loaded: {failures}")

    run_id = run_id or datetime.now().strftime("%Y%m%d_%H%M%S")
    store = RunStore(spark, f"{output}/predictions")
    for model, error in failures.items():
        store.fail(run_id, model, error)
    failures |= store.evaluate(inputs, good, run_id, batch_size=batch_size, context_limit=context_limit, extra=extra)
    if len(failures) == len({m.key for m in models}):
        raise RuntimeError(f"no model gave predictions: {failures}")
    store.publish(run_id)
    results = store.read(run_id)
    run_folder = f"{output}/{run_id}"
    if csv:
        reports.write_results_csv(results, run_folder, gzip=csv == "csv.gz")
    fresh = store.metrics_document(run_id)
    reports.write_metrics_json(fresh, f"{run_folder}/metrics.json")
    document = spark.read.schema(fresh.schema).json(f"{run_folder}/metrics.json")
    reports.write_summary(document, f"{run_folder}/metrics_summary.md")
    reports.write_per_model_csv(document, f"{run_folder}/per_model_metrics.csv")
    return EvaluationRun(run_id, results, document, failures, run_folder, skipped)


def home_analysis(df: DataFrame, min_score: float = 0.0, min_overlap: float = 0.0, models=None,
                  keyword: str = "") -> dict[str, DataFrame]:
    """The panels of the first view; the filters act on the panels marked so.

    The table is read once for the numbers: these, the sizes of the questions, the keys of row, pair and
    answer and whether a row passes the filters are written to the shared folder. Panels that show
    texts find their rows there and filter the table by them; ``rows`` is the filtered table itself.
    """
    own = [c for c in ("_id", "model") if c in df.columns]
    answer = answer_key(F.coalesce("answer", F.lit("")))
    passes = F.coalesce(filters.home_condition(df, min_score, min_overlap, models, keyword), F.lit(False))
    numbers = written(with_row(df).select(
        "_row", *own, "score", "overlap", *[size.alias(n) for n, size in metrics.question_sizes(df).items()],
        pair_of(df).alias(PAIR_KEY), answer.alias("_answer"), passes.alias("_passes")), "view-numbers")
    kept = numbers.where("_passes")
    panels = {
        "headline": metrics.headline_metrics(numbers),
        "score_histogram": distributions.histogram(kept, "score", 40),  # filtered
        "rows": filters.filter_home(df, min_score, min_overlap, models, keyword),  # filtered
    }
    if "model" in df.columns:
        return panels | {
            "top10": ranking.extreme_of(df, numbers, True),
            "bottom10": ranking.extreme_of(df, numbers, False),
            "model_stats": metrics.model_stats(kept),  # filtered
            "performance": metrics.performance_tiers(numbers),
            "best_model": metrics.best_model(numbers),
            "examples": disagreement.side_by_side(df, disagreement.sample_of(numbers)),
        }
    return panels | {"top10": ranking.best_model_extremes(df, True), "bottom10": ranking.best_model_extremes(df, False)}


def advanced_analysis(df: DataFrame, score_range=None, length_range=None, models=None) -> dict[str, DataFrame]:
    """The panels of the second view, all on the filtered rows.

    The table is read once: the numbers of the filtered rows are written to the shared
    folder, some forty bytes a row, and every panel reads these.
    """
    kept = filters.filter_advanced(df, score_range, length_range, models)
    numbers = ("model", *distributions.CORRELATED)
    kept = written(kept.select(*[c for c in numbers if c in kept.columns]), "view-numbers")
    by_model = {} if "model" not in df.columns else {
        "describe": distributions.score_describe(kept),
        "box": distributions.box_summary(kept),
        "density": distributions.density(kept),
    }
    return by_model | {
        "trend_length": distributions.trend(kept, "question_length"),
        "trend_overlap": distributions.trend(kept, "overlap"),
        "overlap_histogram": distributions.histogram(kept, "overlap", 30),
        "overlap_box": distributions.box_overall(kept, "overlap"),
        "overlap_by_confidence": metrics.overlap_by_confidence(kept),
        "correlation": distributions.correlation(kept, "overlap", "score"),
        "correlation_matrix": distributions.correlation_matrix(kept),
        "correlation_pairs": distributions.correlation_pairs(kept),
    }


def two_model_study(df: DataFrame, a: str, b: str, cleaned: bool = False) -> dict[str, DataFrame]:
    """The blocks of the comparison of two models.

    With ``cleaned`` the overlap is taken anew between cleaned texts. The table is read once:
    the two models' answers and numbers are written to the shared folder with what tells
    an input row from others, so no block reads, hashes or cleans a context again.
    """
    if cleaned:
        df = df.withColumn("overlap", clean_overlap(F.col("answer"), F.col("context")))
    df = compare.study_rows(df, a, b)
    return {
        "wide": compare.wide_compare(df, a, b),
        "summary": compare.wide_summary(df, a, b),
        "wins": compare.win_counts(df, a, b),
        "tiers": compare.tier_distribution(df, a, b),
        "risk": compare.risk_shares(df, a, b),
        "verdict": compare.overlap_verdicts(df, a, b),
        "top10": compare.global_extremes(df, (a, b), True),
        "bottom10": compare.global_extremes(df, (a, b), False),
        "extreme_models": compare.extreme_model_counts(df, (a, b)),
        "sample": compare.sample_differing(df, a, b),
        "sample_means": compare.sample_means(df, a, b),
        "sample_wins": compare.sample_wins(df, a, b),
    }

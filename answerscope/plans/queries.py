"""Registered queries: each takes (spark, sf_dir) and reads the whole tables."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..fixtures.predictors import EchoPredictor, LeadPredictor, stand_in_models
from ..fixtures.stand_in import STAND_IN_MODELS, predictions, qa_inputs
from ..functions import bands, text
from ..functions.statistics import to_number
from ..operators import compare, disagreement, distributions, filters, metrics, predict, ranking
from ..operators.predict import Model, Predictor
from ..session import scratch_path, written
from ..sinks import reports
from ..sinks.run_store import RunStore
from ..sources import columns, results, shards
from . import evaluation

# The two models compared side by side; the second one has missing answers.
A, B = "lexical", "echo"
RUN_ID = "20260202_164950"


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Fixed digits for sums of doubles, whose last bits depend on the order."""
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def _round_doubles(df: DataFrame) -> DataFrame:
    return _round(df, *[n for n, t in df.dtypes if t == "double"])


# --- sources -------------------------------------------------------------

def _csv_shards(spark, sf_dir) -> str:
    """The inputs as CSV shards with two different headers."""
    folder = scratch_path(spark, "shards")
    inputs = qa_inputs(spark, sf_dir).withColumnsRenamed({"question": "query", "context": "text"})
    english = F.col("title") == "en"
    reports.write_shards(inputs.where(english).select("query", "text", "_id", "_shard"), folder)
    reports.write_shards(inputs.where(~english).select("_id", "text", "query", "title", "_shard"), folder,
                         mode="append")
    return folder


def shard_catalog(spark, sf_dir):
    return shards.shard_catalog(spark, _csv_shards(spark, sf_dir)).select("_shard")


def load_shards(spark, sf_dir):
    table = columns.normalize_input(shards.load_shards(spark, _csv_shards(spark, sf_dir)))
    return table.select("_id", "title", "context", "question", "_shard")


def shard_select(spark, sf_dir):
    chosen = shards.selection_filter(["src1*", "src7.csv", "src7.csv"])
    return qa_inputs(spark, sf_dir).where(chosen).select("_id", "_shard", "question")


def shard_stems(spark, sf_dir):
    return shards.shard_stems(qa_inputs(spark, sf_dir), "src1*.csv")


def sample_cap(spark, sf_dir):
    return columns.head_rows(qa_inputs(spark, sf_dir), 100).select("_id", "_shard", "question", "context")


def normalize_input(spark, sf_dir):
    raw = qa_inputs(spark, sf_dir).select("_id", F.col("question").alias("query"), F.col("context").alias("text"))
    fuzzy = raw.withColumnsRenamed({"query": "User_Query", "text": "Full_Text"})
    by_name = columns.normalize_input(raw).select("_id", "question", F.length("context").alias("n"))
    by_guess = columns.normalize_input(fuzzy, fuzzy=True).select("_id", "question", F.length("context").alias("n"))
    return by_name.withColumn("how", F.lit("alias")).unionByName(by_guess.withColumn("how", F.lit("fuzzy")))


def normalize_results(spark, sf_dir):
    raw = predictions(spark, sf_dir).select(
        "_id", F.col("question").alias("Prompt"), F.col("answer").alias("prediction"),
        F.col("context").alias("passage"), F.coalesce(F.col("score").cast("string"), F.lit("n/a")).alias("Confidence"),
        F.col("overlap").cast("string").alias("word_overlap"), F.col("model").alias("model_name"))
    return columns.normalize_results(raw).select("_id", "model", "question", "answer", "score", "overlap")


def _runs(spark, sf_dir):
    """Predictions tagged with one run per source; one source has no valid run id."""
    number = F.regexp_extract("_shard", r"(\d+)", 1).cast("int")
    run = F.when(number == 0, "draft").otherwise(
        F.concat(F.lit("202602"), F.lpad((number % 28 + 1).cast("string"), 2, "0"), F.lit("_120000")))
    return predictions(spark, sf_dir).withColumn("run_id", run)


def latest_run(spark, sf_dir):
    return results.latest_run(_runs(spark, sf_dir)).select("run_id", "_id", "model", "answer", "score", "overlap")


def run_timestamp(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    run = F.when(F.col("event_type") == "click", F.concat(F.lit("run-"), F.col("event_id").cast("string"))).otherwise(
        F.date_format("ts", "yyyyMMdd_HHmmss"))
    return events.select("event_id", run.alias("run_id")).withColumn("label", results.run_label(F.col("run_id")))


def scan_results(spark, sf_dir):
    folder = scratch_path(spark, "scan")
    path = reports.write_results_csv(predictions(spark, sf_dir), f"{folder}/{RUN_ID}", gzip=True)
    return results.scan_results(spark, path).select(
        "_id", "title", "context", "question", "_shard", "context_length", "question_length",
        "model", "answer", "score", "overlap")


# --- sinks ---------------------------------------------------------------

def consolidated(spark, sf_dir):
    table = scratch_path(spark, "predictions")
    reports.write_predictions(predictions(spark, sf_dir), table, RUN_ID)
    return results.ordered_projection(results.latest_run(spark.read.parquet(table)))


def metrics_json(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    document = metrics.metrics_document(predictions(spark, sf_dir))
    reports.write_metrics_json(document, path)
    stored = spark.read.schema(document.schema).json(path)
    return _round_doubles(metrics.document_rows(stored))


def metrics_document(spark, sf_dir):
    return _round_doubles(metrics.document_rows(metrics.metrics_document(predictions(spark, sf_dir))))


def metrics_summary_lines(spark, sf_dir):
    return reports.summary_lines(metrics.metrics_document(predictions(spark, sf_dir)), digits=6).select(F.col("ord").cast("bigint"), "line")


def wide_summary(spark, sf_dir):
    return _round_doubles(compare.wide_summary(predictions(spark, sf_dir), A, B))


# --- models and inference ------------------------------------------------

def model_select(spark, sf_dir):
    names = predict.select_names(["echo", "nope", "lead"], STAND_IN_MODELS)
    place = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i + 1)])
    chosen = predictions(spark, sf_dir).where(F.col("model").isin(names))
    return (chosen.groupBy("model").agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("position", place[F.col("model")]))


def fanout_predict(spark, sf_dir):
    raw = predict.fan_out(qa_inputs(spark, sf_dir), list(stand_in_models().values()), extra=("_id",), annotate=True)
    return predict.without_models(raw, []).select("_id", "model", "answer", "score", "overlap", "error", "context_length", "question_length")


class _FailsOnLongContext(Predictor):
    def predict(self, questions, contexts):
        if max(len(c) for c in contexts) > 2000:
            raise ValueError("context too long")
        return [{"answer": (q or "").split(" ")[0], "score": 1.0} for q in questions]


class _CannotLoad(Predictor):
    def load_model(self):
        raise OSError("weights are missing")


def predict_errors(spark, sf_dir):
    model = Model("strict", (_FailsOnLongContext,))
    raw = predict.fan_out(qa_inputs(spark, sf_dir), [model], batch_size=1)
    return raw.select("_id", "model", "answer", "score", "error")


def model_failures(spark, sf_dir):
    models = [Model("broken", (_CannotLoad,)), Model("rescued", (_CannotLoad, LeadPredictor)),
              Model("echo", (EchoPredictor,))]
    raw = predict.fan_out(qa_inputs(spark, sf_dir), models, extra=("_id",))
    failed = predict.failed_models(raw).select("model", F.col("model_error").alias("error"), "rows")
    good = predict.without_models(raw, []).groupBy("model").agg(F.count(F.lit(1)).alias("rows"))
    return failed.unionByName(good.withColumn("error", F.lit(None).cast("string")))


def truncate_context(spark, sf_dir):
    return qa_inputs(spark, sf_dir).select("_id", text.truncate(F.col("context")).alias("shown"))


# --- scalar functions ----------------------------------------------------

def overlap(spark, sf_dir):
    # The function itself on the finished long table, not the shared split of the view.
    rows = predictions(spark, sf_dir).select("_id", "model", "answer", "context")
    return rows.select("_id", "model", text.word_overlap(F.col("answer"), F.col("context")).alias("overlap"))


def lengths(spark, sf_dir):
    return columns.annotate(qa_inputs(spark, sf_dir)).select("_id", "context_length", "question_length")


def question_sizes(spark, sf_dir):
    q = F.col("question")
    return qa_inputs(spark, sf_dir).select("_id", text.word_count(q).alias("question_length_words"),
                                           text.nonspace_count(q).alias("question_length_chars"))


def clean_text(spark, sf_dir):
    return qa_inputs(spark, sf_dir).select("_id", text.clean_text(F.col("context")).alias("cleaned"))


def overlap_clean(spark, sf_dir):
    return predictions(spark, sf_dir).select(
        "_id", "model", text.clean_overlap(F.col("answer"), F.col("context")).alias("overlap"))


def risk_band(spark, sf_dir):
    return predictions(spark, sf_dir).select("_id", "model", bands.risk_band(F.col("score")).alias("risk_band"))


def overlap_tier(spark, sf_dir):
    return predictions(spark, sf_dir).select("_id", "model", bands.overlap_tier(F.col("overlap")).alias("tier"))


def overlap_verdict(spark, sf_dir):
    return _round_doubles(compare.overlap_verdicts(predictions(spark, sf_dir), A, B))


def performance_tier(spark, sf_dir):
    return _round_doubles(metrics.performance_tiers(predictions(spark, sf_dir)))


def coerce_numeric(spark, sf_dir):
    raw = F.when(F.col("title") == "de", "bad").when(F.col("title") == "es", "NaN").otherwise(
        F.concat(F.lit(" "), F.col("score").cast("string")))
    return predictions(spark, sf_dir).select("_id", "model", to_number(raw).alias("score"))


def preview(spark, sf_dir):
    return qa_inputs(spark, sf_dir).select("_id", text.preview(F.col("context")).alias("context_preview"),
                                           text.preview(F.col("question"), 80).alias("question_preview"))


# --- filters -------------------------------------------------------------

def filter_home(spark, sf_dir):
    kept = filters.filter_home(predictions(spark, sf_dir), 0.1, 0.2, ["lead", "lexical"], "tion")
    return kept.select("_id", "model", "score", "overlap")


def keyword_search(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    pattern = rows.where(filters.keyword_match("TH[ae]n?d ")).select("_id", "model", F.lit("regex").alias("how"))
    literal = rows.where(filters.keyword_match("on, ", literal=True)).select("_id", "model", F.lit("literal").alias("how"))
    return pattern.union(literal)


def filter_advanced(spark, sf_dir):
    kept = filters.filter_advanced(predictions(spark, sf_dir), (0.1, 0.75), (40, 200), ["echo", "lexical"])
    return kept.select("_id", "model", "score", "question_length")


def filter_retention(spark, sf_dir):
    keep = F.col("score").between(0.1, 0.75) & F.col("question_length").between(40, 200)
    return _round_doubles(filters.retention(predictions(spark, sf_dir), keep))


# --- aggregates ----------------------------------------------------------

def overall_metrics(spark, sf_dir):
    return _round_doubles(metrics.overall_metrics(predictions(spark, sf_dir)))


def per_model_metrics(spark, sf_dir):
    return _round_doubles(metrics.per_model_metrics(predictions(spark, sf_dir)))


def agreement_groups(spark, sf_dir):
    return metrics.agreement_groups(predictions(spark, sf_dir))


def avg_unique_answers(spark, sf_dir):
    return _round_doubles(metrics.avg_unique_answers(predictions(spark, sf_dir)))


def risk_counts(spark, sf_dir):
    return metrics.risk_counts(predictions(spark, sf_dir))


def headline_metrics(spark, sf_dir):
    return _round_doubles(metrics.headline_metrics(predictions(spark, sf_dir)))


def model_stats(spark, sf_dir):
    return metrics.model_stats(filters.filter_home(predictions(spark, sf_dir), 0.05))


def score_describe(spark, sf_dir):
    return distributions.score_describe(predictions(spark, sf_dir))


def best_model(spark, sf_dir):
    return _round_doubles(metrics.best_model(predictions(spark, sf_dir)))


def overlap_by_confidence(spark, sf_dir):
    return _round_doubles(metrics.overlap_by_confidence(predictions(spark, sf_dir)))


def corr_score_overlap(spark, sf_dir):
    return _round_doubles(distributions.correlation(predictions(spark, sf_dir), "overlap", "score"))


def corr_matrix(spark, sf_dir):
    return _round_doubles(distributions.correlation_matrix(predictions(spark, sf_dir)))


def corr_pairs(spark, sf_dir):
    return _round_doubles(distributions.correlation_pairs(predictions(spark, sf_dir)))


def score_histogram(spark, sf_dir):
    return _round_doubles(distributions.histogram(predictions(spark, sf_dir), "score", 40))


def overlap_histogram(spark, sf_dir):
    return _round_doubles(distributions.histogram(predictions(spark, sf_dir), "overlap", 30))


def score_box(spark, sf_dir):
    return _round_doubles(distributions.box_summary(predictions(spark, sf_dir)))


def overlap_box(spark, sf_dir):
    return _round_doubles(distributions.box_overall(predictions(spark, sf_dir), "overlap"))


def score_density(spark, sf_dir):
    return _round_doubles(distributions.density(predictions(spark, sf_dir)))


def trend_qlen_score(spark, sf_dir):
    return _round_doubles(distributions.trend(predictions(spark, sf_dir), "question_length"))


def trend_overlap_score(spark, sf_dir):
    return _round_doubles(distributions.trend(predictions(spark, sf_dir), "overlap"))


def tier_distribution(spark, sf_dir):
    return _round_doubles(compare.tier_distribution(predictions(spark, sf_dir), A, B))


def risk_shares(spark, sf_dir):
    return _round_doubles(compare.risk_shares(predictions(spark, sf_dir), A, B))


def win_counts(spark, sf_dir):
    return compare.win_counts(predictions(spark, sf_dir), A, B)


def dataset_profile(spark, sf_dir):
    return _round_doubles(metrics.dataset_profile(columns.annotate(qa_inputs(spark, sf_dir))))


def sample_means(spark, sf_dir):
    return _round_doubles(compare.sample_means(predictions(spark, sf_dir), A, B))


def sample_wins(spark, sf_dir):
    return compare.sample_wins(predictions(spark, sf_dir), A, B)


def topk_model_counts(spark, sf_dir):
    return compare.extreme_model_counts(predictions(spark, sf_dir), (A, B))


# --- joins and reshaping -------------------------------------------------

def wide_compare(spark, sf_dir):
    return compare.wide_compare(predictions(spark, sf_dir), A, B, with_text=True)


def best_worst(spark, sf_dir):
    return compare.best_worst(predictions(spark, sf_dir), STAND_IN_MODELS)


def disagreement_classes(spark, sf_dir):
    return disagreement.disagreement(predictions(spark, sf_dir))


def pair_members(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return disagreement.pair_members(rows, disagreement.sample_pairs(rows)).select(
        "pair_id", "level", "_id", "model", "answer", "score", "overlap")


def side_by_side(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return disagreement.side_by_side(rows, disagreement.sample_pairs(rows))


# --- top-k and samples ---------------------------------------------------

_SHOWN = ("_id", "model", "question", "answer", "context", "score", "overlap")


def top10_best_model(spark, sf_dir):
    return ranking.best_model_extremes(predictions(spark, sf_dir), True).select(*_SHOWN)


def bottom10_best_model(spark, sf_dir):
    return ranking.best_model_extremes(predictions(spark, sf_dir), False).select(*_SHOWN)


def top10_global(spark, sf_dir):
    return compare.global_extremes(predictions(spark, sf_dir), (A, B), True)


def bottom10_global(spark, sf_dir):
    return compare.global_extremes(predictions(spark, sf_dir), (A, B), False)


def extreme_ids(spark, sf_dir):
    return ranking.extreme_ids(predictions(spark, sf_dir), (A, B))


def extreme_rows(spark, sf_dir):
    return ranking.extreme_rows(predictions(spark, sf_dir))


def disagreement_sample(spark, sf_dir):
    return disagreement.disagreement_sample(predictions(spark, sf_dir))


def disagree_sample(spark, sf_dir):
    return compare.sample_differing(predictions(spark, sf_dir), A, B, with_text=True)


# --- missing and repeated ids, unseen classes ------------------------------

def _mixed_ids(spark, sf_dir):
    """Predictions whose ``_id`` is missing for a third of the inputs and repeated for the others."""
    return predictions(spark, sf_dir).withColumn("_id", F.when(F.col("_id") % 3 != 0, F.col("_id") % 50))


def wide_mixed_ids(spark, sf_dir):
    return compare.wide_compare(_mixed_ids(spark, sf_dir), A, B, with_text=True)


def extreme_mixed_ids(spark, sf_dir):
    return ranking.extreme_rows(_mixed_ids(spark, sf_dir))


def disagreement_edges(spark, sf_dir):
    """Pairs with one answer, with one model, without a question, and with a nameless model."""
    kind = F.col("_id") % 5
    rows = predictions(spark, sf_dir).withColumns({
        "answer": F.when(kind == 0, "same").otherwise(F.col("answer")),
        "question": F.when(kind != 2, F.col("question")),
        "model": F.when(kind == 1, "lead").when((kind == 3) & (F.col("model") == "echo"), None).otherwise(F.col("model"))})
    return disagreement.disagreement(rows)


def skipped_shards(spark, sf_dir):
    """Rows loaded of each shard, and the rows with too many fields of the shards left out."""
    folder = scratch_path(spark, "shards")
    inputs = qa_inputs(spark, sf_dir).select(F.col("question").alias("query"), F.col("context").alias("text"), "_id", "_shard")
    reports.write_shards(inputs, folder)
    broken = inputs.where(F.col("_shard").isin("src3.csv", "src5.csv") & (F.col("_id") % 7 == 0))
    broken = broken.select(F.lit("q").alias("query"), F.lit("t").alias("text"), F.lit("1,surplus").alias("_id"), "_shard")
    # Without quotes the comma makes a field of its own.
    (broken.write.mode("append").partitionBy("_shard").options(header="true", quote="\0").csv(folder))
    good, bad = shards.load_and_check(spark, folder)
    loaded = good.groupBy("_shard").agg(F.count(F.lit(1)).alias("rows")).withColumn("state", F.lit("loaded"))
    return loaded.unionByName(bad.select("_shard", F.col("bad_rows").alias("rows"), F.lit("skipped").alias("state")))


# --- on a stored run ---------------------------------------------------------

def _stored(spark, sf_dir) -> RunStore:
    store = RunStore(spark, scratch_path(spark, "runs"))
    store.write(predictions(spark, sf_dir, keyed=True), RUN_ID, STAND_IN_MODELS)
    store.publish(RUN_ID)
    return store


def stored_agreement(spark, sf_dir):
    return _stored(spark, sf_dir).agreement_groups()


def stored_disagreement(spark, sf_dir):
    return _stored(spark, sf_dir).disagreement()


def stored_side_by_side(spark, sf_dir):
    rows = _stored(spark, sf_dir).read().withColumn("_id", F.col("_id").cast("bigint"))
    return disagreement.side_by_side(rows, disagreement.sample_pairs(rows))


def _in_batches(spark, sf_dir) -> RunStore:
    """A published run, and a later one of three batches, the second of them repeated; the later one is not published."""
    store = RunStore(spark, scratch_path(spark, "runs"))
    # Computed once; the batches are filters of it.
    rows = written(predictions(spark, sf_dir, keyed=True), "batches")
    store.write(rows.where(F.col("_id") % 2 == 0), "20260101_000000", STAND_IN_MODELS)
    store.publish("20260101_000000")
    for batch in (0, 1, 1, 2):
        store.write(rows.where(F.col("_id") % 3 == batch), RUN_ID, STAND_IN_MODELS, batch)
    return store


def streamed_run(spark, sf_dir):
    """What a reader sees while a run of several batches is written, and after it is published."""
    store = _in_batches(spark, sf_dir)
    seen = lambda step: store.read().groupBy("run_id", "batch").agg(F.count(F.lit(1)).alias("rows")).withColumn("step", F.lit(step))
    before = seen("before")
    store.publish(RUN_ID)
    return before.unionByName(seen("after"))


def merged_states(spark, sf_dir):
    """The metrics document of a run of three batches, from their states."""
    store = _in_batches(spark, sf_dir)
    store.publish(RUN_ID)
    return _round_doubles(metrics.document_rows(store.metrics_document()))


class _BreaksLater(Predictor):
    """Loads in the first task of a job, as the probe's, and on no other executor."""

    def load_model(self):
        if TaskContext.get().partitionId() > 0:
            raise OSError("weights are gone")

    def predict(self, questions, contexts):
        return [{"answer": q, "score": 1.0} for q in questions]


def late_model_failure(spark, sf_dir):
    """A run in which one model breaks after the start: rows per model that is left, messages of the others."""
    models = [Model("late", (_BreaksLater,)), Model("broken", (_CannotLoad,)), *stand_in_models().values()]
    run = evaluation.run_evaluation(spark, _csv_shards(spark, sf_dir), scratch_path(spark, "run"), models=models, extra=("_id",), run_id=RUN_ID)
    good = run.results.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.lit(None).cast("string").alias("error"))
    failed = spark.createDataFrame(sorted(run.failures.items()), "model string, error string").withColumn("rows", F.lit(0).cast("bigint"))
    return good.unionByName(failed)


def per_model_csv(spark, sf_dir):
    path = scratch_path(spark, "per-model")
    reports.write_per_model_csv(metrics.metrics_document(predictions(spark, sf_dir)), path)
    kinds = "model string, count bigint, mean_score double, median_score double, avg_overlap double"
    return _round_doubles(spark.read.schema(kinds).option("header", "true").csv(path))


def wide_csv(spark, sf_dir):
    folder = scratch_path(spark, "wide")
    reports.write_wide(predictions(spark, sf_dir), A, B, folder)
    back = spark.read.options(header="true", multiLine="true", quote='"', escape='"').csv(f"{folder}/wide.csv")
    numbers = ("lexical_score", "overlap_lexical", "echo_score", "overlap_echo", "score_difference", "overlap_difference")
    return _round_doubles(back.select(F.col("_id").cast("bigint").alias("_id"), "score_winner", "overlap_winner",
                                      *[F.col(c).cast("double").alias(c) for c in numbers]))


def correlation_csv(spark, sf_dir):
    path = scratch_path(spark, "correlation")
    reports.write_correlation_csv(predictions(spark, sf_dir), path)
    kinds = "metric string, score double, overlap double, question_length double, context_length double"
    return _round_doubles(spark.read.schema(kinds).option("header", "true").csv(path))


def run_metrics(spark, sf_dir):
    """A whole run from CSV shards to its stored metrics document."""
    run = evaluation.run_evaluation(spark, _csv_shards(spark, sf_dir), scratch_path(spark, "run"),
                                    models=list(stand_in_models().values()), extra=("_id",), run_id=RUN_ID)
    return _round_doubles(metrics.document_rows(run.metrics))


def _panel(df, name: str, item: str, *values: str):
    """A panel as rows ``panel, item, metric, value``."""
    entries = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
    return df.select(F.lit(name).alias("panel"), F.col(item).cast("string").alias("item") if item else F.lit("").alias("item"), F.inline(entries))


def _panels(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _round_doubles(out)


def home_panels(spark, sf_dir):
    p = evaluation.home_analysis(predictions(spark, sf_dir), 0.05)
    return _panels([
        _panel(p["headline"], "headline", "", "total_rows", "mean_question_words", "mean_question_chars", "mean_score", "mean_overlap"),
        _panel(p["model_stats"], "model_stats", "model", "scored", "score_mean"),
        _panel(p["performance"], "performance", "model", "mean_score"),
        _panel(p["score_histogram"], "score_histogram", "bin", "count"),
        _panel(p["best_model"], "best_model", "model", "mean_overlap")])


def advanced_panels(spark, sf_dir):
    p = evaluation.advanced_analysis(predictions(spark, sf_dir), (0.1, 0.75))
    return _panels([
        _panel(p["describe"], "describe", "model", "count", "mean", "q50"),
        _panel(p["trend_overlap"], "trend_overlap", "model", "points", "slope"),
        _panel(p["overlap_histogram"], "overlap_histogram", "bin", "count"),
        _panel(p["overlap_by_confidence"], "overlap_by_confidence", "", "overlap_high_score", "overlap_low_score"),
        _panel(p["correlation"], "correlation", "", "r")])


def study_panels(spark, sf_dir):
    p = evaluation.two_model_study(predictions(spark, sf_dir), A, B)
    return _panels([
        _panel(p["summary"], "summary", "", "total", "mean_lexical_score", "wins_lexical", "wins_echo", "ties"),
        _panel(p["tiers"], "tiers", "tier", "lexical_count", "echo_count"),
        _panel(p["risk"], "risk", "model", "risky", "explicit"),
        _panel(p["verdict"], "verdict", "", "lexical_pct", "echo_pct"),
        _panel(p["top10"], "top10", "_id", "best_score"),
        _panel(p["sample_means"], "sample_means", "", "sampled", "mean_overlap_lexical")])


QUERIES = {f.__name__: f for f in (
    shard_catalog, load_shards, shard_select, shard_stems, sample_cap, normalize_input, normalize_results,
    latest_run, run_timestamp, scan_results, consolidated, metrics_json, metrics_document, metrics_summary_lines,
    wide_summary, model_select, fanout_predict, predict_errors, model_failures, truncate_context,
    overlap, lengths, question_sizes, clean_text, overlap_clean, risk_band, overlap_tier, overlap_verdict,
    performance_tier, coerce_numeric, preview, filter_home, keyword_search, filter_advanced, filter_retention,
    overall_metrics, per_model_metrics, agreement_groups, avg_unique_answers, risk_counts, headline_metrics,
    model_stats, score_describe, best_model, overlap_by_confidence, corr_score_overlap, corr_matrix, corr_pairs,
    score_histogram, overlap_histogram, score_box, overlap_box, score_density, trend_qlen_score, trend_overlap_score,
    tier_distribution, risk_shares, win_counts, dataset_profile, sample_means, sample_wins, topk_model_counts,
    wide_compare, best_worst, pair_members, side_by_side, top10_best_model, bottom10_best_model,
    top10_global, bottom10_global, extreme_ids, extreme_rows, disagreement_sample, disagree_sample,
    wide_mixed_ids, extreme_mixed_ids, disagreement_edges, skipped_shards, stored_agreement, stored_disagreement,
    stored_side_by_side, per_model_csv, wide_csv, correlation_csv, run_metrics, home_panels, advanced_panels, study_panels,
    streamed_run, merged_states, late_model_failure)}
QUERIES["disagreement"] = disagreement_classes

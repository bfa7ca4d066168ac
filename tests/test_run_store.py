import json
import os
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from answerscope.operators import disagreement, metrics, predict
from answerscope.operators.predict import Model, Predictor
from answerscope.sinks.run_store import RunStore
from answerscope.sources.columns import annotate

OLD, NEW = "20260101_000000", "20260102_000000"
MODELS = ["a", "b", "häß/ slig", "1e5"]


def rows(spark, n=60, start=0, models=MODELS):
    """Pairs that come back in every batch, one of them in a third of all rows; null answers, scores and questions; ties."""
    pair = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11)
    long = spark.range(start, start + n).select("id", pair.alias("p"), F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    return annotate(long.select(
        F.col("id").cast("string").alias("_id"), F.when(F.col("p") != 5, F.concat(F.lit("q"), "p")).alias("question"),
        F.concat(F.lit("some text "), "p").alias("context"), "model", F.lit("").alias("error"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("some "), (F.xxhash64("id", "model") % 3).cast("string"))).alias("answer"),
        F.when(F.col("id") % 5 > 0, F.pmod(F.xxhash64("model", "id"), F.lit(17)) / 16).alias("score")))


def content(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select(*(columns or df.columns)).collect())


@pytest.fixture
def store(spark, tmp_path):
    return RunStore(spark, str(tmp_path / "runs"))


def test_nothing_is_seen_before_it_is_published(spark, store):
    assert store.latest() is None and store.runs().collect() == []
    with pytest.raises(LookupError):
        store.read()
    store.write(rows(spark, 10), OLD, MODELS)
    with pytest.raises(LookupError):
        store.read()
    store.publish(OLD)
    store.write(rows(spark, 20), NEW, MODELS)
    store.write(rows(spark, 20, 20), NEW, MODELS, 1)
    assert store.latest() == OLD and store.read().count() == 40
    store.publish(NEW)
    first = store.read()
    store.write(rows(spark, 7, 20), NEW, MODELS, 1)  # the batch is repeated
    store.write(rows(spark, 5, 40), NEW, MODELS, 2)
    assert store.latest() == NEW and store.read().count() == first.count() == 160
    store.publish(NEW)
    assert content(store.read().groupBy("batch").count()) == [("0", "80"), ("1", "28"), ("2", "20")]
    assert first.count() == 160 and store.read(OLD).count() == 40
    assert content(store.runs(), "run_id", "batches", "models", "rows") == [(OLD, "1", "4", "40"), (NEW, "3", "4", "128")]
    # Another object on the same folder sees the same.
    assert RunStore(spark, store.folder).read().count() == 128


def test_latest_opens_no_data(spark, store):
    store.write(rows(spark, 10), OLD, MODELS)
    store.publish(OLD)
    for top, _, files in os.walk(f"{store.folder}/rows"):
        for f in files:
            os.remove(f"{top}/{f}")
    assert store.latest() == OLD


def context_bytes(folder):
    """Bytes of the column ``context`` in the Parquet files below a folder."""
    files = [pq.read_metadata(f"{top}/{f}") for top, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    return sum(c.total_compressed_size for g in groups for c in map(g.column, range(g.num_columns)) if c.path_in_schema == "context")


def test_a_context_is_stored_once_for_all_models(spark, store, tmp_path):
    noise = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.sha2(F.concat_ws("-", i, "id"), 256)), "")
    texts = spark.range(200).repartition(2).withColumn("context", noise)
    texts.select("context").write.parquet(str(tmp_path / "texts"))
    long = texts.select(F.col("id").cast("string").alias("_id"), F.lit("q").alias("question"), "context",
                        F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"), F.lit("a").alias("answer"),
                        F.lit(0.5).alias("score"), F.lit("").alias("error"))
    store.write(annotate(long), NEW, MODELS)
    store.publish(NEW)
    assert store.read().count() == 800 and store.read().select("context").distinct().count() == 200
    assert 0 < context_bytes(f"{store.folder}/rows") < 1.5 * context_bytes(tmp_path / "texts")


def test_attempts_that_differ_in_their_models(spark, store):
    store.write(rows(spark, 20), NEW, MODELS)
    again = ["a", "1e5"]  # these come from the later attempt, the others from the first
    store.write(rows(spark, 7, models=again), NEW, again)
    store.write(rows(spark, 5, 20), NEW, MODELS, 1)
    store.publish(NEW)
    assert content(store.read().groupBy("model", "batch").count()) == sorted(
        (m, b, str(n)) for m in MODELS for b, n in (("0", 7 if m in again else 20), ("1", 5)))


def test_runs_in_one_folder_per_model_are_still_read(spark, store, tmp_path):
    store.write(rows(spark), NEW, MODELS)
    store.publish(NEW)
    old = RunStore(spark, str(tmp_path / "old"))
    shutil.copytree(f"{store.folder}/log", f"{old.folder}/log")
    for attempt in os.listdir(f"{store.folder}/rows/{NEW}"):
        kept = spark.read.parquet(f"{store.folder}/rows/{NEW}/{attempt}")
        folder = F.when(F.col("model").isin("a", "1e5"), F.col("model")).otherwise(F.concat(F.lit("x"), F.lower(F.hex("model"))))
        kept.withColumn("part", folder).write.partitionBy("part").parquet(f"{old.folder}/rows/{NEW}/{attempt}")
    assert old.read().columns == store.read().columns
    assert content(old.read()) == content(store.read())


def test_rows_come_back(spark, store):
    given = rows(spark)
    store.write(given, NEW, MODELS)
    store.publish(NEW)
    shared = ["_id", "question", "context", "model", "answer", "score", "overlap", "context_length"]
    assert content(store.read(), *shared) == content(given, *shared)
    with pytest.raises(ValueError):
        store.write(given, NEW, ["a"], 1)


def test_merged_states_equal_a_recomputation(spark, store):
    for batch in range(3):
        store.write(rows(spark, 50, 50 * batch), NEW, MODELS, batch)
    store.publish(NEW)
    everything = rows(spark, 150)
    assert content(store.read(), "_id", "model", "score") == content(everything, "_id", "model", "score")
    assert content(store.agreement_groups()) == content(metrics.agreement_groups(everything))
    assert content(store.disagreement()) == content(disagreement.disagreement(everything))
    both = [metrics.document_rows(d).withColumn("value", F.round("value", 9)) for d in (store.metrics_document(), metrics.metrics_document(everything))]
    assert content(both[0]) == content(both[1])


def test_states_need_no_rows(spark, store):
    """Agreement and metrics read the states alone."""
    store.write(rows(spark), NEW, MODELS)
    store.publish(NEW)
    want = content(metrics.document_rows(store.metrics_document()))
    for top, _, files in os.walk(f"{store.folder}/rows"):
        for f in files:
            os.remove(f"{top}/{f}")
    assert content(metrics.document_rows(store.metrics_document())) == want


def test_agreement_has_no_exchange_by_pair(spark, store):
    for batch in range(2):
        store.write(rows(spark, 50, 50 * batch), NEW, MODELS, batch)
    store.publish(NEW)
    for df in (store.agreement_groups(), store.disagreement()):
        assert df.count() > 5
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    """Rows that the Parquet scans of a collected query have handed on."""
    found, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plan = plan.executedPlan()
        if plan.nodeName().startswith("Scan parquet"):
            found += plan.metrics().get("numOutputRows").get().value()
        if plan.nodeName().endswith("QueryStage"):
            plans.append(plan.plan())
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def test_a_few_pairs_skip_row_groups(spark, store):
    spark.conf.set("parquet.block.size", "4096")
    try:
        many = spark.range(20_000).select(F.col("id").cast("string").alias("_id"), F.concat(F.lit("q"), "id").alias("question"),
                                          F.concat(F.lit("c"), "id").alias("context"), F.lit("a").alias("model"), F.lit("x").alias("answer"),
                                          F.lit("").alias("error"), F.rand(1).alias("score"), F.rand(2).alias("overlap")).repartition(2)
        store.write(many, NEW, ["a"])
    finally:
        spark.conf.unset("parquet.block.size")
    store.publish(NEW)
    df = store.read()
    few = lambda which: spark.createDataFrame(disagreement.with_pair(df.where(which)).select("_pair").collect(), "_pair binary")
    pairs = few("_id in ('3', '4444', '17000')")
    found = disagreement.pair_members(df, pairs)
    assert sorted(r["_id"] for r in found.collect()) == ["17000", "3", "4444"]
    assert 3 <= scanned(found) <= 2000
    # More pairs than are looked up one by one are joined.
    pairs = few("_id < 20")
    assert disagreement.pair_members(df, pairs).count() == pairs.count() > disagreement.LOOKED_UP


def predictors():
    """Defined in a function, so that they travel to the workers by value."""
    class Fine(Predictor):
        def predict(self, questions, contexts):
            return [{"answer": q, "score": 0.5} for q in questions]

    class KillsItsWorker(Fine):
        def predict(self, questions, contexts):
            os._exit(3)

    class LoadsInTheFirstTask(Fine):
        def load_model(self):
            from pyspark import TaskContext

            if TaskContext.get().partitionId() > 0:
                raise OSError("lost")

    return Fine, KillsItsWorker, LoadsInTheFirstTask


FINE, KILLS, BREAKS = predictors()


def inputs(spark, n=12, partitions=4):
    return spark.range(n).repartition(partitions).select(
        F.col("id").cast("string").alias("_id"), F.concat(F.lit("q"), "id").alias("question"), F.concat(F.lit("c "), "id").alias("context"))


def test_a_model_that_breaks_in_some_tasks_is_absent(spark, store):
    models = [Model("fine", (FINE,)), Model("breaks", (BREAKS,))]
    assert predict.load_failures(spark, models) == {}
    assert store.evaluate(inputs(spark), models, NEW, 0) == {"breaks": "lost"}
    # It is not tried again in this run, and an earlier batch of it would not be published either.
    assert store.evaluate(inputs(spark), models, NEW, 1) == {}
    store.publish(NEW)
    assert content(store.read().groupBy("model", "batch").count()) == [("fine", "0", "12"), ("fine", "1", "12")]
    assert content(store.failures(NEW)) == [("breaks", "0", "lost")]


def test_a_model_that_breaks_in_a_later_batch_is_left_out_whole(spark, store):
    fine, other = Model("fine", (FINE,)), Model("other", (FINE,))
    assert store.evaluate(inputs(spark), [fine, other], NEW, 0) == {}
    store.fail(NEW, "other", "gone", 1)
    store.publish(NEW)
    assert content(store.read().groupBy("model").count()) == [("fine", "12")]
    assert content(store.agreement_groups().agg(F.sum("n_predictions"))) == [("12",)]
    with pytest.raises(LookupError):
        store.publish(OLD)


def test_a_model_that_takes_the_worker_down(spark, store):
    models = [Model("fine", (FINE,)), Model("kills", (KILLS,)), Model("also", (FINE,))]
    failed = store.evaluate(inputs(spark), models, NEW, 0)
    assert set(failed) == {"kills"} and failed["kills"]
    store.publish(NEW)
    assert content(store.read().groupBy("model").count()) == [("also", "12"), ("fine", "12")]


def test_empty_input(spark, store):
    assert store.evaluate(inputs(spark, 0), [Model("fine", (FINE,))], NEW, 0) == {}
    store.publish(NEW)
    assert store.read().collect() == [] and "model" in store.read().columns
    assert store.agreement_groups().collect() == []
    assert store.metrics_document().first().overall.total_predictions == 0


def test_entries_are_json_lines(spark, store):
    store.write(rows(spark, 5), NEW, MODELS)
    store.publish(NEW)
    lines = [json.loads(x) for top, _, files in os.walk(f"{store.folder}/log") for f in files if f.startswith("part-") for x in open(f"{top}/{f}")]
    assert [x["kind"] for x in sorted(lines, key=lambda x: x["at"])] == ["begin", "part", "part", "part", "part", "run"]


def test_task_attempts(spark):
    assert predict._task_attempts(spark) == 1

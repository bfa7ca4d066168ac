import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from answerscope.operators import predict
from answerscope.operators.predict import Model, Predictor
from answerscope.fixtures.predictors import LeadPredictor, stand_in_models
from answerscope.plans.evaluation import advanced_analysis, home_analysis, run_evaluation, two_model_study
from answerscope.sinks.run_store import RunStore
from answerscope.sources import results
from answerscope.streaming.ingest import evaluate_new_shards, finish, shard_stream


def test_model_selection():
    registry = predict.registered_models()
    assert list(registry) == ["distilbert", "roberta", "bert"]
    keys = lambda s: [m.key for m in predict.select_models(s, registry)]
    assert keys("all") == keys(["x", "all"]) == ["distilbert", "roberta", "bert"]
    assert keys(["bert", "nope"]) == ["bert"] and keys("roberta") == ["roberta"]
    assert keys(["bert", "distilbert", "bert"]) == ["bert", "distilbert", "bert"]
    assert keys([]) == keys("") == keys(None) == []
    assert len(registry["distilbert"].candidates) == 2 and len(registry["bert"].candidates) == 1


def test_models_need_their_package():
    with pytest.raises(ImportError):
        predict._load(predict.registered_models()["bert"])


def inputs(spark, n=10, partitions=1):
    return spark.range(n).select(F.col("id").cast("string").alias("_id"), F.concat(F.lit("q"), "id").alias("question"),
                                 F.concat(F.lit("c. "), "id").alias("context")).coalesce(partitions)


def test_failing_batch_marks_all_its_rows(spark):
    class Moody(Predictor):
        def predict(self, questions, contexts):
            if "q4" in questions:
                raise ValueError("no q4 please")
            return [{"answer": q, "start": 1, "end": 2} for q in questions]

    out = predict.fan_out(inputs(spark), [Model("moody", (Moody,))], batch_size=3)
    got = {r["_id"]: r for r in out.collect()}
    assert len(got) == 10
    for i in range(10):
        r = got[str(i)]
        if i in (3, 4, 5):
            assert (r.answer, r.score, r.error) == ("", 0.0, "no q4 please")
        else:
            assert (r.answer, r.score, r.start, r.end, r.error) == (f"q{i}", 0.0, 1, 2, "")
        assert r.model == "moody" and r.context == f"c. {i}" and r.model_error is None


def test_wrong_number_of_results_is_an_error(spark):
    class Short(Predictor):
        def predict(self, questions, contexts):
            return [{"answer": "x", "score": float("nan")}]

    rows = predict.fan_out(inputs(spark, 3), [Model("short", (Short,))], batch_size=2).collect()
    assert sorted((r.answer, r.score) for r in rows if r.error) == [("", 0.0)] * 2
    assert [(r.answer, r.score) for r in rows if not r.error] == [("x", None)]


def test_failed_model_and_fallback(spark):
    class Broken(Predictor):
        def load_model(self):
            raise OSError("gone")

    models = [Model("broken", (Broken,)), Model("saved", (Broken, LeadPredictor)), Model("saved", (LeadPredictor,))]
    raw = predict.fan_out(inputs(spark, 20, 4), models)
    assert [tuple(r) for r in predict.failed_models(raw).collect()] == [("broken", "gone", 20)]
    good = predict.without_models(raw, ["broken"])
    assert good.count() == 20 and {r.answer for r in good.collect()} == {"c"}
    with pytest.raises(ValueError):
        predict.fan_out(inputs(spark), [])


def test_context_limit_and_extra_columns(spark):
    class Look(Predictor):
        def predict_rows(self, rows):
            return [{"answer": f"{i}:{c}", "score": 1} for i, c in zip(rows["_id"], rows["context"])]

    rows = predict.fan_out(inputs(spark, 2), [Model("look", (Look,))], context_limit=2, extra=("_id",)).collect()
    assert [(r.answer, r.context) for r in rows] == [("0:c.", "c. 0"), ("1:c.", "c. 1")]


def write_shard(folder, name, ids):
    lines = ["query,text,_id"] + [f"where is x{i},x{i} is here. And there.,{i}" for i in ids]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_run_evaluation(spark, tmp_path):
    class Broken(Predictor):
        def load_model(self):
            raise OSError("gone")

    folder = tmp_path / "shards"
    folder.mkdir()
    write_shard(folder, "a.csv", range(1, 9))
    write_shard(folder, "b.csv", range(9, 13))
    models = [*stand_in_models().values(), Model("broken", (Broken,))]
    run = run_evaluation(spark, str(folder), str(tmp_path / "out"), ["a.csv", "b*"], models, extra=("_id",),
                         run_id="20260102_030405", csv="csv.gz")
    assert run.failures == {"broken": "gone"}
    assert run.results.count() == 36
    assert set(run.results.columns) == {"_id", "context", "question", "_shard", "context_length", "question_length",
                                        "model", "answer", "score", "overlap", "error", "pair_key", "row_id", "run_id", "batch"}
    document = run.metrics.first().asDict(recursive=True)
    assert document["overall"]["total_predictions"] == 36 and set(document["per_model"]) == set(stand_in_models())
    path = results.find_latest_results(spark, str(tmp_path / "out"))
    assert path == f"{run.run_folder}/results_consolidated.csv.gz"
    assert results.scan_results(spark, path).count() == 36
    for panels in (home_analysis(run.results), advanced_analysis(run.results), two_model_study(run.results, "lead", "echo")):
        for name, panel in panels.items():
            panel.collect(), name
    two_model_study(run.results, "lead", "echo", cleaned=True)["tiers"].collect()
    nameless = run.results.drop("model")
    for panels in (home_analysis(nameless, models=["lead"]), advanced_analysis(nameless, models=["lead"])):
        assert "model_stats" not in panels and "describe" not in panels
        for panel in panels.values():
            panel.collect()
    capped = run_evaluation(spark, str(folder), str(tmp_path / "small"), "all", models[:1], max_samples=3)
    assert sorted(r["_id"] for r in capped.results.collect()) == ["1", "2", "3"]
    with pytest.raises(RuntimeError):
        run_evaluation(spark, str(folder), str(tmp_path / "none"), "all", models[3:])


def test_views_read_the_table_once(spark, tmp_path):
    """Panels are those of the whole table, and none of them opens its files again."""
    from answerscope.operators import compare, distributions, filters

    spark.range(120).selectExpr(
        "id % 40 as _id", "concat('q', id % 7) as question", "concat('c', id % 40) as context",
        "element_at(array('lead', 'echo', 'other', null), cast(id % 4 as int) + 1) as model",
        "if(id % 11 = 0, null, concat('a', id % 3)) as answer", "if(id % 13 = 0, null, id * 37 % 101 / 100D) as score",
        "id * 53 % 97 / 96D as overlap", "id % 9 as question_length", "id % 17 as context_length").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    source = set(df.inputFiles())
    rows = lambda d: sorted(map(str, d.collect()))
    study = two_model_study(df, "lead", "echo")
    advanced = advanced_analysis(df, (0.1, 0.9))
    for name, panel in {**study, **advanced}.items():
        assert source.isdisjoint(panel.inputFiles()), name
    kept = filters.filter_advanced(df, (0.1, 0.9))
    for panel, want in ((study["wide"], compare.wide_compare(df, "lead", "echo")), (study["tiers"], compare.tier_distribution(df, "lead", "echo")),
                        (study["top10"], compare.global_extremes(df, ("lead", "echo"), True)), (study["sample"], compare.sample_differing(df, "lead", "echo")),
                        (advanced["box"], distributions.box_summary(kept)), (advanced["overlap_histogram"], distributions.histogram(kept, "overlap", 30))):
        assert panel.columns == want.columns and rows(panel) == rows(want)


def test_inputs_without_ids_are_numbered(spark, tmp_path):
    folder = tmp_path / "shards"
    folder.mkdir()
    (folder / "a.csv").write_text("question,context\nq,c\nq,c\nq2,c\n")
    run = run_evaluation(spark, str(folder), str(tmp_path / "out"), models=[stand_in_models()["lead"]])
    assert run.results.select("_id").distinct().count() == 3 and run.skipped.collect() == []


def test_inputs_are_told_apart_without_ids(spark, tmp_path):
    """Shards with ids, with the same ids again, and without: every input keeps its row and its texts."""
    folder = tmp_path / "shards"
    folder.mkdir()
    (folder / "a.csv").write_text("query,text\n" + "".join(f"qa{i},ca{i}. x\n" for i in range(7)))
    for name in "bc":
        (folder / f"{name}.csv").write_text("_id,query,text\n" + "".join(f"{i},q{name}{i},c{name}{i}. x\n" for i in range(3)))
    models = [stand_in_models()["lead"], stand_in_models()["lexical"]]
    run = run_evaluation(spark, str(folder), str(tmp_path / "out"), models=models)
    wide = two_model_study(run.results, "lead", "lexical")["wide"]
    assert wide.count() == 13
    from answerscope.operators.compare import wide_compare
    rows = wide_compare(run.results, "lead", "lexical", with_text=True).collect()
    assert len(rows) == 13 and all(r.question[1:] == r.context[1:].split(".")[0] for r in rows)
    # A result without row ids falls back on the id and the pair.
    assert wide_compare(run.results.drop("row_id"), "lead", "lexical").count() == 13


def test_new_shards_are_evaluated_once(spark, tmp_path):
    folder = tmp_path / "arriving"
    folder.mkdir()
    store = RunStore(spark, str(tmp_path / "runs"))
    models = [stand_in_models()["lead"], stand_in_models()["lexical"]]

    def run():
        stream = shard_stream(spark, str(folder), ["query", "text", "_id"])
        finish(evaluate_new_shards(stream, models, store, str(tmp_path / "checkpoint"), "20260101_000000"), store, "20260101_000000")

    write_shard(folder, "a.csv", range(3))
    run()
    write_shard(folder, "b.csv", range(3, 5))
    run()
    run()
    stored = store.read()
    assert stored.count() == 10
    assert {(r.run_id, r.batch, r["_shard"]) for r in stored.select("run_id", "batch", "_shard").distinct().collect()} == {
        ("20260101_000000", 0, "a.csv"), ("20260101_000000", 1, "b.csv")}
    write_shard(folder, "c.csv", [7])
    (folder / "d.csv").write_text("query,text,_id\nq,c,8\nq,c,9,more\n")
    (folder / "e.csv").write_text("query,text,_id\nq,c\n")
    run()
    latest = store.read()
    assert latest.count() == 14 and {r["_shard"] for r in latest.where("batch > 1").collect()} == {"c.csv", "e.csv"}


def test_stream_with_many_batches_is_one_run(spark, tmp_path):
    folder = tmp_path / "arriving"
    folder.mkdir()
    for i in range(3):
        write_shard(folder, f"{i}.csv", [i + 1])
    stream = shard_stream(spark, str(folder), ["query", "text", "_id"], files_per_batch=1)
    store = RunStore(spark, str(tmp_path / "t"))
    finish(evaluate_new_shards(stream, [stand_in_models()["lead"]], store, str(tmp_path / "c"), "20260101_000000"), store, "20260101_000000")
    latest = store.read()
    assert latest.count() == 3 and latest.select("batch").distinct().count() == 3


def test_stream_refuses_another_header(spark, tmp_path):
    folder = tmp_path / "arriving"
    folder.mkdir()
    (folder / "a.csv").write_text("text,query,_id\nCTX,q,1\n")
    stream = shard_stream(spark, str(folder), ["_id", "query", "text"])
    q = evaluate_new_shards(stream, [stand_in_models()["lead"]], RunStore(spark, str(tmp_path / "t")), str(tmp_path / "c"), "20260101_000000")
    with pytest.raises(StreamingQueryException):
        q.awaitTermination(120)

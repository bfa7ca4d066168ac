import gzip
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from answerscope.operators import metrics
from answerscope.sinks import reports
from answerscope.sources import columns, results, shards


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.csv": 'query,text,_id\nwho,"line one\nline ""two""",1\nNA,null,2\n',
        "b.csv": "_id,text,query,title\n3,some text,what,T\n4,short\n",
        "bad.csv": "query,text,_id\nq,t,5\nq,t,6,surplus\n",
        "empty.csv": "",
        "shard_01.csv": "query,text,_id\nwhen, padded ,7\n",
        "shard_02.csv": "query,text,_id\nwhere,a+b %20,8\n",
        "notes.txt": "not a shard",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "deep.csv").write_text("query,text\nx,y\n")
    return str(tmp_path)


def ids(df):
    return sorted(r["_id"] for r in df.collect())


def test_catalog_and_selection(spark, folder):
    names = [r["_shard"] for r in shards.shard_catalog(spark, folder).collect()]
    assert names == ["a.csv", "b.csv", "bad.csv", "empty.csv", "shard_01.csv", "shard_02.csv"]
    listed = spark.createDataFrame([(n,) for n in names], "_shard string")

    def chosen(selection):
        return [r[0] for r in listed.where(shards.selection_filter(selection)).orderBy("_shard").collect()]

    assert chosen("all") == names and chosen(["x", "all"]) == names
    assert chosen([]) == chosen("") == chosen(None) == []
    assert chosen("shard_*.csv") == ["shard_01.csv", "shard_02.csv"]
    assert chosen("shard_0[!1].csv") == ["shard_02.csv"]
    assert chosen(["shard_?1*", "a.csv", "a.csv"]) == ["a.csv", "shard_01.csv"]
    assert chosen("a") == [] and chosen("a?csv") == ["a.csv"]
    assert [r.stem for r in shards.shard_stems(listed).collect()] == ["shard_01", "shard_02"]
    assert shards.shard_exists(spark, folder, "shard_01") and not shards.shard_exists(spark, folder, "shard_055")
    assert shards.shard_catalog(spark, folder + "/absent").collect() == []


def test_load(spark, folder):
    df = shards.load_shards(spark, folder).cache()
    assert ids(df) == ["1", "2", "3", "4", "7", "8"]
    by_id = {r["_id"]: r for r in df.collect()}
    assert by_id["1"].text == 'line one\nline "two"' and by_id["1"]["_shard"] == "a.csv"
    assert (by_id["2"]["query"], by_id["2"].text) == (None, None)
    assert (by_id["3"]["query"], by_id["3"].title) == ("what", "T")
    assert (by_id["4"]["query"], by_id["4"].title, by_id["4"].text) == (None, None, "short")
    assert by_id["7"].text == " padded " and by_id["8"].text == "a+b %20"
    assert sorted((r["_shard"], r.bad_rows) for r in shards.skipped_shards(spark, folder).collect()) == [("bad.csv", 1), ("empty.csv", 0)]
    assert ids(shards.load_shards(spark, folder, skip_bad=False)) == ["1", "2", "3", "4", "5", "6", "7", "8"]
    assert ids(shards.load_shards(spark, folder, ["shard_*", "a.csv"])) == ["1", "2", "7", "8"]
    assert shards.load_shards(spark, folder, "nothing*").collect() == []
    assert shards.load_shards(spark, folder, "bad.csv").collect() == []


def test_partitioned_shards(spark, tmp_path):
    df = spark.createDataFrame([("1", "q", 'a "b",\nc', "s one.csv"), ("2", "", None, "s+2.csv")],
                               "_id string, query string, text string, _shard string")
    folder = str(tmp_path / "parts")
    reports.write_shards(df, folder)
    assert [r["_shard"] for r in shards.shard_catalog(spark, folder).collect()] == ["s one.csv", "s+2.csv"]
    back = {r["_id"]: r for r in shards.load_shards(spark, folder).collect()}
    assert (back["1"].text, back["1"]["_shard"]) == ('a "b",\nc', "s one.csv")
    assert (back["2"]["query"], back["2"].text, back["2"]["_shard"]) == (None, None, "s+2.csv")


def test_shard_of_good_and_bad_files_is_left_out_whole(spark, tmp_path):
    for name, body in {"_shard=x.csv/1.csv": "query,text\nq1,t\nq2,t\n", "_shard=x.csv/2.csv": "query,text\nq3,t,more\n",
                       "_shard=y.csv/1.csv": "text,query\nt,q4\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    good, bad = shards.load_and_check(spark, str(tmp_path))
    assert [(r["_shard"], r["query"]) for r in good.collect()] == [("y.csv", "q4")]
    assert [tuple(r) for r in bad.select("_shard", "bad_rows").collect()] == [("x.csv", 1)]


def test_first_rows_in_a_stated_order(spark):
    df = spark.createDataFrame([("b", "1", "t"), ("a", "2", "t"), ("a", "2", "t"), ("a", "1", "t"), ("a", None, "t")],
                               "_shard string, _id string, context string")
    assert sorted((r["_shard"], str(r["_id"])) for r in columns.head_rows(df, 3).collect()) == [("a", "1"), ("a", "2"), ("a", "None")]
    assert columns.head_rows(df, 4).count() == 4 and columns.head_rows(df, 40).count() == 5


def _multiset(df):
    return df.groupBy(*df.columns).count().orderBy(*df.columns).collect()


def test_cap_of_any_size_with_a_row_repeated_for_a_third(spark):
    many = spark.range(3000).selectExpr(
        "concat('s', id % 3) as _shard", "if(id % 3 = 1, 'hot', nullif(cast(id * 7919 % 500 as string), '7')) as _id",
        "if(id % 3 = 1, 'same', concat('t', id % 4)) as context", "if(id % 3 = 1, null, id % 2) as place")
    hashed = many.withColumns(columns._row_hashes(many))
    for count in (0, 1, 999, 1500, 1600, 2000, 2999, 3000, 5000):
        want = hashed.orderBy("_shard", "_id", "h1", "h2").limit(count).drop("h1", "h2")
        got = columns.head_rows(many, count)
        assert got.columns == many.columns and _multiset(got) == _multiset(want), count
    assert columns.head_rows(many.where("1 = 0"), 5).collect() == []
    assert columns.head_rows(many.drop("_shard", "_id"), 1700).count() == 1700


def test_cap_reads_texts_once_and_shuffles_none(spark, tmp_path):
    spark.range(2000).selectExpr("concat('s', id % 2) as _shard", "id as _id", "'text' as context").write.parquet(str(tmp_path / "rows"))
    got = columns.head_rows(spark.read.parquet(str(tmp_path / "rows")), 1000)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    # The one row that is multiplied is all that moves.
    assert "Join" not in plan and "Window" not in plan and "TakeOrdered" not in plan and got.count() == 1000


def test_copies_are_made_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(columns, "COPIES_PER_ROW", 100)
    one = spark.sql("select struct(1 as a) as row")
    for n in (0, 1, 99, 100, 101, 250):
        assert columns._times(one, F.lit(n).cast("long")).count() == n


def test_row_ids(spark):
    df = spark.createDataFrame([("q", None), ("q", "7"), ("q2", "7")], "question string, _id string")
    rows = columns.with_row_id(df).collect()
    assert len({r.row_id for r in rows}) == 3 and sorted(r["_id"] for r in rows)[-2:] == ["7", "7"]
    assert all(r["_id"] for r in rows)


def test_input_names(spark):
    one = spark.createDataFrame([("q", "c")], "query string, text string")
    assert columns.normalize_input(one).columns == ["question", "context"]
    partly = spark.createDataFrame([("q", "c", "old")], "query string, text string, question string")
    assert columns.normalize_input(partly).select("question").first()[0] == "q"
    fuzzy = spark.createDataFrame([("q", "c", 1)], "UserQuestion string, my_text string, n int")
    assert columns.normalize_input(fuzzy, fuzzy=True).select("question", "context").first() == ("q", "c")
    with pytest.raises(ValueError):
        columns.normalize_input(fuzzy)
    with pytest.raises(ValueError):
        columns.normalize_input(spark.range(1), fuzzy=True)


def test_result_names(spark):
    df = spark.createDataFrame([("q", "a b", "a", "0.5", "x", "m", 1)],
                               "Prompt string, PREDICTION string, passage string, confidence string, overlap string, Model_Name string, n int")
    out = columns.normalize_results(df)
    assert out.columns == ["question", "answer", "context", "score", "overlap", "model", "n", "_id"]
    assert columns.normalize_results(df.withColumn("_id", F.lit("7"))).first()["_id"] == "7"
    assert (out.first().score, out.first().overlap) == (0.5, None)
    assert columns.normalize_results(df.drop("overlap")).first().overlap == 0.5
    both = columns.result_aliases(["query", "Question", "model_name", "model"])
    assert (both["question"], both["model"]) == ("Question", "model")
    with pytest.raises(ValueError, match="answer, score"):
        columns.normalize_results(spark.createDataFrame([("q", "c")], "question string, context string"))


def test_run_ids(spark):
    df = spark.createDataFrame([("20260202_164950",), ("20261399_000000",), ("draft",), ("20260101_000000",)], "run_id string")
    labels = [r[0] for r in df.select(results.run_label(F.col("run_id"))).collect()]
    assert labels == ["02/02/2026 - 16:49:50", "20261399_000000", "draft", "01/01/2026 - 00:00:00"]
    valid = df.where("run_id <> '20261399_000000'")
    assert [r.run_id for r in results.latest_run(valid).collect()] == ["20260202_164950"]


CSV = "_id,question,context,model,answer,score,overlap\n1,q,c,m,NA,bad,0.5\n2,q,c,m,a,0.25,\n"


def test_latest_results(spark, tmp_path):
    root = str(tmp_path / "out")
    assert results.find_latest_results(spark, root) is None
    os.makedirs(f"{root}/deep/er")
    (tmp_path / "out/deep/er/results_consolidated.csv").write_text(CSV)
    assert results.find_latest_results(spark, root) == f"{root}/deep/er/results_consolidated.csv"
    os.makedirs(f"{root}/adhoc")
    (tmp_path / "out/adhoc/results_consolidated.csv").write_text(CSV)
    assert results.find_latest_results(spark, root) == f"{root}/adhoc/results_consolidated.csv"
    for run in ("20260101_000000", "20260202_000000"):
        os.makedirs(f"{root}/{run}")
        (tmp_path / "out" / run / "results_consolidated.csv").write_text(CSV)
    os.utime(f"{root}/20260101_000000/results_consolidated.csv", (time.time() + 90, time.time() + 90))
    assert results.find_latest_results(spark, root) == f"{root}/20260202_000000/results_consolidated.csv"
    with gzip.open(f"{root}/20260202_000000/results_consolidated.csv.gz", "wt") as f:
        f.write(CSV)
    path = results.find_latest_results(spark, root)
    assert path == f"{root}/20260202_000000/results_consolidated.csv.gz"
    rows = [(r.answer, r.score, r.overlap) for r in results.scan_results(spark, path).orderBy("_id").collect()]
    assert rows == [(None, None, 0.5), ("a", 0.25, None)]


ROW = [("1", "q", "c\nd", "m1", "a", 0.5, 1.0), ("2", "q2", "c", "m1", None, None, 0.0), ("1", "q", "c\nd", "m2", "b, \"c\"", 0.9, 0.5)]


@pytest.mark.parametrize("packed", [False, True])
def test_csv_export_reads_back(spark, table, tmp_path, packed):
    path = reports.write_results_csv(table(ROW), str(tmp_path / "20260101_000000"), gzip=packed)
    back = sorted((r["_id"], r.model, r.question, r.context, r.answer, r.score, r.overlap) for r in
                  results.scan_results(spark, path).collect())
    assert back == sorted((i, m, q, c, a, s, o) for i, q, c, m, a, s, o in ROW)
    found = results.find_latest_results(spark, str(tmp_path))
    assert found == path
    assert results.scan_results(spark, path.removesuffix(".gz")).count() == 3


def test_predictions_table_replaces_a_run(spark, table, tmp_path):
    path = str(tmp_path / "predictions")
    for run in ("20260101_000000", "20260102_000000", "20260102_000000"):
        reports.write_predictions(table(ROW), path, run)
    stored = spark.read.parquet(path)
    assert stored.count() == 6
    latest = results.latest_run(stored)
    assert latest.count() == 3
    assert metrics.agreement_groups(latest).count() == 2
    latest.count()
    assert "PartitionFilters" in latest._jdf.queryExecution().executedPlan().toString()


def test_reports(spark, table, tmp_path):
    df = table(ROW).withColumns({"question_length": F.length("question"), "context_length": F.length("context")})
    doc = metrics.metrics_document(df)
    reports.write_metrics_json(doc, str(tmp_path / "metrics.json"))
    text = spark.read.text(str(tmp_path / "metrics.json")).first().value
    parsed = json.loads(text)
    assert list(parsed) == ["overall", "per_model", "comparative", "categorical"]
    assert parsed["overall"] == {"total_predictions": 3, "avg_overlap": 0.5}
    assert parsed["per_model"]["m2"]["mean_score"] == 0.9
    reports.write_summary(doc, str(tmp_path / "summary.md"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "summary.md")).collect()]
    assert lines[:8] == ["# Metrics Summary", "", "## Overall", "- total_predictions: 3", "- avg_overlap: 0.5", "",
                         "## Per Model", "### m1"]
    assert lines[8:12] == ["- count: 2", "- mean_score: 0.5", "- median_score: 0.5", "- avg_overlap: 0.5"]
    reports.write_per_model_csv(doc, str(tmp_path / "per_model.csv"))
    head = spark.read.option("header", True).csv(str(tmp_path / "per_model.csv"))
    assert head.columns == ["model", "count", "mean_score", "median_score", "avg_overlap"] and head.count() == 2
    reports.write_wide(df, "m1", "m2", str(tmp_path / "wide"))
    assert spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "wide/wide.csv")).count() == 2
    reports.write_correlation_csv(df, str(tmp_path / "corr.csv"))
    square = spark.read.option("header", True).csv(str(tmp_path / "corr.csv"))
    assert square.columns == ["metric", "score", "overlap", "question_length", "context_length"]
    assert [r.metric for r in square.collect()] == square.columns[1:]


def test_summary_without_scores(table):
    document = metrics.metrics_document(table([("1", "q", "c", "m", "a", None, 0.0)]))
    lines = [r.line for r in reports.summary_lines(document).orderBy("ord").collect()]
    assert lines[-4:] == ["- count: 1", "- mean_score: None", "- median_score: None", "- avg_overlap: 0.0"]

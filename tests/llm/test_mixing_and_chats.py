import math

from conftest import HARD
from pyspark.sql import functions as F

from answerscope.llm import chat_format as chats
from answerscope.llm.chat_format import chat_format
from answerscope.llm.mixing import cumulative, mix_sources, poisson, rates


def test_poisson_numbers(spark):
    ids = spark.range(20_000)
    for rate in (0.0, 0.3, 2.5, 16.0, 40.0):
        parts = max(1, math.ceil(rate / 16))
        n = poisson(cumulative(F.lit(rate / parts)), F.lit(parts), F.lit("7"), F.col("id").cast("string"))
        mean, variance = ids.select(n.alias("n")).agg(F.avg("n"), F.var_pop("n")).first()
        assert abs(mean - rate) < 0.05 * rate + 0.01 and abs(variance - rate) < 0.08 * rate + 0.01


def test_rates_meet_target_weights(spark):
    rows = [(i, "abcd" * 50, "big") for i in range(3000)] + [(3000 + i, "abcd" * 50, "small") for i in range(300)] + [(9999, "x" * 200, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    table = {r.source: r for r in rates(docs, {"big": 1.0, "small": 3.0}).collect()}
    assert abs(table["big"].rate - 0.25 * 3301 / 3000) < 1e-9 and abs(table["small"].rate - 0.75 * 3301 / 300) < 1e-9
    assert table[None].rate == 0
    out = mix_sources(docs, {"big": 1.0, "small": 3.0}, seed=3)
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(counts["big"] / 3301 - 0.25) < 0.03 and abs(counts["small"] / 3301 - 0.75) < 0.06 and None not in counts
    again = mix_sources(docs.repartition(7), {"big": 1.0, "small": 3.0}, seed=3)
    key = lambda df: sorted((r.doc_id, r.copy, r.shuffle_key) for r in df.select("doc_id", "copy", "shuffle_key").collect())
    assert key(out) == key(again) and len({k[2] for k in key(out)}) == len(key(out))
    weights = spark.createDataFrame([("big", 1.0), (None, 1.0)], "source string, weight double")
    assert {r.source for r in rates(docs, weights).where("rate > 0").collect()} == {"big", None}


def test_mixing_hard_rows(hard, nothing):
    out = mix_sources(hard, 0.5, epochs=3.0, seed=1)
    assert sorted(out.columns) == sorted([*hard.columns, "shuffle_key"]) and dict(out.dtypes)["copy"] == "bigint"
    n = {}
    for r in out.collect():
        n[str(r.doc_id)] = n.get(str(r.doc_id), 0) + 1
    assert 0.5 * 3 * len(HARD) < sum(n.values()) < 2 * 3 * len(HARD)
    assert mix_sources(nothing).collect() == []


def test_texts_under_one_key_are_drawn_apart(spark):
    docs = spark.range(600).selectExpr("1L as doc_id", "lpad(id, 6, 'x') as text", "'s' as source")
    out = mix_sources(docs, {"s": 1.0}, epochs=0.5, seed=2).collect()
    assert 0.4 * 600 < len(out) < 0.6 * 600 and len({r.shuffle_key for r in out}) == len(out)
    same = mix_sources(docs.selectExpr("doc_id", "'t' as text", "source"), {"s": 1.0}, epochs=3.0, seed=2)
    assert same.groupBy("copy").count().where("count <> 600").isEmpty()


TURN = "conv_id bigint, turn bigint, role string, text string"


def _said(*turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def test_snapshots_collapse(spark):
    log = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("bot", "so")]
    rows = []
    for conv, n in ((5, 2), (6, 4), (7, 3), (8, 4), (9, 1)):
        rows += [(conv, t, *log[t]) for t in range(n)]
    rows += [(10, 0, "user", "hi"), (10, 1, "assistant", "other"), (11, 3, None, None), (None, 0, "user", "lost")]
    rows += [(10, 1, "assistant", "other")]  # a repeated row
    out = {r.conv_id: r for r in chat_format(spark.createDataFrame(rows, TURN)).collect()}
    assert sorted(out) == [6, 10, 11]
    assert out[6].copies == 2 and out[6].n_turns == 4
    assert out[6].rendered == _said(("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "so"))
    assert out[10].part_turns == 2 and out[11].rendered == _said(("unknown", ""))


def test_long_conversations_are_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chats, "BLOCK", 4)
    rows = [(1, t, "user", f"t{t}") for t in range(11)] + [(2, t, "user", f"t{t}") for t in range(9)]
    rows += [(3, t, "user", f"t{t}" if t != 7 else "else") for t in range(9)]
    out = sorted(chat_format(spark.createDataFrame(rows, TURN)).collect(), key=lambda r: (r.conv_id, r.part))
    assert [(r.conv_id, r.part, r.part_turns) for r in out] == [(1, 0, 4), (1, 1, 4), (1, 2, 3), (3, 0, 4), (3, 1, 4), (3, 2, 1)]
    assert "".join(r.rendered for r in out[:3]) == _said(*[("user", f"t{t}") for t in range(11)])


def test_odd_turns(spark):
    rows = [(1, None, "user", "x"), (1, 0, "user", ""), (2, 5, "user", "b"), (2, 5, "user", "a"), (3, -3, "SYSTEM", "s")]
    turns = spark.createDataFrame(rows, TURN).withColumns({c: F.lit(1) for c in ("rank", "block", "h1", "part", "copies")})
    out = {r.conv_id: r for r in chat_format(turns).collect()}
    assert out[1].n_turns == 2 and out[2].part_turns == 2 and out[3].rendered == _said(("system", "s"))
    assert chat_format(turns.where("1 = 0")).collect() == []

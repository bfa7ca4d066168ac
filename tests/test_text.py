import random

import pytest
from pyspark.sql import functions as F

from answerscope.functions import bands, text
from answerscope.functions.keys import is_complete, pair_key
from answerscope.functions.statistics import half_even, to_number

OVERLAPS = [
    ("cat sat", "the cat sat on the mat", 1.0),
    ("dog", "the dog ran fast", 1.0),
    (None, "hello world test", 0.0),
    ("brown dog", "the quick brown fox", 0.5),
    ("dog bird", "the cat sat", 0.0),
    ("Paris", "Paris é a capital da França, ...", 1.0),
    ("animal dormindo", "O gato dorme na cama.", 0.0),
    ("JavaScript é melhor", "Python é uma linguagem.", 1 / 3),
    ("cama", "na cama.", 0.0),
    ("a a b", "a", 0.5),
    ("  ", "x", 0.0),
    ("", "x", 0.0),
    ("x", None, 0.0),
    ("x", "", 0.0),
    ("a b", "a b", 1.0),
    ("a\x1cb", "a b　c", 1.0),
    ("CAT", "cat", 1.0),
]


def python_overlap(answer, context):
    if answer is None or context is None:
        return 0.0
    own, other = set(answer.lower().split()), set(context.lower().split())
    return len(own & other) / len(own) if own else 0.0


def test_word_overlap(spark):
    rows = spark.createDataFrame([(i, a, c) for i, (a, c, _) in enumerate(OVERLAPS)], "i int, a string, c string")
    got = {r.i: r.o for r in rows.select("i", text.word_overlap(F.col("a"), F.col("c")).alias("o")).collect()}
    for i, (a, c, expected) in enumerate(OVERLAPS):
        assert got[i] == pytest.approx(expected), (a, c)
        assert got[i] == python_overlap(a, c)


def test_word_overlap_agrees_with_python_on_random_text(spark):
    rng = random.Random(7)
    alphabet = ["a", "B", "é", "ß", ".", ",", " ", "  ", "\t", "\n", " ", " ", "\x1c", "\x85", "　", " "]
    rows = []
    for i in range(500):
        a, c = ("".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(2))
        rows.append((i, a, c))
    df = spark.createDataFrame(rows, "i int, a string, c string")
    got = df.select("i", text.word_overlap(F.col("a"), F.col("c")).alias("o"), text.word_count(F.col("a")).alias("w"))
    for r in got.collect():
        _, a, c = rows[r.i]
        assert r.o == python_overlap(a, c), (a, c)
        assert r.w == len(a.split())


def test_clean_text(spark):
    import re

    cases = [None, "", "  Na   cama;\n", "café (com) leite!", "a_b-c? d.e, f", "x y\x1cz", "€5 ½"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", text.clean_text(F.col("t")).alias("c")).collect()}
    for i, case in enumerate(cases):
        expected = "" if case is None else re.sub(r"\s+", " ", re.sub(r"[^\w\s\.\,\-\?]", "", case)).strip().lower()
        assert got[i] == expected
    one = spark.createDataFrame([("cama!", "na cama;"), ("cama", "cama.")], "a string, c string")
    assert [r[0] for r in one.select(text.clean_overlap(F.col("a"), F.col("c"))).collect()] == [1.0, 0.0]


def test_lengths_and_previews(spark):
    df = spark.createDataFrame([("a b c",), (None,), ("x" * 201,), ("y" * 200,)], "q string")
    q = F.col("q")
    rows = df.select(text.char_count(q), text.word_count(q), text.nonspace_count(q), text.preview(q, 200)).collect()
    assert tuple(rows[0])[:3] == (5, 3, 3)
    assert tuple(rows[1]) == (0, 0, 0, None)
    assert rows[2][3] == "x" * 200 + "..."
    assert rows[3][3] == "y" * 200
    assert df.select(text.truncate(q, 3)).collect()[2][0] == "xxx"


def test_answers_differ(spark):
    df = spark.createDataFrame([(" Yes", "yes "), ("a", "b"), (None, None), (None, ""), (" a", "A")], "a string, b string")
    got = [r[0] for r in df.select(text.answers_differ(F.col("a"), F.col("b"))).collect()]
    assert got == [False, True, False, True, False]


def test_ladders(spark):
    df = spark.createDataFrame([(0.8,), (0.6,), (0.5,), (0.4999,), (0.4,), (0.39,), (0.2,), (0.1,), (0.0,), (None,)], "x double")
    x = F.col("x")
    rows = df.select(bands.risk_band(x), bands.overlap_tier(x), bands.performance_tier(x)).collect()
    assert [r[0] for r in rows] == ["low_risk", "medium_risk", "medium_risk"] + ["high_risk"] * 7
    assert [r[1] for r in rows] == ["very_high", "high", "moderate", "moderate", "moderate", "low", "low",
                                    "very_low", "none", "none"]
    assert [r[2] for r in rows[:6]] == ["excellent", "good", "average", "average", "average", "poor"]
    verdicts = df.select(bands.overlap_verdict(x * 100)).collect()
    assert [r[0] for r in verdicts[:9]] == ["excellent", "good", "moderate", "moderate", "moderate", "worrying",
                                            "worrying", "critical", "critical"]


def test_correlation_labels(spark):
    df = spark.createDataFrame([(0.51,), (0.5,), (-0.31,), (0.3,), (0.0,)], "r double")
    rows = df.select(bands.correlation_strength(F.col("r")), bands.correlation_direction(F.col("r"))).collect()
    assert [tuple(r) for r in rows] == [("strong", "positive"), ("moderate", "positive"), ("moderate", "negative"),
                                        ("weak", "positive"), ("weak", "negative")]


def test_numbers(spark):
    df = spark.createDataFrame([("0.5",), (" 1 ",), ("bad",), ("NaN",), (None,)], "s string")
    assert [r[0] for r in df.select(to_number(F.col("s"))).collect()] == [0.5, 1.0, None, None, None]
    assert spark.range(1).select(half_even(F.lit(0.12345), 4)).first()[0] == 0.1234


def test_pair_key(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "x"), ("x", None), (None, None), ("", "")], "q string, c string")
    rows = df.select(pair_key(F.col("q"), F.col("c")).alias("k")).select("k", is_complete(F.col("k")).alias("ok")).collect()
    assert len({bytes(r.k) for r in rows}) == 6
    assert [r.ok for r in rows] == [True, True, False, False, False, True]

from brute import WHITE, TO_LOWER
from conftest import HARD

from answerscope.llm.line_dedup import LineRuns, line_dedup, line_rows, new_lines
from answerscope.llm.quality_rules import judge, line_failure, quality_rules, repeat_words


def test_line_rules():
    assert line_failure("A plain sentence, with words.") is None
    assert line_failure("") is None
    assert line_failure("WOW!! BUY!! NOW!!") == "punctuation"
    assert line_failure("one two " * 12) == "punctuation"
    assert line_failure("Home page » About the company » Contact and imprint of us all") == "navigation"
    assert line_failure("Please read our Privacy Policy before use.") == "boilerplate"


def test_repeated_windows():
    assert repeat_words("a b c d".split()) == 0
    assert repeat_words("a b c x a b c".split()) == 6
    assert repeat_words("a a a a".split()) == 4
    assert repeat_words([]) == 0


def test_documents_lose_lines_or_go():
    good = [" ".join(f"{c}{k}" for c in "abcdefgh") + ", and it ends." for k in range(8)]
    row = judge("\n".join([*good[:4], "WOW!! BUY!! NOW!!", *good[4:]]), 30)
    assert row[9] is True and row[10] == "\n".join(good) and row[6] == 1
    assert judge("WOW!! BUY!! " * 40, 30)[9] is False
    assert judge(None, 30)[:5] == (0, 0, 0, 0, 0) and judge(None, 30)[9:] == (False, "")


def test_rules_hard_rows(hard, nothing):
    out = quality_rules(hard)
    assert out.columns.count("kept") == 1 and dict(out.dtypes)["kept"] == "boolean" and "rep" in out.columns
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_dup_lines, r.kept, r.clean_text) for r in out.collect())
    assert got == sorted((str(k), j[0], j[1], j[3], j[9], j[10]) for (k, t) in HARD for j in [judge(t, 30)])
    assert quality_rules(nothing).collect() == []


def _without_common(rows, least):
    keys = [[x.strip(WHITE).translate(TO_LOWER) for x in (t or "").split("\n")] for _, t in rows]
    found = {}
    for own in keys:
        for k in set(own):
            found[k] = found.get(k, 0) + 1
    out = []
    for (key, t), own in zip(rows, keys):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, own) if not k or found[k] < least]
        out.append((str(key), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines_against_brute_force(spark, hard, nothing):
    rows = [(i, "\n".join([f" Shared {i % 4}\t", "ALL of them", f"own {i}", "", "all of THEM \r", "dup", "dup"][: 2 + i % 6])) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for least in (1, 3, 6, 30):
        got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(docs, least=least).collect())
        assert got == _without_common(rows, least)
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(hard, least=3).collect())
    assert got == _without_common(HARD, 3)
    assert line_dedup(nothing).collect() == []


def test_runs_are_levelled_and_reopened(spark):
    runs = LineRuns(spark, fanout=2)
    docs = [spark.createDataFrame([(i, f"common\nline {i}\nline {i % 2}")], "doc_id bigint, text string") for i in range(5)]
    fresh = [sorted(r.line_no for r in new_lines(d, runs).collect()) for d in docs]
    assert fresh == [[0, 1, 2], [1, 2], [1], [1], [1]]
    assert sorted(runs.levels) == [0, 1, 2] and [len(runs.levels[k]) for k in (0, 1, 2)] == [1, 0, 1]
    again = LineRuns.open(spark, runs.path, fanout=2)
    assert {k: v for k, v in again.levels.items() if v} == {k: v for k, v in runs.levels.items() if v}
    assert max(r.n for r in again.totals().collect()) == 5
    assert again.unseen(line_rows(docs[0], "text", "doc_id")).count() == 0
    assert LineRuns(spark).entries().count() == 0

import pytest
from brute import random_texts, repeated_bytes, repeated_words
from conftest import HARD

from answerscope.llm.substring_dedup import substring_dedup
from answerscope.llm.suffix_dedup import suffix_dedup


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.mark.parametrize("width, seed", [(1, 0), (4, 1), (9, 2)])
def test_words_against_brute_force(spark, width, seed):
    texts = random_texts(60, ["a", "b", "é", "C"] if width > 1 else [f"w{i}" for i in range(900)], 40, seed)
    rows = {r.doc_id: r for r in substring_dedup(_docs(spark, texts), width=width).collect()}
    want = repeated_words(texts, width)
    assert [(rows[i].n_words, rows[i].n_removed, rows[i].kept_text) for i in range(len(texts))] == want
    assert all(sum(b - a for a, b in zip(r.removed_spans[::2], r.removed_spans[1::2])) == r.n_removed for r in rows.values())


def test_words_hard_rows(hard, nothing):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(hard, width=5).collect())
    want = repeated_words([t for _, t in HARD], 5)
    assert got == sorted((str(k), *w) for (k, _), w in zip(HARD, want))
    assert substring_dedup(nothing, width=5).collect() == []
    with pytest.raises(ValueError):
        substring_dedup(hard, width=0)


@pytest.mark.parametrize("width, seed, crowd", [(16, 3, 20_000), (17, 4, 1), (40, 5, 0), (100, 6, 3)])
def test_bytes_against_brute_force(spark, width, seed, crowd):
    texts = random_texts(50, ["ab", "ba", "é", "a"], 120, seed)
    rows = {r.doc_id: r for r in suffix_dedup(_docs(spark, texts), width=width, crowd=crowd).collect()}
    want = repeated_bytes(list(enumerate(texts)), width)
    assert [(rows[i].n_bytes, rows[i].n_removed, bytes(rows[i].kept)) for i in range(len(texts))] == want
    assert all(sum(b - a for a, b in zip(r.removed_spans[::2], r.removed_spans[1::2])) == r.n_removed for r in rows.values())


def test_bytes_of_one_character(spark):
    """All windows equal: every text after the first loses all, the first keeps one window."""
    texts = ["a" * 100, "a" * 250, "a" * 99, "b" * 300]
    rows = {r.doc_id: r for r in suffix_dedup(_docs(spark, texts), width=100).collect()}
    want = repeated_bytes(list(enumerate(texts)), 100)
    assert [(rows[i].n_bytes, rows[i].n_removed, bytes(rows[i].kept)) for i in range(4)] == want


def test_bytes_hard_rows(hard, nothing):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup(hard, width=20).collect())
    want = repeated_bytes(HARD, 20)
    assert got == sorted((str(k), *w) for (k, _), w in zip(HARD, want))
    assert suffix_dedup(nothing, width=20).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup(hard, width=8)

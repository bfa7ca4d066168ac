import math

import numpy as np
from brute import benchmark_hits, random_texts
from conftest import HARD

from answerscope.llm.decontamination import build_index, clean_documents, decontaminate, search
from answerscope.llm.license_scan import license_scan


def test_matches_against_brute_force(spark):
    texts = random_texts(40, ["red", "Blue", "grün", "x1"], 30, 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = [(10, texts[0] + " red"), (9, "Blue, red"), (8, None), (7, "..."), (6, texts[3]), (6, "x1 x1 x1 x1 red")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for width in (1, 3, 10):
        rows = {r.doc_id: r for r in decontaminate(docs, table, width=width).collect()}
        for i, t in enumerate(texts):
            assert (rows[i].hits, rows[i].items) == benchmark_hits(t, items, width)
            assert set(rows[i].items) <= set(rows[i].near_items)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "zero alpha beta gamma odd delta epsilon"), (2, "alpha beta delta gamma epsilon"),
                                  (3, "alpha one two three four five beta gamma delta epsilon")], "doc_id bigint, text string")
    items = spark.createDataFrame([("p", "alpha beta gamma delta epsilon")], "item_id string, text string")
    rows = {r.doc_id: r for r in decontaminate(docs, items, width=5, slop=1).collect()}
    assert all(r.hits == [] and r.items == [] for r in rows.values())
    assert [rows[i].near_items for i in (1, 2, 3)] == [["p"], ["p"], ["p"]]


def test_proximity_against_brute_force(spark):
    """Several texts in one shard, with the words of each window elsewhere too."""
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(60)]
    items = [(str(i), " ".join(rng.choice(names, n))) for i, n in enumerate((10, 10, 5, 14, 3))]
    texts = []
    for i in range(60):
        own = items[i % 5][1].split()
        for _ in range(rng.integers(0, 4)):  # words go, come or change
            at = rng.integers(0, len(own))
            own[at:at + rng.integers(0, 2)] = list(rng.choice(names, rng.integers(0, 2)))
            own = own or ["w0"]
        texts.append(" ".join([*rng.choice(names, rng.integers(0, 6)), *own, *rng.choice(names, rng.integers(0, 6))]))
    texts.append("w1")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    table = spark.createDataFrame(items, "item_id string, text string")
    for width, slop in ((10, 0), (10, 2), (5, 1)):
        got = {r.doc_id: r.near_items for r in decontaminate(docs, table, width=width, slop=slop).collect()}
        want = {i: near_items(t.split(), items, width, slop) for i, t in enumerate(texts)}
        assert got == want and any(want.values())


def near_items(words, items, width, slop):
    out = set()
    for name, text in items:
        own = text.split()
        for begin in range(max(1, len(own) - width + 1)):
            window = own[begin:begin + width]
            for start in range(-len(window) - slop, len(words) + slop):
                there = sum(w in words[max(0, start + j - slop):max(0, start + j + slop + 1)] for j, w in enumerate(window))
                if there >= math.ceil(0.8 * len(window)):
                    out.add(name)
    return sorted(out)


def test_index_is_asked_again(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "c d")], "doc_id bigint, text string")
    index = build_index(docs)
    for said, found in (("b c", [1]), ("d", [2]), ("q", [])):
        items = spark.createDataFrame([(0, said)], "item_id bigint, text string")
        assert [r.key for r in search(index, items, width=2).where("size(hits) > 0").collect()] == found


def test_matches_hard_rows(spark, hard, nothing):
    items = [(1, "two three four five"), (2, "word5x5 word6x6 word7x7"), (3, None)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_words, r.hits, r.items) for r in decontaminate(hard, table, width=3).collect())
    from brute import alphanumeric
    assert got == sorted((str(k), len(alphanumeric(t)), *benchmark_hits(t, items, 3)) for k, t in HARD)
    assert decontaminate(nothing, table).collect() == []
    assert decontaminate(hard, table.where("1 = 0")).where("size(hits) > 0").count() == 0
    kept = clean_documents(hard, table, width=3)
    assert kept.columns == hard.columns and kept.count() == sum(not benchmark_hits(t, items, 3)[0] for _, t in HARD)


def test_license_phrases_and_notices(spark, hard, nothing):
    mit = ("Permission is hereby granted, free of charge, to any person getting a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without any restriction, including without "
           "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies")
    rows = [(1, "MIT license mit-LICENSE"), (2, "intro " + mit), (3, "general public, license general public x license"),
            (4, "The Apache License and the GNU General Public License."), (5, "of the to the in the software")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan(docs).collect()}
    values = lambda i: (got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels)
    assert values(1) == (2, 0, 2, "mit", "mit") and got[1].score == 1.0
    assert values(2) == (0, None, None, "", "mit") and 0.6 <= got[2].score < 1
    assert values(3) == (1, 0, 0, "gpl", "gpl")
    assert values(4) == (2, 1, 6, "apache,gpl", "apache,gpl")
    assert values(5) == (0, None, None, "", "") and got[5].score == 0
    out = license_scan(hard)
    assert out.count() == len(HARD) and license_scan(nothing).collect() == []
    nine = out.where("doc_id = 9").first()
    assert (nine.n_words, nine.n_base, nine.base_labels) == (8, 3, "gpl,mit")

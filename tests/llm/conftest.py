import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
#: Null and empty texts, null and repeated keys, ties and repeated rows, a very long text, odd white space.
HARD = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, ""), (4, " \n\t "),
    (None, "one two three four five six seven eight nine ten eleven twelve"), (None, None),
    (5, "one two three four five six seven eight nine ten eleven twelve"),
    (5, "one two three four five six seven eight nine ten eleven twelve"),
    (5, "another text under the same key, with é and 漢字 in it\nand a line"), (6, LONG), (7, LONG + " tail"),
    (8, "x"), (9, "MIT License\r\nmit\tlicense\x0bGNU General Public License"), (10, "\n\na\n\nA \n"),
]


@pytest.fixture(scope="session")
def hard(spark):
    """The rows of HARD, with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(HARD, "doc_id bigint, text string")
    taken = ("n_words", "n_removed", "kept", "kept_text", "chunk", "owner", "key", "r1", "r2", "rep", "n", "copy", "score",
             "labels", "n_lines", "component_id", "shard", "first", "spans", "_key", "entropies", "rate", "bucket", "_r1", "_r2", "_row", "_draw", "_n",
             "_source", "_parts", "_sums", "_places", "_lines", "_words", "_text")
    return rows.withColumns({c: F.lit(f"mine:{c}") for c in taken}).withColumn("source", F.lit("s")).withColumn("lang", F.lit("en"))


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.where("1 = 0")

"""Line-first cleaning: rules judge lines, failed lines go, documents that lose too much go too."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..session import ship_package

WHITE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
# Signs that prose has few of; the exclamation mark counts as one here.
NOISE = "#*$%&|<>{}[]~^_=+\\@!"
SEPARATORS = "|»›•·>"
SENTENCE_SIGNS = ".,;:!?…"
# Phrases of page furniture, matched in lower-cased lines.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "log in to",
    "privacy policy", "read more", "sign up for", "skip to content", "subscribe to our", "terms of service",
    "terms of use",
)
_BOILERPLATE = tuple(p.encode() for p in BOILERPLATE)
ADDED = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
         "n_lines bigint, n_failed_lines bigint, failed_chars bigint, base_failed boolean, kept boolean, clean_text string")


def line_failure(line: str, long_line: int = 20) -> str | None:
    """The first rule that a line breaks, or None.

    ``punctuation``: over a tenth of its characters are noise signs, or it has
    ``long_line`` words or more and no sentence sign. ``navigation``: two or
    more separators. ``boilerplate``: a phrase of page furniture. Lines without
    a word break no rule.
    """
    words = line.encode().split()
    if not words:
        return None
    chars = len(line) - sum(map(line.count, WHITE))
    if 10 * sum(map(line.count, NOISE)) > chars:
        return "punctuation"
    if len(words) >= long_line and not any(s in line for s in SENTENCE_SIGNS):
        return "punctuation"
    if sum(map(line.count, SEPARATORS)) >= 2:
        return "navigation"
    low = line.encode().lower()
    return "boilerplate" if any(p in low for p in _BOILERPLATE) else None


def repeat_words(words: list) -> int:
    """Words in three-word windows that are found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def judge(text: str | None, max_loss: int, min_words: int = 50, max_repeat: int = 50) -> tuple:
    """The values of ``ADDED`` for one text."""
    text = text or ""
    words = text.encode().split()
    lines = text.split("\n")
    seen, repeated, clean, failed, lost = set(), 0, [], 0, 0
    for line in lines:
        if line.strip(WHITE):
            repeated += line in seen
            seen.add(line)
            if line_failure(line):
                failed += 1
                lost += len(line) - sum(map(line.count, WHITE))
                continue
        clean.append(line)
    chars = len(text) - sum(map(text.count, WHITE))
    again = repeat_words(words)
    bad = len(words) < min_words or 100 * again > max_repeat * len(words)
    return (len(words), chars, sum(map(text.count, SYMBOLS)), repeated, again, len(lines), failed, lost,
            bad, not bad and 100 * lost <= max_loss * chars, "\n".join(clean))


def quality_rules(docs: DataFrame, text: str = "text", max_loss: int = 30) -> DataFrame:
    """Judge lines first, then documents; every input row comes back with its verdict.

    Adds the columns of ``ADDED``: ``clean_text`` is the text without its
    failed lines, ``kept`` is false for texts of under 50 words, for texts over
    half of whose words stand in repeated three-word windows, and for texts
    whose failed lines hold over ``max_loss`` percent of their characters
    (white space aside). Null and empty texts have no words, are not kept and
    have an empty ``clean_text``. Repeated rows are judged alike, one by one.
    A column of the input that has a name of ``ADDED`` is replaced. No shuffle:
    rows are judged where they are read.
    """
    ship_package(docs.sparkSession)
    added = StructType.fromDDL(ADDED)
    own = [c for c in docs.columns if c not in added.names]
    schema = StructType([docs.schema[c] for c in own] + list(added))
    kinds = (pa.int64(),) * 8 + (pa.bool_(),) * 2 + (pa.string(),)

    def judged(batches):
        for batch in batches:
            rows = [judge(t, max_loss) for t in batch.column(text).to_pylist()]
            new = [pa.array(v, k) for v, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *new], names=[*own, *added.names])

    return docs.select(*own).mapInArrow(judged, schema)

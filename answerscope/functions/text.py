"""Word overlap, text cleaning, lengths and previews."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode blanks as Python's str.split() and re's \s have them.
# (?U) makes Java's \s Unicode-aware but leaves out the four separators 1c-1f.
BLANK_RUN = r"(?U)[\s\x1c-\x1f]+"

EDGE_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# Letters, numbers, underscore, blanks and . , - ? survive cleaning.
UNWANTED = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f.,\-?]"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row; the planner may otherwise compute it
    wherever it is used, inside a lambda for every element."""
    return F.transform(F.array(value), use)[0]


def split_lower(text: Column) -> Column:
    """Lower-cased pieces of ``text`` between blanks; may hold ``''`` at the ends."""
    return F.split(F.lower(text), BLANK_RUN)


def words(text: Column) -> Column:
    return F.array_remove(split_lower(text), "")


def distinct_words(text: Column) -> Column:
    return F.array_distinct(words(text))


def word_overlap(answer: Column, context: Column) -> Column:
    """Share of the distinct answer words that occur in the context.

    Null or blank answers and null contexts give 0. Only the answer side is
    made distinct: ``array_intersect`` removes repeats itself, and blanks
    cannot match because the answer side has none.
    """
    return overlap_with(answer, split_lower(context))


def overlap_with(answer: Column, context_words: Column) -> Column:
    """As ``word_overlap`` with the context already split, so that several
    answers to one context share the split."""
    return share_found(distinct_words(answer), context_words)


def share_found(own: Column, context_words: Column) -> Column:
    """Share of ``own``, distinct words, found in the context's. The set that Spark builds is that of its second argument, the few."""
    share = F.try_divide(F.array_size(F.array_intersect(context_words, own)), F.array_size(own))
    return F.coalesce(share, F.lit(0.0))


def words_in_answers(context_words: Column, answers: Column) -> Column:
    """The context's words that occur in one of the answers, given as an array of arrays of words.

    An answer's words are found among these if they are in the context, so a context is gone through once for all answers.
    """
    return F.array_intersect(context_words, F.flatten(F.array_compact(answers)))


def clean_text(text: Column) -> Column:
    """Drop special characters, collapse blanks, trim, lower; null becomes ``''``."""
    kept = F.regexp_replace(text, UNWANTED, "")
    return F.coalesce(F.lower(F.trim(F.regexp_replace(kept, BLANK_RUN, " "))), F.lit(""))


def clean_overlap(answer: Column, context: Column) -> Column:
    """Word overlap after both sides were cleaned; words are the same whether blanks are collapsed before or not."""
    return word_overlap(F.regexp_replace(answer, UNWANTED, ""), F.regexp_replace(context, UNWANTED, ""))


def char_count(text: Column) -> Column:
    return F.coalesce(F.char_length(text), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.array_size(words(text)), F.lit(0))


def nonspace_count(text: Column) -> Column:
    """Characters other than U+0020."""
    return char_count(F.replace(text, F.lit(" "), F.lit("")))


def preview(text: Column, limit: int = 200) -> Column:
    """The text itself, or its first ``limit`` characters and ``...``."""
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def truncate(text: Column, limit: int = 512) -> Column:
    """The part of a context that is shown to a predictor."""
    return F.substring(text, 1, limit)


def answers_differ(left: Column, right: Column) -> Column:
    """Compare trimmed, lower-cased answers; two nulls are the same answer."""
    return ~plain_answer(left).eqNullSafe(plain_answer(right))


def plain_answer(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, EDGE_BLANKS, ""))

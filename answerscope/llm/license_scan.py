"""Licence notices found by diagonal voting of word pairs against templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .native import ascii_lower, row_key, stored

K = 2  # words per gram: the shortest phrase has two
# Phrases that are a label wherever they stand, and the openings of public licence notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
              "compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
           "General Public License as published by the Free Software Foundation, either version 3 of the License, "
           "or (at your option) any later version",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the Software), to deal in the Software without restriction, including "
           "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
           "copies of the Software",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
OUTSIDE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased words
DRIFT = 3  # diagonals this near belong to one span
COVER = 0.6  # share of a notice's words that makes a label


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), OUTSIDE), "")


def grams_of(words: Column) -> Column:
    """All pairs of neighbouring words, each as one string; none for a single word."""
    n = F.greatest(F.size(words) - (K - 1), F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(K), n), lambda a, b: F.concat(a, F.lit(" "), b))


def template_grams(spark: SparkSession, phrases=None, notices=None) -> DataFrame:
    """``template, label, phrase, size, place, t_gram, t_hash``: a few hundred constant rows."""
    entries = [(t, label, True) for t, label in (PHRASES if phrases is None else phrases).items()]
    entries += [(t, label, False) for label, t in (NOTICES if notices is None else notices).items()]
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("phrase"),
                              words_of(F.lit(t)).alias("w")) for i, (t, label, base) in enumerate(entries)])
    table = spark.range(1).select(F.inline(rows)).withColumn("size", F.size("w"))
    table = table.select("template", "label", "phrase", "size", F.posexplode(grams_of(F.col("w"))).alias("place", "t_gram"))
    return table.withColumn("t_hash", F.xxhash64("t_gram"))


def diagonals(docs: DataFrame, text: str, key: str, templates: DataFrame) -> DataFrame:
    """Votes: one row for each text, template and offset of pairs found on it.

    Every pair of every text is joined with the templates' pairs by hash, and
    the words are compared. The templates are constants, so they are broadcast.
    """
    # The words are a column of their own, so that a text is split once.
    words = docs.select(*row_key(key, text), words_of(F.col(text)).alias("_words"))
    grams = words.select("r1", "r2", F.posexplode(grams_of(F.col("_words"))).alias("pos", "gram"))
    found = grams.join(F.broadcast(templates), (F.xxhash64("gram") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")))
    # Repeated rows share their hashes, and vote once.
    return (found.withColumn("diagonal", F.col("pos") - F.col("place"))
            .groupBy("r1", "r2", "template", "label", "phrase", "size", "diagonal")
            .agg(F.collect_set("place").alias("places")))


def spans(votes: DataFrame) -> DataFrame:
    """Verified spans: ``r1, r2, label, phrase, start, share``.

    A phrase needs all its pairs on one diagonal. For notices, diagonals up to
    ``DRIFT`` apart are merged, and the distinct words covered must be
    ``COVER`` of the notice.
    """
    whole = votes.where(F.col("phrase") & (F.size("places") == F.col("size") - (K - 1))).select(
        "r1", "r2", "label", "phrase", F.col("diagonal").cast("bigint").alias("start"), F.lit(1.0).alias("share"))
    order = Window.partitionBy("r1", "r2", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    merged = (votes.where(~F.col("phrase")).withColumn("new", (gap.isNull() | (gap > DRIFT)).cast("int"))
              .withColumn("span", F.sum("new").over(order))
              .groupBy("r1", "r2", "template", "label", "phrase", "size", "span")
              .agg(F.min("diagonal").cast("bigint").alias("start"), F.flatten(F.collect_list("places")).alias("places")))
    words = F.array_distinct(F.concat("places", *[F.transform("places", _later(k)) for k in range(1, K)]))
    verified = merged.withColumn("share", F.size(words) / F.col("size")).where(F.col("share") >= COVER)
    return whole.unionByName(verified.select(*whole.columns))


def _later(words: int):
    return lambda place: place + words


def license_scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: DataFrame | None = None) -> DataFrame:
    """Licence labels of every row.

    Returns the key, ``n_words``, ``n_base`` (places of the phrases),
    ``first_word`` and ``last_word`` (their smallest and largest start, null
    without one), ``base_labels``, ``labels`` (with those of the notices; both
    distinct, sorted, joined by commas) and ``score``: the largest share of a
    template's words in a verified span, 1 for a phrase, 0 without a span.
    Null and empty texts have no words. Repeated rows get equal results, rows
    without a key are scanned like others, other columns are not read. Runs one
    job that writes the votes, a row per matched text, template and offset.
    """
    # Written, since both kinds of spans are made from the votes.
    votes = stored(diagonals(docs, text, key, template_grams(docs.sparkSession) if templates is None else templates), "votes")
    found = spans(votes)
    base = F.when(F.col("phrase"), F.col("start"))
    by_row = found.groupBy("r1", "r2").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"))
    rows = docs.select(key, *row_key(key, text), F.size(words_of(F.col(text))).cast("bigint").alias("n_words"))
    return rows.join(by_row, ["r1", "r2"], "left").select(
        key, "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))

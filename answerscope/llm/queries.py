"""Registered queries of the corpus operators: each takes (spark, sf_dir) and reads the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat_format as chats, decontamination, hard_negatives, language_id, license_scan as licenses, line_dedup, mixing, near_dedup, near_vectors, quality_rules as rules, substring_dedup as substrings, suffix_dedup as suffixes, whitening


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    done = substrings.substring_dedup(_read(spark, sf_dir, "documents"), width=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_quality_rules(spark, sf_dir):
    judged = rules.quality_rules(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "n_failed_lines", "failed_chars")


def op3_decontaminate(spark, sf_dir):
    done = decontamination.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), width=10)
    size = lambda c: F.size(c).cast("bigint")
    return done.select("doc_id", "n_words", size("hits").alias("n_hit"), size("items").alias("n_items"),
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                       (F.size("hits") > 0).alias("contaminated"))


def op4_suffix_dedup(spark, sf_dir):
    done = suffixes.suffix_dedup(_read(spark, sf_dir, "documents"), width=100)
    return done.select("doc_id", "n_bytes", "n_removed", (F.size("removed_spans") / 2).cast("bigint").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op5_license_scan(spark, sf_dir):
    return licenses.license_scan(_read(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return language_id.identify(docs, language_id.fit(docs)).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op7_line_dedup(spark, sf_dir):
    done = line_dedup.line_dedup(_read(spark, sf_dir, "documents"), least=10)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, percent=85).drop("text")


def op9_mix_sources(spark, sf_dir):
    return mixing.mix_sources(_read(spark, sf_dir, "documents"), weights=0.5, seed=9).select(
        "doc_id", "source", "lang", "text", "copy", "shuffle_key")


def op10_chat_format(spark, sf_dir):
    return chats.chat_format(_read(spark, sf_dir, "conversations"))


def op11_whitening(spark, sf_dir):
    done = whitening.whiten(_read(spark, sf_dir, "embeddings"), components=16, weights="one", scale=64, offset=1_000_000)
    # The exact deviation is a decimal; where it needs more than 64 bits a long cannot hold it.
    rows = done.select("vec_id", "n", F.col("deviation").try_cast("bigint").alias("deviation"), "explained", "identity_error",
                       F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
                       F.col("explained")[F.col("at")].alias("explained"), "identity_error")


def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _read(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.hard_negatives(rows, anchors=F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, scale=256)


def op13_near_vectors(spark, sf_dir):
    return near_vectors.near_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.98)


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_quality_rules, op3_decontaminate, op4_suffix_dedup, op5_license_scan, op6_language_id,
    op7_line_dedup, op8_near_dedup, op9_mix_sources, op10_chat_format, op11_whitening, op12_hard_negatives, op13_near_vectors)}

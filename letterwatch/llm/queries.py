"""The queries of this subpackage and their checking SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline

from ..functions.frames import materialize
from . import ann, fingerprint, langid, lexical, merkle, mixing, quality, quality_rules, sentencepiece, simhash, token_count, toxicity, url_filter
from .common import fold, labelled_sample, table
from .oracle import ORACLE  # noqa: F401


def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 5, 0, quality.FIT_ROWS)
    scored = quality.quality(docs, quality.fit(sample), threshold=0.3)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.training_rows(docs, folds=4, held_out=2))
    judged = langid.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op3_token_counts(spark, sf_dir):
    rows = token_count.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_sentencepiece(spark, sf_dir):
    coded = sentencepiece.decode(sentencepiece.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"),
                        F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


def op5_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stats = materialize(quality_rules.text_stats(docs).drop("text"))
    return quality_rules.judge(stats).select("doc_id", *quality_rules.STATS, "base_failed", "kept")


def op6_fingerprints(spark, sf_dir):
    return fingerprint.order_minhash(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mixing(spark, sf_dir):
    sizes = mixing.sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    return mixing.mix_sized(materialize(sizes)).select("doc_id", "size", "source_size", "target", "taken")


def op8_url_filter(spark, sf_dir):
    return url_filter.url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", 5, 0, toxicity.FIT_ROWS)
    scored = toxicity.toxicity(docs, toxicity.fit(sample), threshold=0.5)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op11_nearest(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0, 20)


def op12_lexical(spark, sf_dir):
    return lexical.lexical_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 20)


def op13_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.tampered(docs))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_rules": op5_quality_rules,
    "op6_fingerprints": op6_fingerprints,
    "op7_mixing": op7_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_nearest": op11_nearest,
    "op12_lexical": op12_lexical,
    "op13_merkle": op13_merkle,
    "pipeline": corpus_pipeline.run,
}

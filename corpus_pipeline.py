"""From raw documents to token identifiers: five stages, each written as Parquet and read again by the next."""
from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from letterwatch.functions.frames import materialize  # noqa: E402
from letterwatch.llm import langid, mixing, sentencepiece, simhash, toxicity  # noqa: E402
from letterwatch.llm.common import labelled_sample, table  # noqa: E402


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored toxic go.  Learned from the labels outside fold 0."""
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", 5, 0, toxicity.FIT_ROWS)
    row = docs.select("text", F.struct("*").alias("row"))
    return toxicity.toxicity(row, toxicity.fit(sample)).where("predicted = 0").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every known language, go.  Learned from known languages outside fold 2."""
    model = langid.fit(langid.training_rows(docs))
    row = docs.select("text", F.struct("*").alias("row"))
    return langid.identify(row, model).where("NOT rejected").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id."""
    return simhash.one_of_each(docs, shingle=3, distance=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers of each document, and whether decoding gives back its text (compared by SHA-256).

    The identifiers are written before they are decoded, so that a task never keeps an encoding and a decoding worker at once.
    """
    rows = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    coded = sentencepiece.decode(materialize(sentencepiece.encode(rows).drop("text")))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_ids"),
                        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [("toxicity", toxic), ("language_id", language), ("simhash_near_dedup", near_dedup), ("mixing", mix), ("sentencepiece", tokens)]

# Learned models, fingerprints and segmentations have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

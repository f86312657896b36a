"""Helpers that several operators of this subpackage share."""
from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.frames import materialize

# A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"
BATCH_ROWS = 256                   # documents that a Python task takes at a time, at most
BATCH_BYTES = 2 << 20              # bytes after which a Python task takes no more documents at that time


def by_value(module: str) -> None:
    """Task functions of the module travel with the job, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(column="text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text that is not null."""
    return F.array_remove(F.split(text, BLANKS), "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, also if lambdas inside the body use it for each element."""
    return F.transform(F.array(value), body)[0]


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall in no fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names an operator is about to use, whatever their case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def whole_documents(df: DataFrame) -> DataFrame:
    """Let Python tasks of the session take few rows and bytes at a time: a row is a whole document, and thousands, or hundreds of long
    ones, would fill the memory."""
    conf, size = df.sparkSession.conf, df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if size(conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) not in range(1, BATCH_BYTES + 1):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


class Remembered(dict):
    """Solved short segments in two generations of bounded size; of a full pair the older one is forgotten."""

    def __init__(self, solve, chars: int, entries: int):
        super().__init__()
        self.solve, self.chars, self.entries, self.older = solve, chars, entries, {}

    def __missing__(self, segment):
        made = self.older.get(segment)
        if made is None:
            made = self.solve(segment)
        if len(segment) <= self.chars:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[segment] = made
        return made


def bounded_sample(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """About ``bound`` rows at most, picked by a hash of the key: the same rows on every run, spread over the whole table.

    Only for fitting: with ``bound`` or fewer rows all are used.
    """
    total = df.count()
    if total <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("fit")), F.lit(1 << 20)) < int(bound / total * (1 << 20)))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int, bound: int) -> DataFrame:
    """(doc_id, text, label) of about ``bound`` labelled documents at most, none of them of the held-out fold.

    The labels alone are counted and thinned by a hash of the id, so the broadcast side has a fixed bound and no text is
    shuffled.  Of contradicting labels of one id the larger counts.  Written once, as fitting reads it several times.
    """
    known = labels.where(F.col(column).isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(
        F.max(column).cast("int").alias("label"))
    few = materialize(bounded_sample(known, F.col("doc_id"), bound))
    return materialize(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"))

"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""
from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.frames import dense_positions, materialize
from .common import whole_text, without, words

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 17


def offset(seed: int) -> float:
    """The one random start of the sample, in [0, 1)."""
    return random.Random(seed).randrange(1 << 20) / (1 << 20)


def sized(df: DataFrame) -> DataFrame:
    return without(df, "size").withColumn("size", F.size(words(whole_text())).cast("long"))


def targets(rows: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: its rows, size, weight, target and the number of rows of earlier sources.

    Sources in code-point order (null last) take the weights in turn.  Raising a common level, each source gets level x weight
    until it reaches ``most`` times its size; sources sorted by that point, the level is settled by running sums.  The windows
    run over one row per source.
    """
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumns({
        "weight": F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")),
        "start": F.sum("rows").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows"),
        "cap": most * F.col("source_size")})
    per = per.withColumn("stops", F.col("cap") / F.col("weight"))
    order = [F.col("stops"), F.col("source").asc_nulls_last()]
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - (F.sum("cap").over(upto) - F.col("cap"))) / (
        F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight"))
    per = per.withColumns({"level": level, "place": F.row_number().over(Window.orderBy(*order))})
    settled = F.min(F.when(F.col("stops") > F.col("level"), F.struct("place", "level"))).over(every)["level"]
    return per.withColumn("target", F.when(settled.isNull(), F.col("cap").cast("double"))
                          .otherwise(F.least(F.col("cap").cast("double"), settled * F.col("weight"))))


def mix(df: DataFrame, **settings) -> DataFrame:
    """Add ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken`` to rows with ``doc_id``, ``source``, ``text``.

    A document is expected to be taken target / source_size times.  Within its source, rows lie in order of size, id and a hash of the row;
    the expected copies are summed along that order, one random offset is added, and a row is taken once for each whole
    number its interval crosses.  As neighbours in the order have like sizes, the words taken come within about one document
    of the target, and no row is taken more than ``most`` times.  Positions come from a range partitioning by source, size
    and id, which splits hot sources.  The same rows and seed give the same mix.

    A null or empty text has size 0; a null source is the last source; a source without words has target 0.  Repeated rows
    are rows of their own.  An empty table gives an empty table; columns named like added ones are replaced.
    """
    return mix_sized(sized(df), **settings)


def mix_sized(df: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """``mix`` for rows that have their ``size`` already and need no text."""
    kept = without(df, "source_size", "target", "copies", "taken")
    rows = kept.select("doc_id", "source", "size", F.struct("*").alias("_row"))              # so that no input column clashes with a helper
    per = materialize(targets(rows.select("source", "size"), weights, most)
                      .select(F.col("source").alias("_s"), "source_size", "target", "start"))
    placed = dense_positions(rows, [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"), F.xxhash64("_row")], "_k")
    mix = taken(placed.join(per, F.col("source").eqNullSafe(F.col("_s"))), offset(seed))
    return mix.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept.columns], "source_size", "target", "copies", "taken")


def taken(rows: DataFrame, u: float) -> DataFrame:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))

    def crossed(k: Column) -> Column:
        return F.floor(k * rate + F.lit(u))

    k = F.col("_k") - F.col("start")
    return rows.withColumn("copies", (crossed(k + 1) - crossed(k)).cast("int")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(df: DataFrame, **settings) -> DataFrame:
    """The mix itself: the input's columns, each row as many times as it is taken."""
    columns = df.columns
    row = sized(df.select("doc_id", "source", "text", F.struct("*").alias("_row"))).drop("text")
    again = mix_sized(row, **settings).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])

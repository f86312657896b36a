"""Readers and writers of the mail log, the whitelist and the result tables."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.frames import materialize, spread_join
from ..vocab import REQUIRED_COLUMNS, WHITELIST_COLUMNS

# Headers are compared with the schema, and a row with too few or too many cells is an error: neither shifts cells silently.
CSV_OPTIONS = {"header": True, "multiLine": False, "escape": '"', "mode": "FAILFAST", "enforceSchema": False,
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


MOST_ORDERS = 100                  # orders of columns that one read parses


def strings(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def validate_required(df: DataFrame, required=None) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"Missing required fields: {', '.join(missing)}")
    return df


def missing_columns(df: DataFrame, required=None) -> list[str]:
    return [c for c in (REQUIRED_COLUMNS if required is None else required) if c not in df.columns]


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV folder or file: one line is read, nothing is inferred."""
    return spark.read.options(**CSV_OPTIONS).csv(path).columns


def src_mail_csv(spark: SparkSession, path: str | list[str], multiline: bool = False, keep_broken: bool = False) -> DataFrame:
    """Mail log from CSV, every column a string.  Files stay splittable unless ``multiline`` is needed.

    Each path has one header; several paths (or glob patterns), one per order of columns, are put together by name.  A file with
    another header is an error, and so is a row with too few or too many cells, such as one with a line break in quotes when
    ``multiline`` is off; ``keep_broken`` keeps such rows, with the whole line in ``_corrupt_record``, so that they can be counted.
    """
    parts = []
    for one in [path] if isinstance(path, str) else path:
        schema = strings(header_of(spark, one) + (["_corrupt_record"] if keep_broken else []))
        reader = spark.read.options(**CSV_OPTIONS).option("multiLine", multiline).schema(schema)
        parts.append(validate_required(reader.option("mode", "PERMISSIVE" if keep_broken else "FAILFAST").csv(one)))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def lines_of(reader, path: str) -> DataFrame:
    """(file, line) of text files, on a batch or a stream reader."""
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")


def _cells(line) -> Column:
    return F.transform(F.split(F.regexp_replace(line, '[\ufeff"\r]', ""), ","), F.trim)


def by_header(lines: DataFrame, required=None, most_orders: int = MOST_ORDERS) -> tuple[DataFrame, DataFrame]:
    """(mails, broken) of CSV lines from files with columns in any order.

    An index of the files' headers, the line that names all ``required`` columns, is written first.  Lines are parsed with the
    header of their own file, one parse per distinct order (``most_orders`` at most), and put together by name; further columns
    are kept if all orders have them.  ``broken`` (file, line, reason) takes what does not fit instead of stopping: files
    without a header, files beyond the number of orders, rows with too few or too many cells (also those that a line break in
    quotes cuts in two).  Nothing is lost: every line but the headers is in one of the two.
    """
    required = list(REQUIRED_COLUMNS if required is None else required)
    header = F.size(F.array_except(F.array(*[F.lit(c) for c in required]), _cells(F.col("line")))) == 0
    index = materialize(lines.where(header).groupBy("file").agg(F.min("line").alias("_header")))
    orders = [r["_header"] for r in index.groupBy("_header").count().orderBy(F.desc("count"), "_header").limit(most_orders).collect()]
    tagged = spread_join(lines, index, "file", row_id="line", written=True).where(F.col("_header").isNull() | ~header)
    known = F.col("_header").isin(orders) if orders else F.lit(False)
    lost = tagged.where(~F.coalesce(known, F.lit(False))).select("file", "line", F.when(F.col("_header").isNull(), "no header").otherwise("too many orders of columns")
                                                                 .alias("reason"))
    mails, names = [], [[c.strip() for c in re.sub('[\ufeff"\r]', "", h).split(",")] for h in orders]
    shared = [c for c in (names[0] if names else required) if all(c in n for n in names)]
    for text, order in zip(orders, names):
        unique = [c if order.index(c) == i else f"{c}_{i}" for i, c in enumerate(order)]
        rows = tagged.where(F.col("_header") == text).withColumn("_row", _parsed(unique))
        bad = F.col("_row._corrupt_record").isNotNull()
        mails.append(rows.where(~bad).select("file", *[F.col(f"_row.`{c}`").alias(c) for c in shared]))
        lost = lost.unionByName(rows.where(bad).select("file", "line", F.lit("other number of cells").alias("reason")))
    if not mails:
        return lost.select("file", *[F.lit(None).cast("string").alias(c) for c in shared]).limit(0), lost
    return reduce(DataFrame.unionByName, mails), lost


def _parsed(names) -> Column:
    """The cells of a line by name; ``_corrupt_record`` holds the line if their number differs."""
    schema = ", ".join(f"`{c}` string" for c in [*names, "_corrupt_record"])
    return F.from_csv(F.regexp_replace("line", "\r$", ""), schema, {"mode": "PERMISSIVE", "escape": '"', "columnNameOfCorruptRecord": "_corrupt_record"})


def src_mail_any(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(mails, broken) of a folder, file or glob pattern of CSV files whose columns may stand in any order (see ``by_header``)."""
    return by_header(lines_of(spark.read, path))


def src_mail_parquet(spark: SparkSession, path: str) -> DataFrame:
    return validate_required(spark.read.parquet(path))


def src_whitelist_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.options(**CSV_OPTIONS).schema(strings(header_of(spark, path))).csv(path)
    missing = missing_columns(rows, WHITELIST_COLUMNS)
    if missing:
        raise ValueError(f"Missing required fields: {', '.join(missing)}")
    return rows.select(*WHITELIST_COLUMNS)


def empty_whitelist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], strings(WHITELIST_COLUMNS))


def flat(df: DataFrame) -> DataFrame:
    """Arrays as joined text, so that the frame can be written as CSV."""
    return df.select(*[F.array_join(f.name, ", ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
                       for f in df.schema.fields])


def sink_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write one CSV folder, in parallel, with a header in each file."""
    flat(df).write.mode(mode).options(header=True, escape='"', ignoreLeadingWhiteSpace=False,
                                       ignoreTrailingWhiteSpace=False).csv(path)
    return path


def sink_mail_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Persist a processed log partitioned by mail date, for partition pruning."""
    (df.withColumn("mail_date", F.to_date("time")).repartition("mail_date", F.pmod(F.xxhash64("mail_id"), F.lit(64)))
     .write.mode(mode).partitionBy("mail_date").parquet(path))
    return path


def with_mail_id(df: DataFrame) -> DataFrame:
    """Add a unique ``mail_id`` to a log that has none.

    The numbered rows are written once, so that the numbers stay the same when tasks are rerun.
    """
    if "mail_id" in df.columns:
        return df
    return materialize(df.withColumn("mail_id", F.monotonically_increasing_id()))


def preview_head(df: DataFrame, n: int = 5, *order: str) -> DataFrame:
    return df.orderBy(*(order or ("mail_id",))).limit(n)

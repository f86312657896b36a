"""Cleaning and typing of the raw mail log."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import FORMATS as TIME_FORMATS, read_time, readings
from ..functions.frames import spread_join
from ..functions.text import blank_if_null, col, filled, memo, strip

DAY_MICROS = 86_400_000_000
TIME_COLUMNS = ("time", "last_working_day")


def is_time(dtype: T.DataType | None) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def to_time(c, dtype: T.DataType | None = None, formats=TIME_FORMATS, day_first: Column | bool = False) -> Column:
    """Timestamp from text in ISO or one of the given formats; anything else becomes null."""
    return col(c).cast("timestamp") if is_time(dtype) else read_time(c, formats, day_first)


def _cells(df: DataFrame, columns, file: str | None) -> DataFrame:
    """(file, column, text): the filled cells of the columns that are still text."""
    texts = [c for c in columns if not is_time(df.schema[c].dataType)]
    name = F.col(file) if file else F.lit(None).cast("string")
    empty = F.array().cast("array<struct<column:string,text:string>>")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), strip(F.col(c).cast("string")).alias("text")) for c in texts]) if texts else empty
    return df.select(name.alias("file"), F.inline(cells)).where(filled("text") & (F.lower("text") != "nan"))


def vote_dates(df: DataFrame, columns=TIME_COLUMNS, formats=TIME_FORMATS, file: str | None = None) -> DataFrame:
    """One row per file and text column: how its times are written, and whether the day stands before the month.

    Every filled cell votes: with its format, and with an order if it can be read in one order only ("13/01/2024" has the day in
    front).  The order with more votes holds for the cells that could be either (``either``); without a majority the month is
    first.  ``failed`` counts the cells that no format can read, ``outvoted`` those that can only be read against the order.
    ``file`` names the column that tells the files apart; without it the whole log is one file.  Two aggregations over
    (file, column, format), combined before the shuffle.
    """
    r = F.col("r")
    month, day = r["month_first"], r["day_first"]
    kinds = _cells(df, columns, file).withColumn("r", readings(F.col("text"), formats)).groupBy("file", "column", r["format"].alias("format")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(r.isNull()).alias("failed"), F.count_if(month.isNull() & day.isNotNull()).alias("day_votes"),
        F.count_if(day.isNull() & month.isNotNull()).alias("month_votes"), F.count_if(month != day).alias("either"))
    sums = {c: F.sum(c).alias(c) for c in ("failed", "day_votes", "month_votes", "either")}
    best = F.max_by("format", F.when(F.col("format").isNotNull(), F.struct("n", "format")))
    return (kinds.groupBy("file", "column").agg(F.sum("n").alias("cells"), *sums.values(), best.alias("main_format"),
                                                F.count("format").alias("formats"))
            .withColumn("day_first", F.col("day_votes") > F.col("month_votes")).withColumn("outvoted", F.least("day_votes", "month_votes")))


def failed_dates(df: DataFrame, columns=TIME_COLUMNS, formats=TIME_FORMATS, file: str | None = None) -> DataFrame:
    """The distinct texts that no format can read, with their number, per file and column."""
    cells = _cells(df, columns, file)
    return cells.where(readings(F.col("text"), formats).isNull()).groupBy("file", "column", "text").agg(F.count(F.lit(1)).alias("cells"))


def parse_time(df: DataFrame, columns=TIME_COLUMNS, formats=TIME_FORMATS, file: str | None = None, vote: bool = False,
               row_id: str = "mail_id") -> DataFrame:
    """Timestamps instead of texts.  Texts that could have day or month in front are read month first, or with ``vote`` in the order
    that the column's own values settle in each file; ``row_id`` spreads the rows of a large file if there are very many files."""
    if not vote:
        return df.withColumns({c: to_time(c, df.schema[c].dataType, formats) for c in columns})
    order = vote_dates(df, columns, formats, file).groupBy(F.col("file").alias("_file")).agg(
        *[F.bool_or(F.when(F.col("column") == c, F.col("day_first"))).alias(f"_day_{c}") for c in columns])
    rows = spread_join(df.withColumn("_file", F.col(file) if file else F.lit(None).cast("string")), order, "_file", row_id)
    return (rows.withColumns({c: to_time(c, df.schema[c].dataType, formats, F.col(f"_day_{c}")) for c in columns})
            .drop("_file", *[f"_day_{c}" for c in columns]))


def clean_text(df: DataFrame) -> DataFrame:
    def denan(c: Column) -> Column:
        return F.when(c == "nan", "").otherwise(c)
    changes = {c: denan(strip(F.lower(blank_if_null(c)))) for c in ("sender", "recipients")}
    for c in ("subject", "word_list_match", "sender_domain", "recipient_domain", "email_domain"):
        if c in df.columns:
            changes[c] = denan(strip(blank_if_null(c)))
    changes["attachments"] = denan(blank_if_null("attachments"))
    return df.withColumns(changes)


def hour_dow(df: DataFrame) -> DataFrame:
    return df.withColumns({"hour": F.hour("time"), "day_of_week": F.weekday("time")})


def after_hours(hour="hour", dow="day_of_week") -> Column:
    h, d = col(hour), col(dow)
    return F.coalesce((h < 8) | (h >= 18) | (d >= 5), F.lit(False))


def day_gap(later="time", earlier="last_working_day") -> Column:
    """Whole days between two timestamps, rounded towards minus infinity."""
    d = F.unix_micros(col(later)) - F.unix_micros(col(earlier))
    return ((d - F.pmod(d, F.lit(DAY_MICROS))) / DAY_MICROS).cast("int")


def leaver(days="days_from_last_working") -> Column:
    return F.coalesce(col(days).between(-7, 7), F.lit(False))


@memo
def attachment_types(attachments="attachments") -> Column:
    return F.array_sort(F.array_distinct(
        F.regexp_extract_all(blank_if_null(attachments), F.lit(r"\.([a-zA-Z0-9]+)"), F.lit(1))))


@memo
def recipient_count(recipients="recipients") -> Column:
    parts = F.split(strip(blank_if_null(recipients)), r"(?U)[;,\s]+")
    return F.size(F.filter(parts, lambda r: F.contains(r, F.lit("@"))))


def comma_recipients(recipients="recipients") -> Column:
    """Plain comma count, as the scoring rules use it."""
    return F.size(F.split(blank_if_null(recipients), ","))


@memo
def recipient_domains_simple(recipients="recipients") -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(
        blank_if_null(recipients), F.lit(r"[\p{L}\p{N}_.\-]+@([\p{L}\p{N}_.\-]+)"), F.lit(1))))


def recipient_domain_wrap(recipient_domain="recipient_domain") -> Column:
    c = col(recipient_domain)
    return F.when(filled(c), F.array(c)).otherwise(F.array().cast("array<string>"))


def attachment_count(attachments="attachments") -> Column:
    return F.regexp_count(blank_if_null(attachments), F.lit(r"\.[a-zA-Z]+"))


def mail_normalize(df: DataFrame, formats=TIME_FORMATS, file: str | None = None, vote: bool = False) -> DataFrame:
    """The whole cleaning chain: types, trimmed text, time parts, leaver and attachment columns.

    ``formats``, ``file`` and ``vote`` say how times are written (see ``parse_time``).
    """
    raw_attachments = F.col("attachments").cast("string")
    staged = (parse_time(df, formats=formats, file=file, vote=vote)
              .withColumns({"has_attachments": filled(raw_attachments),
                            "attachment_types": attachment_types(raw_attachments)}))
    staged = hour_dow(clean_text(staged))
    staged = staged.withColumns({
        "is_after_hours": after_hours(),
        "days_from_last_working": day_gap(),
        "recipient_count": recipient_count(),
    }).withColumn("is_leaver", leaver())
    if "recipient_domain" in df.columns:
        return staged.withColumn("recipient_domains", recipient_domain_wrap())
    return (staged.withColumn("recipient_domains", recipient_domains_simple())
            .withColumn("recipient_domain", F.coalesce(F.get("recipient_domains", F.lit(0)), F.lit(""))))


@memo
def name_from_address(address="sender") -> Column:
    user = F.substring_index(blank_if_null(address), "@", 1)

    def capital(c: Column) -> Column:
        return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))
    parts = F.split(user, r"\.")
    return (F.when(~F.contains(blank_if_null(address), F.lit("@")), "Colleague")
            .when(F.contains(user, F.lit(".")),
                  F.concat(capital(F.get(parts, F.lit(0))), F.lit(" "), capital(F.get(parts, F.lit(1)))))
            .otherwise(capital(user)))


def format_mail_date(time="time") -> Column:
    return F.coalesce(F.date_format(col(time), "MMMM dd, yyyy 'at' hh:mm a"), F.lit("Unknown Date"))

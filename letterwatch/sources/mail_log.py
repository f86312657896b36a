"""The mail log that the queries run on, derived row by row from the ``events`` table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.frames import materialize

# The same text runs on Spark SQL and on the checking engine; {events} is the table name.
MAIL_LOG_SQL = """
WITH e AS (
  SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, event_type,
         CASE WHEN user_id % 10 = 3 THEN user_id % 30 ELSE user_id END AS sid
  FROM {events}),
d AS (
  SELECT e.*,
    CASE WHEN sid % 10 = 3 THEN 'corp.example' WHEN sid % 17 = 5 THEN 'gmail.com'
         WHEN sid % 19 = 4 THEN 'eu.corp.example' ELSE 'corp.example' END AS sdom,
    CASE event_id % 11 WHEN 0 THEN 'corp.example' WHEN 1 THEN 'gmail.com' WHEN 2 THEN 'mail.corp.example'
         WHEN 3 THEN 'partnerbank.com' WHEN 4 THEN 'yahoo.co.uk' WHEN 5 THEN 'clinic-care.org'
         WHEN 6 THEN 'x1234567.tk' WHEN 7 THEN 'protonmail.com' WHEN 8 THEN 'cyberdata.io'
         WHEN 9 THEN 'state.gov' ELSE 'mailinator.com' END AS rdom
  FROM e)
SELECT
  event_id AS mail_id,
  CASE WHEN sid % 10 = 3 THEN date_trunc('day', ts) + INTERVAL 9 HOUR ELSE ts END AS time,
  concat('first', CAST(sid AS STRING), '.last', CAST(sid % 7 AS STRING), '@', sdom) AS sender,
  sdom AS sender_domain,
  CASE WHEN event_id % 29 = 0 THEN concat('a@', rdom, ',b@', rdom, ',c@gmail.com,d@corp.example,e@cyberdata.io,f@state.gov,g@yahoo.com')
       WHEN event_id % 13 = 0 THEN concat('a@', rdom, ',b@hotmail.com,c@corp.example,d@partnerbank.com')
       WHEN event_id % 7 = 0 THEN concat('p', CAST(event_id % 5 AS STRING), '@', rdom, ', q@corp.example')
       WHEN event_id % 101 = 0 THEN ''
       ELSE concat('p', CAST(event_id % 5 AS STRING), '@', rdom) END AS recipients,
  CASE WHEN event_id % 101 = 0 THEN '' ELSE rdom END AS recipient_domain,
  CASE WHEN event_id % 101 = 0 THEN '' ELSE rdom END AS email_domain,
  CASE event_id % 6 WHEN 0 THEN 'confidential, budget' WHEN 1 THEN 'internal' WHEN 2 THEN '0' ELSE '' END AS word_list_match,
  CASE event_id % 8 WHEN 0 THEN 'Quarterly budget forecast' WHEN 1 THEN 'Source code and API key'
       WHEN 2 THEN 'Audit: SSN 123-45-6789' WHEN 3 THEN 'Lunch on Friday' WHEN 4 THEN 'Patient treatment contract'
       WHEN 5 THEN 'Call 555-123-4567 re trade secret' WHEN 6 THEN 'RE: weekly status' ELSE '' END AS subject,
  CASE event_id % 9 WHEN 0 THEN 'plan.docx' WHEN 1 THEN 'dump_large.zip' WHEN 2 THEN 'a.pdf;b.xlsx;c.csv;d.txt'
       WHEN 3 THEN '0' WHEN 4 THEN 'november.png' ELSE '' END AS attachments,
  CASE WHEN sid % 12 = 7 THEN TIMESTAMP '2024-01-20 00:00:00' ELSE NULL END AS last_working_day,
  CASE sid % 4 WHEN 0 THEN 'Retail' WHEN 1 THEN 'Markets' WHEN 2 THEN 'Ops' ELSE 'Legal' END AS bunit,
  CASE sid % 9 WHEN 0 THEN 'Sales' WHEN 1 THEN 'IT' WHEN 2 THEN 'HR' WHEN 3 THEN 'Finance' ELSE 'Engineering' END AS department,
  CASE WHEN event_id % 3 = 0 THEN '1' WHEN event_id % 3 = 1 THEN 'None' ELSE '' END AS mimecast,
  CASE WHEN event_id % 5 < 2 THEN 'true' ELSE '0' END AS tessian,
  CASE WHEN event_id % 5 < 2 THEN 'pii-policy' ELSE '' END AS tessian_policy,
  '' AS tessian_response, '' AS tessian_outcome, 'external' AS recipient_status, 'send' AS act, 'true' AS delivered,
  '' AS deliveryErrors, 'outbound' AS direction, event_type AS eventtype, CAST(event_id AS STRING) AS aggreatedid,
  CASE sid % 2 WHEN 0 THEN 'Consumer' ELSE 'Wholesale' END AS businessPillar
FROM d
"""

WHITELIST_SQL = """SELECT * FROM (VALUES ('first8.last1@corp.example', NULL), (NULL, 'partnerbank.com'),
  (NULL, 'eu.corp.example')) AS t(email_address, domain)"""


# An uneven input with more rows than this is written anew instead of being dealt out in every pass.
WRITTEN_ROWS = 500_000


def balanced(df: DataFrame, key: str, written_rows: int = WRITTEN_ROWS) -> DataFrame:
    """Spread an input that Spark cannot split evenly over the cores; leave any other as it is.

    Files are split by bytes but read by row groups, so the rows of each partition are counted (the footers tell).  Filters are
    pushed below an exchange, into the few tasks that read the row groups; a large input is therefore written once in even parts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    total = sum(sizes)
    if max(sizes, default=0) * cores <= 1.5 * total:
        return df
    if total <= written_rows:
        return df.repartition(cores, key)
    return materialize(df.repartition(max(cores, -(-total // written_rows)), *df.columns))


def mail_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["event_id", "user_id", "ts", "event_type"]
    events = balanced(spark.read.parquet(f"{sf_dir}/events.parquet").select(*columns), "event_id")
    return spark.sql(MAIL_LOG_SQL, events=events)


def whitelist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("first8.last1@corp.example", None), (None, "partnerbank.com"),
                                  (None, "eu.corp.example")], "email_address string, domain string")


def raw_mail_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as it would arrive: text only, several time formats, stray blanks, capitals and 'nan' cells."""
    m, k = mail_log(spark, sf_dir), F.col("mail_id")
    stamp = (F.when(k % 5 == 0, F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
             .when(k % 5 == 1, F.date_format("time", "MM/dd/yyyy HH:mm"))
             .when(k % 5 == 2, F.lit("not a time"))
             .when(k % 5 == 3, F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss")))
    return m.withColumns({
        "time": stamp,
        "last_working_day": F.date_format("last_working_day", "yyyy-MM-dd HH:mm:ss"),
        "sender": F.when(k % 89 == 0, F.lit(None)).when(k % 97 == 0, "nan")
                   .when(k % 4 == 0, F.concat(F.lit("  "), F.upper("sender"), F.lit("\t"))).otherwise(F.col("sender")),
        "recipients": F.when(k % 83 == 0, " NaN ").when(k % 3 == 0, F.upper("recipients")).otherwise(F.col("recipients")),
        "subject": F.when(k % 79 == 0, F.lit(None)).when(k % 5 == 0, F.concat(F.lit(" "), "subject", F.lit("  ")))
                    .otherwise(F.col("subject")),
        "word_list_match": F.when(k % 73 == 0, "nan").otherwise(F.col("word_list_match")),
        "attachments": F.when(k % 71 == 0, F.lit(None)).when(k % 67 == 0, "nan").otherwise(F.col("attachments")),
    })


def dirty_mail_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log that the reports run on: undated mails, missing and blank senders, departments and units, stray capitals, 'nan' cells."""
    m, k = mail_log(spark, sf_dir), F.col("mail_id")
    return m.withColumns({
        "time": F.when(k % 41 != 0, F.col("time")),
        "sender": F.when(k % 89 == 0, F.lit(None)).when(k % 97 == 0, "nan")
                   .when(k % 4 == 0, F.concat(F.lit("  "), F.upper("sender"), F.lit("\t"))).otherwise(F.col("sender")),
        "recipients": F.when(k % 83 == 0, " NaN ").when(k % 3 == 0, F.upper("recipients")).otherwise(F.col("recipients")),
        "subject": F.when(k % 79 == 0, F.lit(None)).when(k % 5 == 0, F.concat(F.lit(" "), "subject", F.lit("  "))).otherwise(F.col("subject")),
        "word_list_match": F.when(k % 73 == 0, "nan").otherwise(F.col("word_list_match")),
        "attachments": F.when(k % 71 == 0, F.lit(None)).when(k % 67 == 0, "nan").otherwise(F.col("attachments")),
        "department": F.when(k % 53 != 0, F.col("department")), "bunit": F.when(k % 47 != 0, F.col("bunit"))})


def mixed_mail_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as five files would bring it, each with its own way to write times, and some cells that are no time at all."""
    m, k = mail_log(spark, sf_dir), F.col("mail_id")
    def written(*formats):
        return F.element_at(F.array(*[F.date_format("time", f) for f in formats]), (F.pmod(F.floor(k / 5), F.lit(len(formats))) + 1).cast("int"))
    stamp = (F.when(k % 5 == 0, written("M/d/yyyy H:mm:ss", "M/d/yyyy h:mm a")).when(k % 5 == 1, written("dd/MM/yyyy HH:mm", "d.M.yyyy H:mm:ss"))
             .when(k % 5 == 2, written("yyyy-MM-dd HH:mm:ss", "yyyy/M/d H:mm", "yyyy-MM-dd'T'HH:mm:ss"))
             .when(k % 5 == 3, written("d-MMM-yyyy HH:mm", "MMM d, yyyy h:mm a", "EEE, d MMM yyyy HH:mm:ss"))
             .otherwise(F.when(F.dayofmonth("time") <= 12, F.date_format("time", "dd-MM-yyyy"))))         # never shows its order
    return m.withColumns({
        "file": F.element_at(F.array(*[F.lit(f) for f in ("us", "eu", "iso", "words", "unclear")]), (k % 5 + 1).cast("int")),
        "time": F.when(k % 61 == 0, F.concat(F.lit("no time "), (k % 3).cast("string"))).when(k % 67 == 0, " ").otherwise(stamp),
        "last_working_day": F.date_format("last_working_day", "dd/MM/yyyy")})

"""Ingestion of arriving mail-log files: the batch stages, which work row by row, on a stream."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.content import detect_keywords
from ..operators.domains import classify_domains
from ..operators.normalize import mail_normalize
from ..sources.csv import CSV_OPTIONS, by_header, lines_of, strings
from ..vocab import REQUIRED_COLUMNS


def stream_mail_csv(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return (spark.readStream.options(**CSV_OPTIONS).option("maxFilesPerTrigger", files_per_batch)
            .schema(strings(REQUIRED_COLUMNS)).csv(folder))


def process(mails: DataFrame) -> DataFrame:
    """Normalise, classify and scan; the same plan for a batch and for a stream."""
    return detect_keywords(classify_domains(mail_normalize(mails)))


def write_stream(mails: DataFrame, out: str, checkpoint: str, once: bool = False):
    """Append processed mails as Parquet, partitioned by mail date; restarts continue from the checkpoint."""
    writer = (process(mails).withColumn("mail_date", F.to_date("time")).writeStream.format("parquet")
              .partitionBy("mail_date").option("checkpointLocation", checkpoint).outputMode("append"))
    return (writer.trigger(availableNow=True) if once else writer).start(out)


def ingest_any(spark: SparkSession, folder: str, out: str, broken: str, checkpoint: str, once: bool = False, files_per_batch: int = 100):
    """Files whose columns may stand in any order, processed into ``out``; what does not fit goes to ``broken`` and stops nothing.

    Lines arrive with the name of their file; each micro-batch indexes the headers of its files (see ``csv.by_header``).  Both
    tables are partitioned by the number of the micro-batch and a repeated one overwrites its own partition, so a restart
    neither loses nor doubles rows.  A file must be complete when it appears in the folder.
    """
    lines = lines_of(spark.readStream.option("maxFilesPerTrigger", files_per_batch), folder)

    def step(batch: DataFrame, number: int) -> None:
        mails, lost = by_header(batch)
        for rows, path in ((process(mails), out), (lost, broken)):
            (rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))

    writer = lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_sender_days(mails: DataFrame, delay: str = "1 day") -> DataFrame:
    """Mails per sender and day; a day is final once the watermark has passed it."""
    return (mails.withWatermark("time", delay).groupBy("sender", F.window("time", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("mails")).select("sender", F.to_date("w.start").alias("day"), "mails"))

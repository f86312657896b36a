"""Large logs: uneven input is dealt out, and costly stages run over the mails once."""
import datetime

import pytest
from pyspark.sql import functions as F

from letterwatch.functions import frames
from letterwatch.operators import anomaly as A, content as K, iforest as I, whitelist as W
from letterwatch.plans import base as B
from letterwatch.sources import mail_log as M


@pytest.fixture()
def counted_rows(spark):
    """Marks a frame so that every row made is counted, however many passes ask for it."""
    seen = spark.sparkContext.accumulator(0)

    def marked(df):
        def passing(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch
        return df.mapInPandas(passing, df.schema)
    return marked, seen


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=37 * i), i * 7 % 23, "view") for i in range(3000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("written_rows", [100_000, 1000])
def test_one_row_group_is_dealt_out_below_filters(spark, tmp_path, written_rows):
    spark.range(20_000).select(F.col("id").alias("event_id"), F.md5(F.col("id").cast("string")).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")              # many splits, one of which holds the only row group
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = M.balanced(spark.read.parquet(f"{tmp_path}/t"), "event_id", written_rows)
        rows = df.where("text >= '8'")
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert df.count() == 20_000 and df.agg(F.sum("event_id")).first()[0] == sum(range(20_000))
        assert ("Exchange" in rows._jdf.queryExecution().executedPlan().toString()) == (written_rows == 100_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(sizes) >= 8 and max(sizes) < 0.3 * sum(sizes)


def test_even_input_is_left_as_it_is(spark):
    df = spark.range(0, 5000, 1, 16)
    assert M.balanced(df, "id", 10) is df


def test_high_risk_content_scans_every_mail_once(spark, counted_rows):
    marked, seen = counted_rows
    df = marked(spark.range(0, 4000, 1, 4).select(F.col("id").alias("mail_id"), (F.col("id") * 13 % 101).cast("int").alias("sensitivity_score")))
    got = K.high_risk_content(df).collect()
    want = sorted(((i * 13 % 101, i) for i in range(4000) if i * 13 % 101 >= 30), key=lambda r: (-r[0], r[1]))
    assert [(r["sensitivity_score"], r["mail_id"]) for r in got] == want
    assert seen.value == 4000


def test_forest_makes_every_mail_once(spark, counted_rows):
    marked, seen = counted_rows
    k = F.col("id")
    mails = spark.range(0, 2000, 1, 4).select(
        k.alias("mail_id"), F.when(k % 50 != 0, F.concat(F.lit("s"), (k % 37).cast("string"))).alias("sender"), F.lit("d").alias("department"),
        (k % 24).cast("int").alias("hour"), (k % 7).cast("int").alias("day_of_week"), (k % 5).cast("int").alias("recipient_count"),
        (k % 3 == 0).alias("has_attachments"), (k % 24 > 18).alias("is_after_hours"), F.lit(False).alias("is_leaver"),
        F.lit("business").alias("email_domain_type"))
    once = I.with_anomalies(marked(mails), trees=5, sample=32)
    flagged = once.where("is_anomaly").count()
    assert once.count() == 2000 and 0 < flagged <= 200 and seen.value == 2000
    assert I.with_anomalies(mails.limit(0)).count() == 0


def test_ruled_writes_named_columns_once(spark, tables):
    lean, full = B.ruled(spark, tables, "department", "risk_level"), B.ruled(spark, tables)
    plan = lean._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "user_id" not in plan                   # nothing of the log is made again
    columns = ["mail_id", "department", "risk_level", "is_anomaly", "anomaly_score"]
    def rows(df):
        return sorted(map(tuple, df.select(*columns).collect()), key=str)
    assert rows(lean) == rows(full) and any(r[3] for r in rows(lean))


def test_sender_rules_do_not_count_the_mails_again(spark, counted_rows, monkeypatch):
    marked, seen = counted_rows
    monkeypatch.setattr(frames.spread_join, "__defaults__", ("mail_id", 0, False, None))       # as with very many keys
    k = F.col("id")
    mails = marked(spark.range(0, 3000, 1, 4).select(
        k.alias("mail_id"), F.when(k % 3 != 0, F.concat(F.lit("s"), (k % 11).cast("string"))).alias("sender"),
        F.timestamp_seconds(F.lit(1704067200) + k * 1800).alias("time"), (k % 6).cast("int").alias("recipient_count"), (k % 19 == 0).alias("has_attachments")))
    got = {r["mail_id"]: r["is_behavioral_anomaly"] for r in A.sender_anomalies(mails).collect()}
    assert len(got) == 3000 and set(got.values()) == {True, False}
    assert seen.value == 2 * 3000                                           # counted once, marked once


def test_short_whitelist_filter_equals_reasons(spark):
    senders = ["a@x.com", " a@x.com", "A@x.com", "b@y.org", "no address", "two@x.com@y.org", "", None]
    recipients = ["p@q.de", " p@q.de ,b@y.org", "p@q.de,\ta@x.com\xa0", "@y.org", "x,,", "p@y.org.de", "p@q.de;r@y.org", "", None]
    rows = spark.createDataFrame([(9 * i + j, s, r) for i, s in enumerate(senders) for j, r in enumerate(recipients)],
                                 "mail_id long, sender string, recipients string")
    for entries in ([("a@x.com", None), (None, "y.org")], [(None, "x.com")], [("b@y.org", "")], []):
        wl = spark.createDataFrame(entries, "email_address string, domain string")
        for limit in (2000, 0):
            kept = {r["mail_id"] for r in W.whitelist_filter(rows, wl, limit).collect()}
            assert kept == {r["mail_id"] for r in W.whitelist_reason(rows, wl, limit).where("whitelist_reason IS NULL").collect()}
            assert kept == {r["mail_id"] for r in W.whitelist_filter(rows, wl).collect()}
        plan = W.whitelist_filter(rows, wl)._jdf.queryExecution().optimizedPlan().toString()
        assert "is whitelisted" not in plan                                 # no reason is written out to be thrown away

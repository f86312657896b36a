"""Reading times in several formats: shapes, the vote on the order of day and month, failures."""
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from letterwatch.functions import dates
from letterwatch.operators import normalize as N


def log(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "mail_id long, file string, time string, last_working_day string")


def test_twins_and_shapes():
    assert dates.twin("M/d/yyyy[ H:mm[:ss]]") == "d/M/yyyy[ H:mm[:ss]]" and dates.twin("dd.MM.yyyy") == "MM.dd.yyyy"
    assert dates.twin("d-MMM-yyyy") is None and dates.twin("yyyy-M-d") is None and dates.twin("M/d yyyy") is None
    assert dates.month_first("d/M/yyyy") == "M/d/yyyy" and dates.month_first("d MMM yyyy") == "d MMM yyyy"
    assert re.match(dates.shape("M.d.yyyy[ H:mm[:ss]]"), "1.12.2024 9:05") and not re.match(dates.shape("M.d.yyyy[ H:mm[:ss]]"), "1.12.2024 9:05:0")


@pytest.mark.parametrize("text, month, day", [
    ("2024-02-03", "2024-02-03 00:00:00", None), ("2024-02-03T04:05:06", "2024-02-03 04:05:06", None), ("2/3/2024 4:05", "2024-02-03 04:05:00", "2024-03-02 04:05:00"),
    ("13/02/2024", "2024-02-13 00:00:00", None), ("2/13/2024 11:00 PM", "2024-02-13 23:00:00", None), ("3.2.2024 4:05:06", "2024-03-02 04:05:06", "2024-02-03 04:05:06"),
    ("3-Feb-2024 04:05", "2024-02-03 04:05:00", None), ("Sat, 3 Feb 2024 04:05:06", "2024-02-03 04:05:06", None), ("Feb 3, 2024 4:05 am", "2024-02-03 04:05:00", None),
    ("Sat, 3 Feb 2024 04:05:06 +0200", "2024-02-03 02:05:06", None), ("2024/2/3 4:05", "2024-02-03 04:05:00", None), ("30/02/2024", None, None), ("soon", None, None),
    ("", None, None), (None, None, None), ("  2/3/2024\t", "2024-02-03 00:00:00", "2024-03-02 00:00:00")])
def test_reads_both_orders(spark, text, month, day):
    row = spark.createDataFrame([(text,)], "t string").select(dates.read_time("t").cast("string").alias("m"), dates.read_time("t", day_first=True).cast("string").alias("d")).first()
    assert (row["m"], row["d"]) == (month, day or month)


def test_each_file_settles_its_own_order(spark):
    rows = [("us", "1/2/2024", "5/6/2024"), ("us", "1/13/2024", None), ("us", "2/28/2024 10:00", " "), ("us", "14/1/2024", None), ("us", "never", None),
            ("eu", "1/2/2024", "6/13/2024"), ("eu", "13/1/2024", "5/6/2024"), ("eu", "nan", "5/6/2024"), ("open", "1/2/2024", None), (None, "31.12.2023", None), (None, "1.2.2024", None)]
    votes = {(r["file"], r["column"]): r for r in N.vote_dates(log(spark, rows), file="file").collect()}
    us = votes["us", "time"]
    assert (us["cells"], us["failed"], us["month_votes"], us["day_votes"], us["either"], us["outvoted"], us["day_first"]) == (5, 1, 2, 1, 1, 1, False)
    assert votes["eu", "time"]["day_first"] and not votes["eu", "last_working_day"]["day_first"] and not votes["open", "time"]["day_first"]
    assert votes[None, "time"]["day_first"] and votes[None, "time"]["main_format"] == "M.d.yyyy[ H:mm[:ss]]" and ("open", "last_working_day") not in votes
    read = {r["mail_id"]: r for r in N.parse_time(log(spark, rows), file="file", vote=True).collect()}
    day = [read[i]["time"] and read[i]["time"].strftime("%m-%d") for i in range(len(rows))]
    assert day == ["01-02", "01-13", "02-28", "01-14", None, "02-01", "01-13", None, "01-02", "12-31", "02-01"]
    assert read[0]["last_working_day"] == datetime(2024, 5, 6) and read[6]["last_working_day"] == datetime(2024, 5, 6)
    assert [c for c in read[0].asDict()] == ["mail_id", "file", "time", "last_working_day"]
    whole = N.vote_dates(log(spark, rows)).where("column = 'time'").first()
    assert whole["file"] is None and whole["cells"] == 10


def test_failures_are_listed_once(spark):
    rows = [("a", "soon", None), ("a", " soon ", "31/31/2024"), ("b", "soon", ""), ("b", "1/2/2024", "NaN")]
    failed = {(r["file"], r["column"], r["text"]): r["cells"] for r in N.failed_dates(log(spark, rows), file="file").collect()}
    assert failed == {("a", "time", "soon"): 2, ("a", "last_working_day", "31/31/2024"): 1, ("b", "time", "soon"): 1}


def test_formats_are_a_parameter(spark, mails):
    df = mails({"time": "2024;03;01 07.30"}, {"time": "2024-03-01 07:30:00"}, {"time": "1/2/2024"})
    got = [r["time"] for r in N.mail_normalize(df, formats=("yyyy;MM;dd HH.mm",)).orderBy("mail_id").collect()]
    assert got == [datetime(2024, 3, 1, 7, 30), datetime(2024, 3, 1, 7, 30), None]
    voted = N.mail_normalize(mails({"time": "1/2/2024"}, {"time": "15/2/2024 19:00"}), vote=True).orderBy("mail_id").collect()
    assert [r["time"].month for r in voted] == [2, 2] and voted[1]["is_after_hours"]


def test_typed_and_empty_logs(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 2))], "mail_id long, time timestamp").withColumn("last_working_day", F.lit(None).cast("string"))
    assert N.vote_dates(df).collect() == [] and N.parse_time(df, vote=True).first()["time"] == datetime(2024, 1, 2)
    empty = log(spark, [("a", "1/2/2024", None)]).limit(0)
    assert N.vote_dates(empty, file="file").collect() == [] and N.parse_time(empty, file="file", vote=True).collect() == []


def test_vote_combines_before_the_shuffle(spark):
    plan = N.vote_dates(log(spark, [("a", "1/2/2024", None)]), file="file")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("partial_") >= 1 and "SortMergeJoin" not in plan

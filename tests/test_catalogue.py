"""Catalogue against the checking SQL on the small tables, ingestion paths, and a streaming run."""
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from letterwatch.operators import iforest, risk
from letterwatch.plans import base
from letterwatch.sources import csv as S
from letterwatch.sources.mail_log import dirty_mail_log, mail_log, raw_mail_log
from letterwatch.streaming import ingest
from letterwatch.vocab import REQUIRED_COLUMNS

SF = "/root/testdata/sf0.001"
KEYS = ["src_mail_csv", "sink_csv", "followup_queue", "followup_export", "pattern_hits", "mail_normalize", "classify_domains", "detect_keywords", "whitelist_hits", "risk_score_credited", "tier_kpis", "coverage_domains",
        "burst_flag", "first_contact", "late_sender_domains", "sender_anomalies", "dept_anomalies", "followup_render",
        "recipient_domain_stats", "template_check", "bau_temporal", "mail_graph_top"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def checker():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def cell(v):
        return None if v is None else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("key", KEYS)
def test_equals_checking_sql(spark, checker, key):
    df = entry.queries()[key](spark, SF)
    cursor = checker.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


def test_entry_and_keys(spark):
    assert entry.entry(spark).columns == ["tier", "mails", "mean_score", "pct"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scores_and_tiers_partition_the_log(spark):
    rows = base.scored(spark, SF).withColumn("tier", risk.alert_tier())
    assert rows.where("risk_score NOT BETWEEN 0 AND 100 OR tier IS NULL").isEmpty()
    assert rows.count() == mail_log(spark, SF).count()


def test_forest_flags_a_tenth(spark):
    found = iforest.iforest_detect(base.classified(spark, SF))
    assert found.count() == 1000 and 60 <= found.where("is_anomaly").count() <= 100


def test_csv_round_trip_and_parquet(spark, tmp_path):
    raw = raw_mail_log(spark, SF).select(*REQUIRED_COLUMNS)
    S.sink_csv(raw, f"{tmp_path}/csv")
    back = S.with_mail_id(S.src_mail_csv(spark, f"{tmp_path}/csv"))
    assert back.count() == 1000 and back.select("mail_id").distinct().count() == 1000
    S.sink_mail_parquet(base.normalized(spark, SF), f"{tmp_path}/parquet")
    day = spark.read.parquet(f"{tmp_path}/parquet").where("mail_date = '2024-01-05'")
    assert day.count() == dirty_mail_log(spark, SF).where("to_date(time) = '2024-01-05'").count() > 0
    with pytest.raises(ValueError, match="domain"):
        S.sink_csv(raw.select(F.col("sender").alias("email_address")), f"{tmp_path}/bad")
        S.src_whitelist_csv(spark, f"{tmp_path}/bad")


def test_csv_by_name_and_broken_rows(spark, tmp_path):
    names = list(REQUIRED_COLUMNS)
    def put(folder, columns, *rows):
        (tmp_path / folder).mkdir()
        lines = [",".join(columns)] + [",".join(row.get(c, "") for c in columns) for row in rows]
        (tmp_path / folder / "part.csv").write_text("\n".join(lines) + "\n")
        return str(tmp_path / folder)
    one = put("one", names, {"sender": "a@x.org", "department": "IT"})
    two = put("two", names[::-1], {"sender": "b@x.org", "department": "HR"})
    got = S.src_mail_csv(spark, [one, two]).select("sender", "department").collect()
    assert sorted(map(tuple, got)) == [("a@x.org", "IT"), ("b@x.org", "HR")]
    with pytest.raises(Exception):                           # one header does not hold for both folders
        spark.read.options(**S.CSV_OPTIONS).schema(S.strings(names)).csv([one, two]).collect()
    broken = put("broken", names, {"sender": "c@x.org", "subject": '"two\nlines"'})
    assert S.src_mail_csv(spark, broken, multiline=True).count() == 1
    kept = S.src_mail_csv(spark, broken, keep_broken=True).collect()
    assert sum(r["_corrupt_record"] is not None for r in kept) == len(kept) == 2
    with pytest.raises(Exception):
        S.src_mail_csv(spark, broken).collect()


def messy_folder(path):
    """Two orders of columns, an extra column, quoted names, a row too short, one too long, a cell with a line break, a file without header."""
    names = list(REQUIRED_COLUMNS)
    def put(name, columns, *rows, tail=()):
        lines = [",".join(columns)] + [",".join(row.get(c.strip('"'), "") for c in columns) for row in rows]
        (path / name).write_text("\n".join([*lines, *tail]) + "\n")
    path.mkdir()
    put("a.csv", names, {"sender": "a@x.org", "department": "IT", "subject": '"one, two ""three"""'}, tail=["too,short", "x," * 40])
    put("b.csv", [f'"{n}"' for n in names[::-1]], {"sender": "b@x.org", "department": "HR"})
    put("c.csv", ["extra", *names], {"sender": "c@x.org", "department": "Ops", "extra": "more"}, {"sender": "d@x.org", "subject": '"cut\nin two"'})
    (path / "d.csv").write_text("no,header\nat,all\n")
    return str(path)


def test_any_order_of_columns_and_broken_rows_apart(spark, tmp_path):
    mails, broken = S.src_mail_any(spark, messy_folder(tmp_path / "in"))
    assert sorted((r["sender"], r["department"], r["subject"]) for r in mails.collect()) == [
        ("a@x.org", "IT", 'one, two "three"'), ("b@x.org", "HR", None), ("c@x.org", "Ops", None)]
    assert sorted((r["file"][-5:], r["reason"]) for r in broken.collect()) == [
        ("a.csv", "other number of cells")] * 2 + [("c.csv", "other number of cells")] * 2 + [("d.csv", "no header")] * 2
    few, rest = S.by_header(S.lines_of(spark.read, str(tmp_path / "in")), most_orders=1)
    assert few.count() + rest.count() == mails.count() + broken.count() and rest.where("reason LIKE 'too many%'").count() >= 2
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("")
    mails, broken = S.src_mail_any(spark, str(tmp_path / "none"))
    assert mails.collect() == [] == broken.collect() and "sender" in mails.columns


def test_broken_files_do_not_stop_the_stream(spark, tmp_path):
    folder = messy_folder(tmp_path / "in")
    def run():
        ingest.ingest_any(spark, folder, f"{tmp_path}/out", f"{tmp_path}/broken", f"{tmp_path}/checkpoint", once=True, files_per_batch=2).awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").select("sender", "email_domain_type").collect(), spark.read.parquet(f"{tmp_path}/broken").count()
    rows, lost = run()
    assert sorted(r["sender"] for r in rows) == ["a@x.org", "b@x.org", "c@x.org"] and lost == 6
    assert len(run()[0]) == 3                                              # nothing new: nothing doubled
    (tmp_path / "in" / "e.csv").write_text(",".join(REQUIRED_COLUMNS[::-1]) + "\n" + "," * (len(REQUIRED_COLUMNS) - 1) + "\n")
    rows, lost = run()
    assert len(rows) == 4 and lost == 6


def test_stream_equals_batch(spark, tmp_path):
    S.sink_csv(raw_mail_log(spark, SF).select(*REQUIRED_COLUMNS), f"{tmp_path}/in")
    stream = ingest.stream_mail_csv(spark, f"{tmp_path}/in", files_per_batch=3)
    ingest.write_stream(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", once=True).awaitTermination()
    keep = ["sender", "subject", "email_domain_type", "detected_keywords", "sensitivity_score"]
    got = spark.read.parquet(f"{tmp_path}/out").select(*keep)
    want = ingest.process(S.src_mail_csv(spark, f"{tmp_path}/in")).select(*keep)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))

"""Literal rows for the semantic traps of the mail rules."""
import re
import string

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from letterwatch import vocab as V
from letterwatch.functions import content as C, domains as D
from letterwatch.functions.text import truncate_ellipsis
from letterwatch.operators import behaviour as H, coverage as G, followup as Q, normalize as N, risk as R, whitelist as W
from letterwatch.sources import csv as S


def one(df, *columns):
    row = df.select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def column(df, expr):
    return [r[0] for r in df.select("i", expr.alias("v")).orderBy("i").select("v").collect()]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="Missing required fields: .*recipients.*department"):
        S.validate_required(spark.createDataFrame([("x", "y")], "time string, sender string"))


def test_normalise_cells(mails):
    rows = N.mail_normalize(mails(
        {"time": "2024-01-01 00:00:00", "last_working_day": "2024-01-01 12:00:00", "sender": "  A.B@Corp.Example\t",
         "recipients": "x@a.com; y@b.com z@c.com,nobody", "attachments": "b.pdf;a.csv", "subject": " nan "},
        {"time": "not a time", "sender": "nan", "attachments": "0", "recipient_domain": "gmail.com"},
        {"time": "01/02/2024 07:59"})).orderBy("mail_id").collect()
    assert rows[0]["sender"] == "a.b@corp.example" and rows[0]["subject"] == ""
    assert rows[0]["days_from_last_working"] == -1 and rows[0]["is_leaver"]
    assert rows[0]["recipient_count"] == 3 and rows[0]["attachment_types"] == ["csv", "pdf"]
    assert rows[1]["time"] is None and not rows[1]["is_after_hours"] and rows[1]["sender"] == ""
    assert rows[1]["has_attachments"] and rows[1]["recipient_domains"] == ["gmail.com"]
    assert rows[2]["hour"] == 7 and rows[2]["is_after_hours"] and rows[2]["day_of_week"] == 1 and not rows[2]["is_leaver"]


def test_zero_is_no_attachment_for_scores_and_tiers(mails):
    rows = mails({"attachments": "0", "last_working_day": "2024-01-01", "word_list_match": "0", "email_domain": "gmail.com"})
    assert one(rows, R.risk_attachment(), R.risk_content(), R.alert_tier()) == (0, 20, "Low")


def test_timing_counts_only_as_text(mails):
    rows = mails({"time": "2024-01-01 09:00:00 PM"})
    assert one(rows, R.risk_timing("time", rows.schema["time"].dataType)) == 10
    assert one(rows, R.risk_timing("time", None)) == 0


def test_level_vocabularies(spark):
    scores = spark.createDataFrame([(0, 30), (1, 31), (2, 60), (3, 61)], "i int, risk_score int")
    assert column(scores, R.risk_level()) == ["Low Risk", "Medium Risk", "Medium Risk", "High Risk"]
    assert column(scores, R.risk_level("risk_score", V.LEVELS_DAILY))[0] == "Normal"


def test_two_recipient_counts(mails):
    rows = mails({"recipients": "a@x.com b@y.com;c@z.com"})
    assert one(rows, N.recipient_count(), N.comma_recipients()) == (3, 1)


def test_keyword_traps(spark):
    t = texts(spark, "non-disclosure terms", "trade, secret", "Trade  Secret!", "secreté notes", "trade–secret", "the API  key",
              "a pre-launch party", "patient budget", "")
    assert column(t, C.keyword_hits("t")) == [
        [], ["secret"], ["secret", "trade secret"], [], ["secret"], ["api key"], [], ["budget", "healthcare:patient"], []]
    assert column(t, C.clean_for_keywords("t"))[1] == "trade  secret"


def plain_hits(text):
    """The matching rule restated with plain regular expressions."""
    text = " ".join(text.lower().split()).translate(str.maketrans(string.punctuation, " " * len(string.punctuation)))
    found = {k for k in V.SENSITIVE_PHRASES if re.search(r"\b" + re.escape(k) + r"\b", text, re.IGNORECASE)}
    found |= {f"{i}:{w}" for i, ws in V.INDUSTRY_PHRASES.items() for w in ws if re.search(r"\b" + w + r"\b", text, re.IGNORECASE)}
    return sorted(found)


def test_keyword_hits_equal_plain_restatement(spark):
    pieces = ["trade", "secret", "top", "API", "key", "é", "–", ", ", "  ", "\t", "-", "_", "need to know", "account", "number", "x", "."]
    samples = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(st.sampled_from(pieces), max_size=9), st.sampled_from(["", " "]))
    def gather(parts, joiner):
        samples.append(joiner.join(parts))
    gather()
    assert column(texts(spark, *samples), C.keyword_hits("t")) == [plain_hits(s) for s in samples]


def test_patterns(spark):
    t = texts(spark, "ssn 123-45-6789 call 555-123-4567", "4111 1111 1111 1111", "mail a.b@c.org, 10.0.0.1", "é123-45-6789",
              "0123456789abcdef0123456789abcdef", "123456789")
    hits = [r.asDict() for r in column(t, C.pattern_hits("t"))]
    assert hits[0]["ssn"] == 1 and hits[0]["phone"] == 1
    assert hits[1]["credit_card"] == 1 and hits[2]["email"] == 1 and hits[2]["ip_address"] == 1
    assert hits[3]["ssn"] == 0 and hits[4]["api_key"] == 1 and hits[5]["ssn"] == 1


def test_attachment_scores_are_substrings(spark):
    t = texts(spark, "plan.docx", "november.png", "", None, "a.zip.b.c.d")
    assert column(t, C.attachment_content_score("t")) == [10, 3, 0, 0, 18]


def test_finance_words_give_no_bonus(mails):
    from letterwatch.operators.content import detect_keywords
    rows = detect_keywords(mails({"subject": "portfolio"}, {"subject": "patient"})).orderBy("mail_id")
    assert [r["sensitivity_score"] for r in rows.collect()] == [5, 15]


def test_domains(spark):
    t = texts(spark, "trustcare.example", "bank.example", "gmail.com", "x1234567.tk", "10.1.2.3", "my.local", "citi.com", "cityhall.net",
              "agency.gov", "")
    assert column(t, D.domain_industry("t")) == ["banking", "banking", "not_business", "business_other", "business_other",
                                                 "business_other", "banking", "government", "government", "not_business"]
    assert column(t, D.domain_strict_type("t"))[4:6] == ["internal", "internal"]
    assert column(t, D.suspicious_domain("t"))[3]
    t = texts(spark, "a.b@X.Example, <c@y.org>; d@X.example no@bad_host z@-x.com")
    assert column(t, D.recipient_domains("t")) == [["x.example", "y.org"]]


def test_internal_pairs(spark):
    df = spark.createDataFrame([(0, "corp.example", "mail.corp.example"), (1, "gmail.com", "gmail.com"), (2, "co.uk", "x.co.uk"),
                                (3, "test.com", "test.com"), (4, "", "a.com")], "i int, s string, r string")
    assert column(df, D.internal_pair("s", "r")) == [True, False, True, True, False]


def test_whitelist_reason_order_and_both_paths(spark, mails):
    wl = spark.createDataFrame([("me@corp.example", None), (None, "corp.example"), ("q@z.org", "z.org"), (None, "y.org")],
                               "email_address string, domain string")
    rows = mails({"sender": "me@corp.example"}, {"sender": "other@corp.example"}, {"sender": "a@b.c", "recipients": "x@x.org, q@z.org"},
                 {"sender": "a@b.c", "recipients": "m@y.org,q@z.org"}, {"sender": "a@b.c", "recipients": "X@Y.org"}, {"sender": "a@b.c"})
    want = {0: "Sender email 'me@corp.example' is whitelisted", 1: "Sender domain 'corp.example' is whitelisted",
            2: "Recipient email 'q@z.org' is whitelisted", 3: "Recipient domain 'y.org' is whitelisted", 4: None, 5: None}
    for limit in (2000, 0):
        got = {r["mail_id"]: r["whitelist_reason"] for r in W.whitelist_reason(rows, wl, limit).collect()}
        assert got == want
        kept, hit = W.whitelist_filter(rows, wl, limit), W.whitelist_hits(rows, wl, limit)
        assert kept.count() + hit.count() == rows.count()


def test_whitelist_credit_is_optional(spark, mails):
    wl = spark.createDataFrame([(None, "gmail.com")], "email_address string, domain string")
    rows = mails({"sender": "a@gmail.com", "word_list_match": "x"})
    assert one(R.risk_score(rows, wl), "risk_score") == 45
    assert one(R.risk_score(rows, wl, whitelist_credit=True), "risk_score") == 15


def test_credit_is_the_same_for_short_and_long_lists(spark, mails):
    wl = spark.createDataFrame([("boss@z.org", None), (None, "x.com"), (" ", " ")], "email_address string, domain string")
    rows = mails({"sender": "a@x.com@y.com"}, {"sender": "B@X.COM"}, {"sender": " c@x.com "}, {"sender": "boss@z.org"}, {"sender": ""},
                 {"sender": "plain"}).unionByName(mails({"sender": "d@y.com"}).withColumn("sender", F.lit(None).cast("string")))
    ways = [sorted((str(r["sender"]), r["risk_whitelist_credit"]) for r in R.risk_whitelist_credit(rows, wl, limit).collect()) for limit in (2000, 0)]
    assert ways[0] == ways[1] and sum(points for _, points in ways[0]) == 120


def test_long_names_are_whole(mails):
    assert len(one(mails({"sender": "a" * 20_000 + "@x.org"}).select(N.name_from_address().alias("n")), "n")) == 20_000


def test_busy_senders_score(mails):
    rows = mails(*[{"sender": "a@x.org"}] * 11, {"sender": "b@x.org"})
    got = {(r["sender"], r["risk_score"]) for r in R.risk_score(rows).collect()}
    assert got == {("a@x.org", 10), ("b@x.org", 0)}


def test_coverage_falsy_words(mails):
    rows = mails({"tessian": " FALSE ", "mimecast": "1", "tessian_policy": "p"}, {"tessian": "true", "mimecast": "None"})
    got = rows.orderBy("mail_id").select(G.coverage_sources(), G.coverage_policy()).collect()
    assert [tuple(r) for r in got] == [("Missing Tessian", "Both"), ("Missing Mimecast", "No Coverage")]


def timed(spark, rows):
    return spark.createDataFrame(rows, "mail_id long, sender string, t string, recipient_domains array<string>").withColumn(
        "time", F.col("t").cast("timestamp"))


def test_bursts(spark):
    close = [(i, "s", f"2024-01-01 10:{i * 10:02d}:00", ["d", "d"]) for i in range(5)]
    rows = close + [(10 + i, "s", None, ["d"]) for i in range(6)] + [(20, "s", "2024-01-01 12:00:00", ["d"]), (21, "s", "2024-01-01 11:00:00", ["e"]),
                                                                     (22, "s", "2024-01-01 10:20:00", [])]
    got = {r["mail_id"]: r["has_burst_pattern"] for r in H.burst_flag(timed(spark, rows)).collect()}
    assert {k for k, v in got.items() if v} == {0, 1, 2, 3, 4} and len(got) == len(rows)
    wider = {r["mail_id"] for r in H.burst_flag(timed(spark, rows), 120).where("has_burst_pattern").collect()}
    assert wider >= {0, 1, 2, 3, 4}


def test_new_domains_ignore_unknown_senders(spark):
    rows = [(0, "a", "2024-01-01 00:00:00", ["x"]), (1, "a", "2024-03-01 00:00:00", ["x"]), (2, "a", "2024-03-02 00:00:00", ["x", "y"]),
            (3, "b", "2024-03-02 00:00:00", ["y"])]
    got = {r["mail_id"]: r["has_new_domain"] for r in H.new_domains_lookback(timed(spark, rows)).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_first_contact_once_per_pair(mails):
    rows = N.parse_time(mails({"time": "2024-01-02", "sender": "s@x.org", "recipients": "a@d.com,b@D.com"},
                              {"time": "2024-01-01", "sender": "s@x.org", "recipients": "a@d.com"},
                              {"time": None, "sender": "s@x.org", "recipients": "a@gmail.com"}))
    got = {(r["new_domain"], r["mail_id"], r["risk_level"]) for r in H.first_contact(rows).collect()}
    assert got == {("d.com", 1, "Medium"), ("gmail.com", 2, "High")}


def test_late_domains(spark):
    rows = [(i, d, "dep", "unit", f"2024-01-01 00:00:{i:02d}") for i, d in enumerate(["a", "b", "a", "c", "a", "c"])]
    df = spark.createDataFrame(rows, "mail_id long, sender_domain string, department string, bunit string, t string").withColumn(
        "time", F.col("t").cast("timestamp"))
    assert [(r["sender_domain"], r["mails"]) for r in H.late_sender_domains(df).collect()] == [("c", 2)]


def test_names_dates_and_links(spark, mails):
    rows = N.parse_time(mails({"time": "2024-01-03 19:22:00", "sender": "first8.last1@corp.example"}, {"sender": "BOB@x.org"}, {"sender": "x"}))
    got = rows.orderBy("mail_id").select(N.name_from_address(), N.format_mail_date()).collect()
    assert [tuple(r) for r in got] == [("First8 Last1", "January 03, 2024 at 07:22 PM"), ("Bob", "Unknown Date"), ("Colleague", "Unknown Date")]
    from urllib.parse import quote
    cells = ["a b/c~d*e+f", "é&?=%", "line\nbreak", "x@y.z"]
    assert column(texts(spark, *cells), Q.percent_encode("t")) == [quote(c) for c in cells]
    assert column(texts(spark, "abcdef", "abc"), truncate_ellipsis("t", 3)) == ["abc...", "abc"]


def test_template_check(spark):
    df = spark.createDataFrame([(0, "[SENDER_NAME]", "[EMAIL_DATE] [OTHER]"), (1, "x", None)], "i int, subject string, body string")
    rows = Q.template_check(df).orderBy("i").collect()
    assert rows[0]["valid"] and rows[0]["warnings"] == ["Unknown placeholder: [OTHER]"]
    assert not rows[1]["valid"] and len(rows[1]["errors"]) == 2

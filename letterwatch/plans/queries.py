"""The catalogue: one entry per operator, each a function of (spark, folder of tables)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import content as C, domains as D
from ..functions.frames import scratch_dir
from ..functions.text import listed, truncate_ellipsis
from ..operators import (anomaly as A, bau as U, behaviour as H, components, content as K, coverage as G, domains as DO,
                         followup as Q, iforest as I, normalize as N, org as O, risk as R, whitelist as W)
from ..sources import csv as S
from ..sources.mail_log import mail_log, mixed_mail_log, raw_mail_log, whitelist
from . import base as B

QUERIES: dict = {}
AS_OF = "2024-01-31 00:00:00"        # stands in for the clock in reports that look back from "now"


def query(fn):
    QUERIES[fn.__name__.lstrip("_")] = fn
    return fn


def stamp(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def shown(c) -> Column:
    """Whole number as text, null as a dash."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("-"))


def counted(df: DataFrame, **columns) -> DataFrame:
    """Number of rows per combination of derived values: checks every row, returns few."""
    return df.select(*[c.alias(n) for n, c in columns.items()]).groupBy(*columns).agg(F.count(F.lit(1)).alias("mails"))


# ---- sources, validation, sinks ---------------------------------------------

@query
def src_mail_csv(spark, sf):
    path = scratch_dir(spark)
    S.sink_csv(raw_mail_log(spark, sf), path)
    back = S.src_mail_csv(spark, path)
    blank = F.lit("")           # a blank cell is read as missing
    return counted(back, department=F.col("department"), bunit=F.col("bunit"), subject=F.coalesce("subject", blank),
                   attachments=F.coalesce("attachments", blank), has_time=F.col("time").isNotNull())


@query
def src_mail_any(spark, sf):
    """The log in two orders of columns, one of them with rows cut short, and a file without a header, read in one go."""
    path, k = scratch_dir(spark), F.col("mail_id")
    log = raw_mail_log(spark, sf)
    names = [c for c in log.columns if c != "mail_id"]
    S.sink_csv(log.where(k % 2 == 0).select(*names), f"{path}/a")
    S.sink_csv(log.where(k % 2 == 1).select(*names[::-1]), f"{path}/b")
    short = log.where((k % 31 == 0) & (k % 2 == 1)).select(F.lit("only,three,cells").alias("value"))
    header = spark.createDataFrame([(",".join(names[::-1]),)], "value string")
    header.unionByName(short).coalesce(1).write.text(f"{path}/c")
    log.where(k % 37 == 0).select(F.concat_ws(",", "department", "bunit")).write.text(f"{path}/d")
    mails, broken = S.src_mail_any(spark, f"{path}/*")
    def text(c):
        return F.coalesce(c, F.lit(""))
    good = counted(mails, kind=F.lit("mail"), department=F.col("department"), bunit=F.col("bunit"), subject=text("subject"))
    return good.unionByName(counted(broken, kind=F.lit("broken"), department=F.lit(""), bunit=F.lit(""), subject=F.col("reason")))


@query
def validate_required(spark, sf):
    """Missing columns of the tables in the folder, checked by header only, with the rows affected."""
    out = None
    for name in ("events", "documents", "conversations"):
        table = spark.read.parquet(f"{sf}/{name}.parquet")
        row = table.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("source"), F.lit(len(S.missing_columns(table))).alias("missing"), F.col("n").alias("table_rows"))
        out = row if out is None else out.unionByName(row)
    log = S.validate_required(mail_log(spark, sf))
    return out.unionByName(log.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("mail_log").alias("source"), F.lit(0).alias("missing"), F.col("n").alias("table_rows")))


def _derived_whitelist(spark, sf) -> DataFrame:
    """A whitelist as long as the data: external-looking senders by address, their domains by name."""
    log = mail_log(spark, sf)
    people = log.where(F.col("sender_domain") == "eu.corp.example").select(
        F.col("sender").alias("email_address"), F.lit(None).cast("string").alias("domain")).distinct()
    domains = log.where(F.col("recipient_domain").endswith(".org")).select(
        F.lit(None).cast("string").alias("email_address"), F.col("recipient_domain").alias("domain")).distinct()
    return people.unionByName(domains)


@query
def src_whitelist_csv(spark, sf):
    path = scratch_dir(spark)
    S.sink_csv(_derived_whitelist(spark, sf), path)
    return S.src_whitelist_csv(spark, path)


@query
def whitelist_append(spark, sf):
    return W.whitelist_append(whitelist(spark), _derived_whitelist(spark, sf), dedupe=True)


@query
def sink_csv(spark, sf):
    """Write the whitelisted mails as CSV and read them back."""
    path = scratch_dir(spark)
    S.sink_csv(B.hits(spark, sf).withColumn("time", stamp("time")), path)
    back = spark.read.options(**S.CSV_OPTIONS).schema("mail_id long, time string, sender string, recipients string, "
                                                      "subject string, department string, business_unit string, "
                                                      "whitelist_reason string, attachments string, "
                                                      "word_list_match string").csv(path)
    def text(c):
        return F.coalesce(c, F.lit("")).alias(c)            # a blank cell is read as missing
    return back.select("mail_id", "time", text("sender"), text("recipients"), text("subject"), "department", "business_unit", "whitelist_reason",
                       text("attachments"), text("word_list_match"))


@query
def preview_head(spark, sf):
    return S.preview_head(mail_log(spark, sf), 10, "mail_id").select("mail_id", "sender", "recipients", "subject")


# ---- normalisation ----------------------------------------------------------

@query
def mail_normalize(spark, sf):
    return N.mail_normalize(raw_mail_log(spark, sf)).select(
        "mail_id", stamp("time").alias("time"), "sender", "recipients", "subject", "word_list_match", "attachments",
        *[shown(c).alias(c) for c in ("hour", "day_of_week", "days_from_last_working")],
        "is_after_hours", "is_leaver", "has_attachments",
        listed("attachment_types").alias("attachment_types"), "recipient_count",
        listed("recipient_domains").alias("recipient_domains"))


@query
def parse_time(spark, sf):
    return N.parse_time(raw_mail_log(spark, sf)).select(
        "mail_id", stamp("time").alias("time"), stamp("last_working_day").alias("last_working_day"))


@query
def parse_time_voted(spark, sf):
    """Times of five files, each with formats and an order of its own, read in the order that each file's values settle."""
    return N.parse_time(mixed_mail_log(spark, sf), file="file", vote=True).select(
        "mail_id", stamp("time").alias("time"), stamp("last_working_day").alias("last_working_day"))


@query
def date_votes(spark, sf):
    return N.vote_dates(mixed_mail_log(spark, sf), file="file")


@query
def date_failures(spark, sf):
    return N.failed_dates(mixed_mail_log(spark, sf), file="file")


@query
def clean_text(spark, sf):
    return N.clean_text(raw_mail_log(spark, sf)).select("mail_id", "sender", "recipients", "subject", "word_list_match",
                                                        "attachments")


@query
def hour_dow(spark, sf):
    return counted(N.hour_dow(B.normalized(spark, sf)), hour=shown("hour"), day_of_week=shown("day_of_week"))


@query
def after_hours_flag(spark, sf):
    timed = N.hour_dow(N.parse_time(raw_mail_log(spark, sf)))
    return counted(timed, hour=shown("hour"), day_of_week=shown("day_of_week"), is_after_hours=N.after_hours())


@query
def leaver_flag(spark, sf):
    return counted(B.normalized(spark, sf), days=shown(N.day_gap()), is_leaver=N.leaver(N.day_gap()))


@query
def attachment_flag(spark, sf):
    raw = raw_mail_log(spark, sf)
    return counted(raw, attachments=F.col("attachments"), has_attachments=N.filled("attachments"))


@query
def attachment_types(spark, sf):
    return counted(B.normalized(spark, sf), attachments=F.col("attachments"), types=listed(N.attachment_types()))


@query
def recipient_count(spark, sf):
    return B.normalized(spark, sf).select("mail_id", N.recipient_count().alias("recipient_count"))


@query
def recipient_domains_simple(spark, sf):
    return B.normalized(spark, sf).select("mail_id", listed(N.recipient_domains_simple()).alias("domains"))


@query
def recipient_domain_wrap(spark, sf):
    return B.normalized(spark, sf).select("mail_id", listed(N.recipient_domain_wrap()).alias("domains"))


@query
def word_match_score(spark, sf):
    return counted(B.normalized(spark, sf), word_list_match=F.col("word_list_match"), score=C.word_match_score("word_list_match"))


@query
def attachment_count_bau(spark, sf):
    return counted(B.normalized(spark, sf), attachments=F.col("attachments"), files=N.attachment_count())


@query
def name_from_address(spark, sf):
    return B.normalized(spark, sf).select("mail_id", N.name_from_address().alias("name"))


@query
def format_mail_date(spark, sf):
    return N.parse_time(raw_mail_log(spark, sf)).select("mail_id", N.format_mail_date().alias("mail_date"))


@query
def truncate_ellipsis_(spark, sf):
    return mail_log(spark, sf).select("mail_id", truncate_ellipsis("recipients", 35).alias("short_recipients"),
                                      truncate_ellipsis("subject", 20, always=True).alias("short_subject"))


QUERIES["truncate_ellipsis"] = QUERIES.pop("truncate_ellipsis_")


# ---- domain classification --------------------------------------------------

@query
def domain_extract(spark, sf):
    return raw_mail_log(spark, sf).select("mail_id", D.domain_extract("sender").alias("domain"))


@query
def first_recipient_domain(spark, sf):
    return B.normalized(spark, sf).select("mail_id", D.first_recipient_domain("recipients").alias("domain"))


@query
def recipient_domains(spark, sf):
    return B.normalized(spark, sf).select("mail_id", listed(D.recipient_domains("recipients")).alias("domains"))


def _hosts(spark, sf) -> DataFrame:
    """Sender and recipient domains of every mail, with some twisted forms of them."""
    log, k = B.normalized(spark, sf), F.col("mail_id")
    odd = (F.when(k % 7 == 0, F.concat(F.lit("a.b."), "sender_domain"))
           .when(k % 7 == 1, F.concat("recipient_domain", F.lit(".local")))
           .when(k % 7 == 2, F.concat(F.lit("10."), k % 3, F.lit(".0.1"))).when(k % 7 == 3, F.lit("localhost"))
           .when(k % 7 == 4, F.concat(F.lit("-"), "recipient_domain")).when(k % 7 == 5, F.concat(F.lit("test"), "sender_domain"))
           .otherwise(F.lit("x")))
    return log.select("mail_id", F.explode(F.array("sender_domain", "recipient_domain", odd)).alias("d"))


@query
def domain_valid(spark, sf):
    return counted(_hosts(spark, sf), d=F.col("d"), valid=D.domain_valid("d"))


@query
def root_domain(spark, sf):
    return counted(_hosts(spark, sf), d=F.col("d"), root=D.root_domain("d"))


@query
def internal_infra_domain(spark, sf):
    return counted(_hosts(spark, sf), d=F.col("d"), infra=D.infra_domain("d"))


@query
def business_domain(spark, sf):
    return counted(_hosts(spark, sf), d=F.col("d"), business=D.business_domain("d"))


def _pairs(spark, sf) -> DataFrame:
    return B.normalized(spark, sf).select(F.col("sender_domain").alias("s"), F.col("recipient_domain").alias("r"))


@query
def same_organization(spark, sf):
    return counted(_pairs(spark, sf), s=F.col("s"), r=F.col("r"), same=D.same_organization("s", "r"))


@query
def internal_pair(spark, sf):
    return counted(_pairs(spark, sf), s=F.col("s"), r=F.col("r"), internal=D.internal_pair("s", "r"))


@query
def sender_domain_type(spark, sf):
    return counted(_pairs(spark, sf), s=F.col("s"), r=F.col("r"), kind=D.sender_domain_type("s", "r"))


@query
def domain_strict_type(spark, sf):
    return counted(_hosts(spark, sf), d=F.col("d"), kind=D.domain_strict_type("d"))


@query
def domain_category(spark, sf):
    return counted(_hosts(spark, sf), d=F.col("d"), category=D.domain_category("d"))


@query
def domain_industry(spark, sf):
    return counted(_hosts(spark, sf), d=F.col("d"), industry=D.domain_industry("d"))


@query
def recipient_domain_types(spark, sf):
    base = B.normalized(spark, sf).withColumn("r", D.recipient_domains("recipients"))
    return base.select("mail_id", listed(D.recipient_domain_types("r")).alias("types"))


@query
def external_recipient_count(spark, sf):
    base = B.normalized(spark, sf).withColumn("r", D.recipient_domains("recipients"))
    return base.select("mail_id", D.external_recipient_count("sender_domain", "r").alias("external"))


@query
def internal_flag(spark, sf):
    base = B.normalized(spark, sf).withColumn("r", D.recipient_domains("recipients"))
    return base.select("mail_id", D.internal_flag("sender_domain", "r").alias("internal"))


@query
def classify_domains(spark, sf):
    return B.classified(spark, sf).select(
        "mail_id", "email_domain_type", "email_domain_category", "email_domain_industry", "external_recipient_count",
        "is_internal_communication", "sender_domain_category", listed("recipient_domains").alias("recipient_domains"),
        listed("recipient_domain_types").alias("recipient_domain_types"))


@query
def suspicious_domain(spark, sf):
    return counted(_hosts(spark, sf), d=F.col("d"), suspicious=D.suspicious_domain("d"),
                   reasons=listed(D.suspicion_reasons("d"), "; "))


@query
def external_risk_level(spark, sf):
    return counted(_pairs(spark, sf), s=F.col("s"), r=F.col("r"), risk=D.external_risk_level("s", "r"))


@query
def domain_class_summary(spark, sf):
    return DO.domain_class_summary(B.classified(spark, sf))


@query
def anomalous_domains(spark, sf):
    return DO.anomalous_domains(mail_log(spark, sf).withColumn("sender_domain", F.col("recipient_domain")), 0.08)


@query
def domain_report(spark, sf):
    return DO.domain_report(mail_log(spark, sf).withColumn("sender_domain", F.col("recipient_domain")))


@query
def sender_domain_stats(spark, sf):
    return DO.sender_domain_stats(B.normalized(spark, sf))


@query
def recipient_domain_stats(spark, sf):
    return DO.recipient_domain_stats(B.normalized(spark, sf))


@query
def comm_pairs(spark, sf):
    return DO.comm_pairs(B.normalized(spark, sf)).select("mail_id", "subject", "sender_domain", "recipient_domain",
                                                         "direction", "risk_level")


@query
def industry_breakdown(spark, sf):
    return DO.industry_breakdown(B.normalized(spark, sf))


@query
def domain_risk_summary(spark, sf):
    return DO.domain_risk_summary(B.normalized(spark, sf))


@query
def domain_type_volume(spark, sf):
    return DO.domain_type_volume(B.normalized(spark, sf))


# ---- content ----------------------------------------------------------------

@query
def mail_text(spark, sf):
    return B.normalized(spark, sf).select("mail_id", C.mail_text().alias("text"))


def _texts(spark, sf) -> DataFrame:
    """Subjects, word lists and file names of the mails, plus whole conversation turns."""
    talk = spark.read.parquet(f"{sf}/conversations.parquet")
    return B.normalized(spark, sf).select(F.concat(F.lit("mail "), "mail_id").alias("ref"), C.mail_text().alias("text")).unionByName(
        talk.select(F.concat_ws(" ", F.lit("talk"), "conv_id", "turn").alias("ref"), F.lower("text").alias("text")))


@query
def clean_for_keywords(spark, sf):
    return B.normalized(spark, sf).select("mail_id", C.clean_for_keywords(C.mail_text()).alias("text"))


@query
def keyword_hits(spark, sf):
    return _texts(spark, sf).select("ref", listed(C.keyword_hits("text")).alias("hits"))


@query
def keyword_category(spark, sf):
    hits = _texts(spark, sf).select(F.explode(C.keyword_hits("text")).alias("keyword"))
    return counted(hits, keyword=F.col("keyword"), category=C.keyword_category("keyword"))


@query
def pattern_hits(spark, sf):
    return B.normalized(spark, sf).select("mail_id", C.pattern_hits(C.mail_text()).alias("p")).select("mail_id", "p.*")


@query
def pattern_hits_documents(spark, sf):
    """The same patterns over whole documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", C.pattern_hits(F.lower("text")).alias("p")).select("doc_id", "p.*")


@query
def keyword_hits_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", listed(C.keyword_hits(F.lower("text"))).alias("hits"))


@query
def attachment_content_score(spark, sf):
    return counted(B.normalized(spark, sf), attachments=F.col("attachments"), score=C.attachment_content_score("attachments"),
                   factors=listed(C.attachment_factors("attachments")))


@query
def sensitivity_score(spark, sf):
    return B.scanned(spark, sf).select("mail_id", "sensitivity_score")


@query
def detect_keywords(spark, sf):
    return B.scanned(spark, sf).select("mail_id", "has_ip_keywords", "ip_keyword_count", "detected_keywords",
                                       "sensitive_patterns_found", "sensitivity_score")


@query
def keyword_stats(spark, sf):
    return K.keyword_stats(B.scanned(spark, sf))


@query
def high_risk_content(spark, sf):
    return K.high_risk_content(B.scanned(spark, sf).select("mail_id", "sensitivity_score")).select("mail_id", "sensitivity_score", "content_risk_level")


@query
def keyword_report(spark, sf):
    return K.keyword_report(B.scanned(spark, sf))


@query
def keyword_export(spark, sf):
    return K.keyword_export(B.scanned(spark, sf)).withColumn("time", stamp("time"))


@query
def keyword_dim_edit(spark, sf):
    """Custom keywords taken from the log: word-list entries are added, subject words removed."""
    log = mail_log(spark, sf)
    added = log.select(F.explode(F.split("word_list_match", ", ")).alias("keyword")).where("keyword NOT IN ('', '0')").distinct()
    removed = log.select(F.explode(F.split("subject", " ")).alias("keyword")).distinct()
    return K.keyword_dim_edit(K.keyword_dim(spark), added, removed)


@query
def word_frequencies(spark, sf):
    return K.word_frequencies(B.page(spark, sf))


@query
def word_freq_bands(spark, sf):
    return K.word_freq_bands(B.page(spark, sf))


@query
def word_categories(spark, sf):
    return K.word_categories(mail_log(spark, sf).withColumn("word_list_match", F.concat_ws(";", "word_list_match", "subject")))


@query
def word_breakdown(spark, sf):
    return K.word_breakdown(B.page(spark, sf), "confidential")


@query
def common_subject_words(spark, sf):
    return K.common_subject_words(B.normalized(spark, sf))


# ---- whitelist --------------------------------------------------------------

@query
def whitelist_filter(spark, sf):
    return B.kept(spark, sf).select("mail_id", "sender", "recipients")


@query
def whitelist_hits(spark, sf):
    return B.hits(spark, sf).select("mail_id", "sender", "whitelist_reason")


@query
def whitelist_totals(spark, sf):
    return W.whitelist_totals(B.normalized(spark, sf), whitelist(spark))


@query
def whitelist_reason_counts(spark, sf):
    return W.whitelist_reason_counts(B.hits(spark, sf))


@query
def whitelist_daily(spark, sf):
    return W.whitelist_daily(B.hits(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query
def whitelist_domain_counts(spark, sf):
    return W.whitelist_domain_counts(B.hits(spark, sf))


@query
def whitelist_review(spark, sf):
    return W.whitelist_review(B.hits(spark, sf), AS_OF)


# ---- risk -------------------------------------------------------------------

def _part(name, column):
    def run(spark, sf):
        return B.normalized(spark, sf).select("mail_id", column().alias("points"))
    QUERIES[name] = run


_part("risk_domain", R.risk_domain)
_part("risk_content", R.risk_content)
_part("risk_attachment", R.risk_attachment)
_part("risk_recipients", R.risk_recipients)
_part("risk_leaver", R.risk_leaver)


@query
def risk_timing(spark, sf):
    raw = mail_log(spark, sf).withColumn("time", F.date_format("time", "yyyy-MM-dd hh:mm:ss a"))
    return raw.select("mail_id", R.risk_timing("time", raw.schema["time"].dataType).alias("points"))


@query
def risk_volume(spark, sf):
    return R.risk_volume(B.normalized(spark, sf)).select("mail_id", F.col("risk_volume").alias("points"))


@query
def risk_whitelist_credit(spark, sf):
    return R.risk_whitelist_credit(B.normalized(spark, sf), whitelist(spark)).select(
        "mail_id", F.col("risk_whitelist_credit").alias("points"))


@query
def risk_score(spark, sf):
    return R.risk_score(B.normalized(spark, sf)).select("mail_id", "risk_score")


@query
def risk_score_credited(spark, sf):
    return R.risk_score(B.normalized(spark, sf), whitelist(spark), whitelist_credit=True).select("mail_id", "risk_score")


@query
def risk_level(spark, sf):
    return counted(R.risk_score(B.normalized(spark, sf)), risk_score=F.col("risk_score"), engine=R.risk_level(),
                   daily=R.risk_level("risk_score", R.V.LEVELS_DAILY), short=R.risk_level("risk_score", R.V.LEVELS_SHORT))


@query
def risk_summary(spark, sf):
    return R.risk_summary(R.risk_score(B.normalized(spark, sf)))


@query
def risk_attach_filtered(spark, sf):
    return R.risk_attach_filtered(B.normalized(spark, sf), whitelist(spark)).select("mail_id", "risk_score", "risk_level")


@query
def alert_tier(spark, sf):
    return B.normalized(spark, sf).select("mail_id", R.alert_tier().alias("tier"))


def _daily(spark, sf) -> DataFrame:
    return R.risk_attach_filtered(B.normalized(spark, sf), whitelist(spark), R.V.LEVELS_DAILY)


@query
def tier_kpis(spark, sf):
    return R.tier_kpis(_daily(spark, sf))


@query
def tier_views(spark, sf):
    return R.tier_views(_daily(spark, sf)).select("mail_id", "tier", "is_leaver_first", "risk_score", "risk_level",
                                                  stamp("time").alias("time"))


@query
def risk_factor_means(spark, sf):
    return R.risk_factor_means(B.page(spark, sf))


@query
def risk_distribution(spark, sf):
    return R.risk_distribution(_daily(spark, sf))


@query
def high_risk_list(spark, sf):
    return R.high_risk_list(B.page(spark, sf)).select("mail_id", "sender", "risk_score", "risk_factors")


@query
def high_risk_kpis(spark, sf):
    return R.high_risk_kpis(B.page(spark, sf))


# ---- coverage ---------------------------------------------------------------

@query
def coverage_sources(spark, sf):
    return counted(B.normalized(spark, sf), tessian=F.col("tessian"), mimecast=F.col("mimecast"), coverage=G.coverage_sources())


@query
def coverage_policy(spark, sf):
    return counted(B.normalized(spark, sf), tessian_policy=F.col("tessian_policy"), mimecast=F.col("mimecast"),
                   coverage=G.coverage_policy())


@query
def coverage_counts(spark, sf):
    return G.coverage_counts(B.normalized(spark, sf))


@query
def coverage_domains(spark, sf):
    return G.coverage_domains(B.normalized(spark, sf))


@query
def coverage_advice(spark, sf):
    return G.coverage_advice(B.normalized(spark, sf))


# ---- behaviour --------------------------------------------------------------

@query
def volume_baseline(spark, sf):
    return H.volume_baseline(B.normalized(spark, sf)).select(
        "sender", *[F.round(c, 4).alias(c) for c in ("avg_daily", "std_daily", "median_daily")], "max_daily")


@query
def volume_spikes(spark, sf):
    log = B.normalized(spark, sf)
    return H.volume_spikes(log, H.volume_baseline(log)).select(
        "sender", F.col("day").cast("string").alias("day"), "mails", F.round("volume_zscore", 4).alias("volume_zscore"),
        "is_volume_spike")


@query
def new_domains_lookback(spark, sf):
    return H.new_domains_lookback(B.classified(spark, sf), 10).select("mail_id", "has_new_domain")


@query
def burst_flag(spark, sf):
    return H.burst_flag(B.classified(spark, sf))


def _contacts(spark, sf) -> DataFrame:
    return H.first_contact(B.kept(spark, sf))


@query
def first_contact(spark, sf):
    return _contacts(spark, sf).withColumn("time", stamp("time"))


@query
def first_contact_kpis(spark, sf):
    return H.first_contact_kpis(_contacts(spark, sf))


@query
def first_contact_filter(spark, sf):
    return H.first_contact_filter(_contacts(spark, sf), "High", "IT", "Yahoo Email Services").select("sender", "new_domain", "mail_id")


@query
def first_contact_rollups(spark, sf):
    return H.first_contact_rollups(_contacts(spark, sf))


@query
def first_contact_top_domains(spark, sf):
    return H.first_contact_top_domains(_contacts(spark, sf))


@query
def late_sender_domains(spark, sf):
    """Every sender gets its own host, so that many domains begin late."""
    log = B.normalized(spark, sf)
    return H.late_sender_domains(log.withColumn("sender_domain", F.concat(
        F.substring_index("sender", "@", 1), F.lit("."), F.date_format("time", "yyyyMMdd"))))


@query
def daily_volume(spark, sf):
    return H.daily_volume(B.normalized(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query
def volume_ma7(spark, sf):
    return H.volume_ma7(B.normalized(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query
def timeline(spark, sf):
    return H.timeline(B.page(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query
def hourly_activity(spark, sf):
    return H.hourly_activity(B.normalized(spark, sf))


@query
def mail_graph_edges(spark, sf):
    return H.mail_graph_edges(B.classified(spark, sf))


@query
def mail_graph_top(spark, sf):
    return H.mail_graph_top(B.classified(spark, sf))


@query
def mail_graph_top_edges(spark, sf):
    return H.mail_graph_top_edges(B.classified(spark, sf))


# ---- anomalies --------------------------------------------------------------

@query
def anomaly_features(spark, sf):
    mails = B.classified(spark, sf)
    flagged = (mails.join(H.burst_flag(mails), "mail_id")
               .join(H.new_domains_lookback(mails, 10).select("mail_id", "has_new_domain"), "mail_id", "left"))
    return A.anomaly_features(flagged)


@query
def iforest_detect(spark, sf):
    return I.iforest_detect(B.classified(spark, sf)).withColumn("anomaly_score", F.round("anomaly_score", 6))


@query
def iforest_score100(spark, sf):
    return I.iforest_score100(I.iforest_detect(B.classified(spark, sf))).withColumn("score100", F.round("score100", 4))


@query
def iforest_reasons(spark, sf):
    rows = B.page(spark, sf)
    needed = rows.select(*[c for c in dict.fromkeys(A.FEATURE_INPUTS + A.REASON_INPUTS) if c in rows.columns])
    return I.iforest_explained(needed).select("mail_id", F.round("anomaly_score", 6).alias("anomaly_score"), "anomaly_reasons")


@query
def anomaly_reasons(spark, sf):
    return A.anomaly_reasons(B.ruled(spark, sf)).select("mail_id", "anomaly_reasons")


@query
def anomaly_reason_map(spark, sf):
    return A.anomaly_reason_map(B.ruled(spark, sf))


def _rules(name, column):
    def run(spark, sf):
        return A.sender_anomalies(B.normalized(spark, sf)).select("mail_id", F.col(column).alias("flag"))
    QUERIES[name] = run


_rules("sender_anomalies", "is_behavioral_anomaly")
_rules("sender_time_anomaly", "time_anomaly")
_rules("sender_volume_anomaly", "volume_anomaly")
_rules("sender_content_anomaly", "content_anomaly")


@query
def anomaly_clusters(spark, sf):
    rows = B.classified(spark, sf)
    return components.anomaly_clusters(I.with_anomalies(rows.select(*[c for c in A.FEATURE_INPUTS if c in rows.columns])).where("is_anomaly"))


@query
def anomaly_patterns(spark, sf):
    return A.anomaly_patterns(B.ruled(spark, sf))


@query
def anomaly_triage(spark, sf):
    return A.anomaly_triage(B.ruled(spark, sf))


@query
def anomaly_kpis(spark, sf):
    return A.anomaly_kpis(A.anomaly_triage(B.ruled(spark, sf)))


@query
def anomaly_actions(spark, sf):
    return A.anomaly_actions(B.ruled(spark, sf)).withColumn("timing", F.coalesce("timing", F.lit("-")))


# ---- business as usual ------------------------------------------------------

@query
def bau_scope(spark, sf):
    return B.low_risk(spark, sf).select("mail_id", shown("hour").alias("hour"), shown("day_of_week").alias("day_of_week"), "is_business_hours")


for _name in ("bau_temporal", "bau_senders", "bau_subjects", "bau_domains", "bau_off_hours", "bau_anomalies",
              "banking_overview", "banking_compliance", "bau_recommendations"):
    def _run(spark, sf, _fn=getattr(U, _name)):
        return _fn(B.low_risk(spark, sf))
    QUERIES[_name] = _run


@query
def banking_compliance(spark, sf):
    return U.banking_compliance(B.low_risk(spark, sf), "corp")


@query
def bau_volume_days(spark, sf):
    return U.bau_volume_days(B.low_risk(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query
def bau_attachment_outliers(spark, sf):
    return U.bau_attachment_outliers(B.low_risk(spark, sf), 0.75)


@query
def banking_mails(spark, sf):
    return U.banking_mails(B.low_risk(spark, sf)).select("mail_id", "subject")


@query
def hidden_ip_risks(spark, sf):
    return U.hidden_ip_risks(U.bau_scope(B.page(spark, sf), scope="all")).drop("time")


# ---- organisation -----------------------------------------------------------

for _base, _names in ((B.page, ("unit_activity", "unit_overview", "dept_risk_matrix", "dept_keywords", "unit_risk_matrix", "cross_dept_kpis",
                                "dept_direction", "dept_content", "dept_flags", "dept_insights", "domain_dept_unit_stats", "report_executive",
                                "report_score_describe")),
                      (B.unscored, ("unit_departments", "unit_concentration", "unit_word_leader", "dept_external", "dept_volumes", "dept_anomalies",
                                    "dept_sizes", "dept_hour_matrix", "domain_totals", "report_top_domains"))):
    for _name in _names:
        def _run(spark, sf, _fn=getattr(O, _name), _rows=_base):
            return _fn(_rows(spark, sf))
        QUERIES[_name] = _run


@query
def org_kpis(spark, sf):
    return O.org_kpis(B.ruled(spark, sf, "department", "bunit", "risk_level", "sender_domain_category"), "department", "bunit")


@query
def unit_anomalies(spark, sf):
    return O.unit_anomalies(B.ruled(spark, sf, "bunit"))


@query
def dept_anomaly_kpis(spark, sf):
    return O.dept_anomaly_kpis(O.dept_anomalies(B.unscored(spark, sf)))


@query
def policy_recommendations(spark, sf):
    return O.policy_recommendations(B.ruled(spark, sf))


@query
def report_coverage(spark, sf):
    return O.report_coverage(B.page(spark, sf).withColumn("security_coverage", G.coverage_policy()))


@query
def quick_stats(spark, sf):
    return R.quick_stats(B.scored(spark, sf), whitelist(spark))


# ---- follow-up --------------------------------------------------------------

def _selection(spark, sf) -> DataFrame:
    return Q.followup_select(B.page(spark, sf), ("High", "Medium"), ("IT", "Sales", "Engineering"))


def _kind() -> Column:
    k = F.col("mail_id") % 4
    return (F.when(k == 0, "Security Inquiry").when(k == 1, "Data Classification Review").when(k == 2, "Policy Reminder")
            .otherwise("Something else"))


def _rendered(spark, sf) -> DataFrame:
    return Q.followup_render(_selection(spark, sf), _kind(), AS_OF)


@query
def followup_select(spark, sf):
    return _selection(spark, sf).select("mail_id", "sender", "subject", "recipients", "risk_level", "department")


@query
def followup_queue(spark, sf):
    rows = B.page(spark, sf)
    first = Q.followup_queue(Q.followup_select(rows, ("High",)), AS_OF)
    both = Q.followup_queue(Q.followup_select(rows, ("Medium",), ("IT",)), AS_OF, first)
    same_id = F.count(F.lit(1)).over(Window.partitionBy("selection_id"))
    return both.select("mail_id", "risk_level", (F.col("selection_id").startswith("evt_") & (same_id == 1)).alias("has_id"),
                       stamp("selected_at").alias("selected_at"))


@query
def followup_reasons(spark, sf):
    rows = _selection(spark, sf)
    return rows.select("mail_id", Q.followup_reasons(rows).alias("reasons"))


@query
def followup_render(spark, sf):
    return _rendered(spark, sf).select("mail_id", "recipient", "subject", "body", "template_type")


@query
def followup_mailto(spark, sf):
    return _rendered(spark, sf).select("mail_id", Q.followup_mailto().alias("link"))


@query
def followup_summary(spark, sf):
    return Q.followup_summary(_rendered(spark, sf))


@query
def followup_export(spark, sf):
    return Q.followup_export(_rendered(spark, sf)).withColumn("generated_at", stamp("generated_at"))


@query
def template_check(spark, sf):
    """Documents used as mail bodies, some with placeholders added."""
    docs, k = spark.read.parquet(f"{sf}/documents.parquet"), F.col("doc_id")
    drafts = docs.select("doc_id", F.when(k % 2 == 0, "Notice for [SENDER_NAME]").otherwise("Notice [TICKET_ID]").alias("subject"),
                         F.concat("text", F.when(k % 3 == 0, " sent [EMAIL_DATE] to [RECIPIENTS]").otherwise("")).alias("body"))
    return Q.template_check(drafts).select("doc_id", "valid", listed("errors", "; ").alias("errors"),
                                           listed("warnings", "; ").alias("warnings"),
                                           listed("placeholders_found").alias("placeholders_found"))


@query
def followup_status(spark, sf):
    mails = _rendered(spark, sf)
    done = mails.withColumn("status", F.when(F.col("mail_id") % 3 == 0, "Sent").when(F.col("mail_id") % 3 == 1, "Responded")
                            .otherwise(F.col("status")))
    return Q.followup_status(done).withColumn("stage", F.lit("mixed")).unionByName(
        Q.followup_status(Q.mark_all_sent(done, AS_OF)).withColumn("stage", F.lit("all sent")))

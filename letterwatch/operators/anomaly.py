"""Anomaly features, explanations, per-sender rules and triage views."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab as V
from ..functions.frames import materialize, spread_join
from ..functions.text import blank_if_null, compact_labels, contains_any, filled, words_in
from .coverage import coverage_policy
from .risk import risk_level

DOMAIN_TYPES = ("business", "free", "internal", "unknown")


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("int"), F.lit(0)) if name in df.columns else F.lit(0)


def feature_names(domain_types=DOMAIN_TYPES) -> list[str]:
    return (["hour", "day_of_week", "is_weekend", "recipient_count", "has_attachments", "is_after_hours", "is_leaver",
             "has_new_domain", "has_burst_pattern"] + [f"domain_{t}" for t in domain_types]
            + ["dept_frequency", "sender_frequency"])


# What the features are made of; a frame may lack the flags.
FEATURE_INPUTS = ("mail_id", "sender", "department", "hour", "day_of_week", "recipient_count", "has_attachments", "is_after_hours", "is_leaver",
                  "has_new_domain", "has_burst_pattern", "email_domain_type")


# What the explanations are made of, beside the flag and the features.
REASON_INPUTS = ("mail_id", "time", "sender", "sender_domain", "recipient_count", "recipient_domains", "attachment_types", "attachments",
                 "word_list_match", "email_domain", "risk_score")


def with_features(df: DataFrame, domain_type_col: str = "email_domain_type", domain_types=DOMAIN_TYPES) -> DataFrame:
    """Add ``_features``, a struct of numbers (long), nulls as 0.

    Two scans: mails are counted by department and by sender in one aggregation over both grouping sets, and the counts are joined
    back with hot keys split; no window holds a sender's mails.
    """
    counts = materialize(df.groupingSets([["department"], ["sender"]], "department", "sender").agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("_mails")))
    def per(key, which, name):
        return counts.where(F.col("_set") == which).select(key, F.col("_mails").alias(name))
    def joined_by(rows, key, which, name):
        return spread_join(rows, per(key, which, name).where(F.col(key).isNotNull()), key, written=True, counts=per(key, which, "_rows"))
    joined = joined_by(joined_by(df, "department", 1, "_dept_frequency"), "sender", 2, "_sender_frequency")
    def number(c):
        return F.coalesce(F.col(c).cast("int"), F.lit(0))
    values = {"hour": number("hour"), "day_of_week": number("day_of_week"), "is_weekend": F.coalesce((F.col("day_of_week") >= 5).cast("int"), F.lit(0)),
              **{c: _flag(df, c) for c in ("recipient_count", "has_attachments", "is_after_hours", "is_leaver", "has_new_domain", "has_burst_pattern")},
              **{f"domain_{t}": F.coalesce((F.col(domain_type_col) == t).cast("int"), F.lit(0)) for t in domain_types},
              "dept_frequency": F.coalesce("_dept_frequency", F.lit(0)), "sender_frequency": F.coalesce("_sender_frequency", F.lit(0))}
    struct = F.struct(*[values[c].cast("long").alias(c) for c in feature_names(domain_types)])
    return joined.withColumn("_features", struct).drop("_dept_frequency", "_sender_frequency")


def anomaly_features(df: DataFrame, domain_type_col: str = "email_domain_type", domain_types=DOMAIN_TYPES) -> DataFrame:
    """(mail_id, features): the numeric feature columns per mail (see ``with_features``)."""
    return with_features(df, domain_type_col, domain_types).select("mail_id", "_features.*")


def one_decimal(c: Column) -> Column:
    return F.call_function("format_number", c.cast("double"), F.lit("0.0"))


def external_domains() -> Column:
    return F.array_join(F.filter("recipient_domains", lambda d: F.lower(d) != F.lower(F.col("sender_domain"))), ", ")


def anomaly_reasons(df: DataFrame, flagged_only: bool = False) -> DataFrame:
    """Add ``anomaly_reasons``: the first four of eight explanations, separated by bars."""
    stats = df.groupBy("sender").agg(F.avg("recipient_count").alias("_mean"), F.count(F.lit(1)).alias("_n"))
    rows = df.where("is_anomaly") if flagged_only else df
    joined = spread_join(rows, stats, "sender")
    types = F.lower(F.array_join("attachment_types", ","))
    words, files = blank_if_null("word_list_match"), F.lower(blank_if_null("attachments"))
    outside = external_domains()
    def text(*parts):
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    reasons = compact_labels(
        (filled("sender") & (F.col("recipient_count") > F.col("_mean") * 2),
         text("Unusual recipient volume: ", F.col("recipient_count").cast("string"), " recipients (typical: ",
              one_decimal(F.col("_mean")), ")")),
        ((F.hour("time") < 6) | (F.hour("time") > 22),
         text("Sent at unusual time: ", F.date_format("time", "HH:mm"), " (outside business hours)")),
        (contains_any(types, V.RISKY_FILE_TYPES),
         text("Contains potentially risky file types: ", F.array_join(words_in(types, V.RISKY_FILE_TYPES), ", "))),
        (contains_any("email_domain", ["gmail.com", "yahoo.com", "hotmail.com"]),
         "Uses free email domain for business communication"),
        (~F.lower(words).isin("", "0", "nan"), text("Contains sensitive keywords: ", words)),
        (F.col("risk_score") > 70, text("High risk score: ", one_decimal(F.col("risk_score")), "/100")),
        (~outside.isin("", "0"), text("Communication with external domains: ", outside)),
        (contains_any(files, ["large", "mb"]), "Contains large attachments"))
    found = F.array_join(F.slice(reasons, 1, 4), " | ")
    return joined.withColumn("anomaly_reasons", F.when(
        found == "", "Detected as statistical outlier based on behavioral patterns").otherwise(found)).drop("_mean", "_n")


def anomaly_reason_map(df: DataFrame) -> DataFrame:
    return anomaly_reasons(df, flagged_only=True).select("mail_id", "anomaly_reasons")


def sender_anomalies(df: DataFrame, min_mails: int = 5) -> DataFrame:
    """Add the three per-sender rules and their disjunction; the mails keep all their columns, so nothing is joined back.

    All statistics come from one table of counts per sender, day and hour; sums of squares give the
    deviations, so a sender's mails are never gathered.
    """
    rows = df.withColumns({"_day": F.to_date("time"), "_hour": F.hour("time")})
    rc = F.col("recipient_count").cast("long")
    cells = materialize(rows.groupBy("sender", "_day", "_hour").agg(
        F.count(F.lit(1)).alias("n"), F.sum(rc).alias("s"), F.sum(rc * rc).alias("ss"),
        F.count_if("has_attachments").alias("files")))
    hours = cells.where("_hour IS NOT NULL").groupBy("sender", "_hour").agg(F.sum("n").alias("hour_n"))
    days = cells.where("_day IS NOT NULL").groupBy("sender", "_day").agg(F.sum("n").alias("day_n"))
    senders = cells.groupBy("sender").agg(F.sum("n").alias("n_all"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
                                          F.sum("files").alias("files"))
    day_stats = days.groupBy("sender").agg(F.avg("day_n").alias("day_mean"), F.stddev_samp("day_n").alias("day_std"),
                                           F.count(F.lit(1)).alias("day_count"))
    mean = F.col("s") / F.col("n_all")
    variance = (F.col("ss") - F.col("s") * mean) / (F.col("n_all") - 1)
    profile = (senders.where(F.col("n_all") >= min_mails).join(day_stats, "sender", "left")
               .select("sender", "day_mean", "day_std", "day_count", mean.alias("rc_mean"),
                       F.sqrt(F.greatest(variance, F.lit(0.0))).alias("rc_std"),
                       (F.col("files") / F.col("n_all")).alias("file_rate")))
    per_cell = (cells.select("sender", "_day", "_hour", "n").join(profile, "sender")
                .join(hours, ["sender", "_hour"], "left").join(days, ["sender", "_day"], "left")
                .select("sender", "_day", "_hour", F.col("n").alias("_n"), "rc_mean", "rc_std", "file_rate",
                        (F.col("_hour").isNull() | (F.col("hour_n") < 2)).alias("_t"),
                        F.coalesce((F.col("day_count") >= 3) & (F.col("day_std") > 0)
                                   & ((F.col("day_n") - F.col("day_mean")) / F.nullif(F.col("day_std"), F.lit(0.0)) > 2),
                                   F.lit(False)).alias("_v")))
    keys = ["sender", "_day", "_hour"]
    joined = spread_join(rows, per_cell, keys, counts=cells.select(*keys, F.col("n").alias("_rows")))
    z = (F.col("recipient_count") - F.col("rc_mean")) / F.when(F.col("rc_std") > 0, F.col("rc_std"))
    content = F.coalesce(z > 2, F.lit(False)) | ((F.col("file_rate") < 0.1) & F.col("has_attachments"))
    def known(c):
        return F.coalesce(F.col("_n").isNotNull() & c, F.lit(False))
    return (joined.select(*df.columns, known(F.col("_t")).alias("time_anomaly"),
                          known(F.col("_v")).alias("volume_anomaly"), known(content).alias("content_anomaly"))
            .withColumn("is_behavioral_anomaly",
                        F.col("time_anomaly") | F.col("volume_anomaly") | F.col("content_anomaly")))


def anomaly_patterns(df: DataFrame) -> DataFrame:
    """Long table: peak hours per class, mean recipients per class, departments of flagged mails."""
    cls = F.when(F.col("is_anomaly"), "anomalous").otherwise("normal")
    def top(counts, k):
        w = Window.partitionBy("section").orderBy(F.desc("value"), F.col("_k"))
        return (counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
                .select("section", F.col("_k").cast("string").alias("key"), F.col("value").cast("double").alias("value")))
    hours = (df.where("time IS NOT NULL").groupBy(F.concat(cls, F.lit("_peak_hours")).alias("section"),
                                                  F.hour("time").alias("_k")).agg(F.count(F.lit(1)).alias("value")))
    depts = (df.where("is_anomaly AND department IS NOT NULL")
             .groupBy(F.lit("departments").alias("section"), F.col("department").alias("_k"))
             .agg(F.count(F.lit(1)).alias("value")))
    means = (df.groupBy(F.lit("avg_recipients").alias("section"), cls.alias("key"))
             .agg(F.round(F.avg("recipient_count"), 4).alias("value")))
    return top(hours, 3).unionByName(means).unionByName(top(depts, 5))


def free_mail_label() -> Column:
    return F.when(contains_any(F.lower(blank_if_null("email_domain")), V.IP_FREE_MAIL), "Free Email").otherwise("Business")


def anomaly_triage(df: DataFrame, top: int = 20) -> DataFrame:
    """The most anomalous mails (lowest scores) with the columns an analyst reads first."""
    s = F.col("risk_score")
    return (df.where("is_anomaly").orderBy("anomaly_score", "mail_id").limit(top).select(
        "mail_id", "sender", "subject", "risk_score", "anomaly_score",
        F.when(s > 0, risk_level("risk_score")).otherwise("Unknown").alias("risk_indicator"),
        F.when(~(s > 0), "Unassessed").when(s >= V.HIGH_CUT, "Critical Alert").when(s >= V.MEDIUM_CUT, "Monitor")
         .otherwise("Normal").alias("risk_category"),
        F.when(F.col("last_working_day").isNotNull(), "Leaver").otherwise("Active").alias("leaver_status"),
        (~F.trim(blank_if_null("attachments")).isin("", "0")).alias("has_files"),
        (~F.trim(blank_if_null("word_list_match")).isin("", "0")).alias("has_words"),
        free_mail_label().alias("domain_type"), "recipient_count"))


def anomaly_kpis(triage: DataFrame) -> DataFrame:
    """Totals of the triage list."""
    score = F.when(F.col("risk_score") > 0, F.col("risk_score"))
    return triage.agg(
        F.count(F.lit(1)).alias("listed"), F.count_if(F.col("risk_category") == "Critical Alert").alias("critical"),
        F.count_if(F.col("risk_category") == "Monitor").alias("medium"),
        F.count_if(F.col("leaver_status") == "Leaver").alias("leavers"), F.count_if("has_words").alias("with_words"),
        F.count_if("has_files").alias("with_files"), F.coalesce(F.round(F.avg(score), 4), F.lit(0.0)).alias("mean_risk"),
        F.coalesce(F.max(score), F.lit(0)).alias("max_risk"), F.countDistinct("sender").alias("senders"),
        F.coalesce(F.sum("recipient_count"), F.lit(0)).alias("recipients"),
        F.coalesce(F.round(F.avg("recipient_count"), 4), F.lit(0.0)).alias("mean_recipients"),
        F.count_if(F.col("domain_type") == "Free Email").alias("free_domains"))


def anomaly_actions(df: DataFrame) -> DataFrame:
    """Per flagged mail: severity, coverage, timing band and the actions to take."""
    h, s, a = F.hour("time"), F.col("risk_score"), F.col("anomaly_score")
    leaver = F.col("last_working_day").isNotNull()
    words = ~F.trim(blank_if_null("word_list_match")).isin("", "0")
    files = ~F.trim(blank_if_null("attachments")).isin("", "0")
    coverage = coverage_policy()
    actions = compact_labels(
        (leaver, "PRIORITY 1: Review all recent emails from this departing employee"),
        (leaver, "PRIORITY 1: Check if emails contain company intellectual property"),
        (leaver, "PRIORITY 1: Verify recipient legitimacy and business justification"),
        (words & files, "PRIORITY 2: Scan attachments for sensitive data"),
        (words & files, "PRIORITY 2: Review keyword context in email content"),
        (s >= V.HIGH_CUT, "HIGH RISK: Escalate to security team immediately"),
        (s >= V.HIGH_CUT, "HIGH RISK: Consider contacting sender to verify legitimate activity"),
        (s.between(V.MEDIUM_CUT, V.HIGH_CUT - 1), "MEDIUM RISK: Monitor sender for pattern changes"),
        (s.between(V.MEDIUM_CUT, V.HIGH_CUT - 1), "MEDIUM RISK: Document for trend analysis"),
        (coverage != "Both", "SECURITY: Ensure complete security tool coverage"))
    return df.where("is_anomaly").select(
        "mail_id", "sender", "risk_score",
        F.when(a < -2, "Extreme").when(a < -1, "High").otherwise("Moderate").alias("severity"),
        coverage.alias("coverage"), free_mail_label().alias("domain_type"),
        F.when((h < 6) | (h > 22), "After hours").when(h.between(6, 8) | h.between(18, 22), "Early or late")
         .when(h.isNotNull(), "Business hours").alias("timing"),
        F.array_join(actions, "; ").alias("actions"))

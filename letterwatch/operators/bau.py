"""Business-as-usual analysis of low-risk mail."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as V
from ..functions.frames import rolled, totalled
from ..functions.text import blank_if_null, contains_any, count_words_in, words_in
from .behaviour import daily_volume
from .content import common_subject_words
from .normalize import attachment_count
from .org import describe


def _count() -> Column:
    return F.count(F.lit(1))


def business_hours() -> Column:
    return F.coalesce(F.col("hour").between(9, 17) & (F.col("day_of_week") <= 4), F.lit(False))


def bau_scope(df: DataFrame, scope: str = "low") -> DataFrame:
    """Low-risk mails (or all) with hour, weekday and business-hours flag."""
    rows = df.where(F.col("risk_level") == "Low") if scope == "low" and "risk_level" in df.columns else df
    return (rows.withColumns({"hour": F.hour("time"), "day_of_week": F.weekday("time")})
            .withColumn("is_business_hours", business_hours()))


def _kv(section: str, pairs) -> Column:
    return F.array(*[F.struct(F.lit(section).alias("section"), F.lit(k).alias("key"),
                              F.round(v.cast("double"), 4).alias("value")) for k, v in pairs])


def _described(row: DataFrame, section: str) -> DataFrame:
    names = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    return row.select(F.inline(_kv(section, [(n, F.col(n)) for n in names])))


def bau_temporal(scope: DataFrame) -> DataFrame:
    """Long table: business-hours share, peak hour, distribution of daily volume, mails per weekday.  One scan."""
    sections = rolled(scope, {"hour": ["hour"], "week": ["day_of_week"], "day": {"day": F.to_date("time")}, "all": []}, n=_count(),
                      business=F.count_if("is_business_hours"))
    peak = sections["hour"].where("hour IS NOT NULL").agg(F.min_by("hour", F.struct(-F.col("n"), F.col("hour"))).alias("peak"))
    head = sections["all"].select(F.inline(_kv("overview", [("business_hours_pct", F.col("business") * 100.0 / F.nullif("n", F.lit(0)))])))
    days = sections["day"].where("day IS NOT NULL").agg(*describe(F.col("n")))
    weekly = (sections["week"].where("day_of_week IS NOT NULL")
              .select(F.lit("weekday").alias("section"), F.col("day_of_week").cast("string").alias("key"),
                      F.col("n").cast("double").alias("value")))
    return (head.unionByName(peak.select(F.inline(_kv("overview", [("peak_hour", F.col("peak"))]))))
            .unionByName(_described(days, "daily_volume"))
            .unionByName(weekly))


def bau_senders(scope: DataFrame, top: int = 10) -> DataFrame:
    """Long table: regular senders, number of senders, mails per sender, share of the busiest."""
    counts, total = totalled(scope.groupBy("sender").agg(_count().alias("n")), "n")
    counts = counts.where("sender IS NOT NULL")
    head = counts.agg(_count().alias("senders"), F.avg("n").alias("mean"), F.max("n").alias("top")).select(
        F.inline(_kv("overview", [("senders", F.col("senders")), ("mails_per_sender", F.col("mean")),
                                  ("top_sender_pct", F.col("top") * 100.0 / total)])))
    best = counts.orderBy(F.desc("n"), "sender").limit(top).select(
        F.lit("regular_sender").alias("section"), F.col("sender").alias("key"), F.col("n").cast("double").alias("value"))
    return head.unionByName(best)


def bau_subjects(scope: DataFrame, top: int = 20) -> DataFrame:
    words = common_subject_words(scope, top).select(F.lit("word").alias("section"), F.col("word").alias("key"),
                                                    F.col("n").cast("double").alias("value"))
    lengths = scope.agg(*describe(F.length(blank_if_null("subject"))))
    return words.unionByName(_described(lengths, "subject_length"))


def bau_domains(scope: DataFrame, top: int = 10) -> DataFrame:
    counts = (scope.select(F.explode("recipient_domains").alias("d")).select(F.trim("d").alias("domain"))
              .where("domain <> ''").groupBy("domain").agg(_count().alias("n")))
    internal = contains_any(F.lower(F.col("domain")), V.INTERNAL_SUFFIXES)
    head = counts.agg(_count().alias("domains"), F.count_if(internal).alias("internal")).select(F.inline(_kv("overview", [
        ("domains", F.col("domains")), ("internal", F.col("internal")),
        ("external", F.col("domains") - F.col("internal"))])))
    best = counts.orderBy(F.desc("n"), "domain").limit(top).select(
        F.lit("common_domain").alias("section"), F.col("domain").alias("key"), F.col("n").cast("double").alias("value"))
    return head.unionByName(best)


def bau_volume_days(scope: DataFrame, q: float = 0.95) -> DataFrame:
    days = daily_volume(scope)
    limit = days.agg(F.percentile("mails", q).alias("p")).scalar()
    return days.where(F.col("mails") > limit).select(
        F.lit("Volume Spike").alias("type"), "day", "mails", F.lit("Medium").alias("severity"),
        F.concat(F.lit("Unusually high volume of low-risk emails: "), F.col("mails").cast("string"), F.lit(" emails")
                 ).alias("description"))


def bau_off_hours(scope: DataFrame, limit: float = 0.1) -> DataFrame:
    off = F.count_if(~F.col("is_business_hours"))
    return (scope.agg(off.alias("mails"), _count().alias("total")).where(F.col("mails") > F.col("total") * limit)
            .select(F.lit("Off-Hours Activity").alias("type"), "mails",
                    F.round(F.col("mails") * 100.0 / F.col("total"), 4).alias("pct"), F.lit("Low").alias("severity"),
                    F.concat(F.col("mails").cast("string"), F.lit(" low-risk emails sent outside business hours")
                             ).alias("description")))


def bau_attachment_outliers(scope: DataFrame, q: float = 0.95) -> DataFrame:
    rows = scope.select("mail_id", "sender", attachment_count().alias("attachment_count"))
    limit = rows.agg(F.percentile("attachment_count", q).alias("p")).scalar()
    return rows.where(F.col("attachment_count") > limit).select(
        F.lit("High Attachment Count").alias("type"), "mail_id", "sender", "attachment_count",
        F.lit("Medium").alias("severity"),
        F.concat(F.lit("Low-risk email with unusually high attachment count: "), F.col("attachment_count").cast("string")
                 ).alias("description"))


def bau_findings(scope: DataFrame) -> DataFrame:
    return (bau_volume_days(scope).unionByName(bau_off_hours(scope), allowMissingColumns=True)
            .unionByName(bau_attachment_outliers(scope), allowMissingColumns=True))


def bau_anomalies(scope: DataFrame) -> DataFrame:
    """Findings by type and severity, counted as ``bau_findings`` lists them, in one scan: days, attachment counts and the total."""
    sections = rolled(scope, {"day": {"day": F.to_date("time")}, "files": {"files": attachment_count()}, "all": []}, n=_count(),
                      off=F.count_if(~F.col("is_business_hours")))
    days, files = sections["day"].where("day IS NOT NULL"), sections["files"].where("files IS NOT NULL")
    busy = days.agg(F.percentile("n", 0.95).alias("p")).scalar()
    many = files.agg(F.percentile("files", 0.95, F.col("n")).alias("p")).scalar()
    def found(kind, severity, rows):
        return rows.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), "findings")
    return (found("Volume Spike", "Medium", days.agg(F.count_if(F.col("n") > busy).alias("findings")))
            .unionByName(found("Off-Hours Activity", "Low", sections["all"].select((F.col("off") > F.col("n") * 0.1).cast("long").alias("findings"))))
            .unionByName(found("High Attachment Count", "Medium", files.agg(F.sum(F.when(F.col("files") > many, F.col("n")).otherwise(0)).alias("findings"))))
            .where("findings > 0"))


def _subject_text(df: DataFrame) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("subject", "body") if c in df.columns]
    return F.lower(F.concat_ws(" ", *parts))


def banking_mails(scope: DataFrame) -> DataFrame:
    return scope.where(contains_any(_subject_text(scope), V.BANKING_WORDS))


def banking_overview(scope: DataFrame, top: int = 5) -> DataFrame:
    """Long table: size, share, hours, senders and words of the banking mails.  Two scans: all groups at once, then the words."""
    bank = contains_any(_subject_text(scope), V.BANKING_WORDS)
    sections = rolled(scope.withColumn("_bank", bank), {"hour": ["hour"], "sender": ["sender"], "all": []}, total=_count(), n=F.count_if("_bank"),
                      b=F.count_if(F.col("_bank") & F.col("is_business_hours")), w=F.count_if(F.col("_bank") & (F.col("day_of_week") >= 5)))
    peak = sections["hour"].where("hour IS NOT NULL AND n > 0").agg(F.min_by("hour", F.struct(-F.col("n"), F.col("hour"))).alias("h")).scalar()
    senders = sections["sender"].where("sender IS NOT NULL AND n > 0").agg(_count().alias("s")).scalar()
    head = sections["all"].where("n > 0").select(F.inline(_kv("overview", [
        ("mails", F.col("n")), ("pct", F.col("n") * 100.0 / F.col("total")), ("business_hours_pct", F.col("b") * 100.0 / F.col("n")),
        ("peak_hour", peak), ("weekend_mails", F.col("w")), ("senders", senders)])))
    rows = banking_mails(scope)
    words = (rows.select(F.explode(words_in(_subject_text(rows), V.BANKING_WORDS)).alias("key")).groupBy("key")
             .agg(_count().cast("double").alias("value")).select(F.lit("word").alias("section"), "key", "value"))
    best = (sections["sender"].where("n > 0").orderBy(F.desc("n"), "sender").limit(top)
            .select(F.lit("top_sender").alias("section"), F.col("sender").alias("key"), F.col("n").cast("double").alias("value")))
    return head.unionByName(words).unionByName(best)


def banking_compliance(scope: DataFrame, marker: str = "external") -> DataFrame:
    """Banking mails with compliance words whose recipient domains carry the marker text."""
    return (banking_mails(scope)
            .where(contains_any(F.lower(blank_if_null("subject")), V.COMPLIANCE_WORDS)
                   & F.contains(F.array_join("recipient_domains", ","), F.lit(marker)))
            .select("mail_id", F.lit("Compliance content sent externally").alias("concern"), "subject"))


def hidden_ip_risks(scope: DataFrame, limit: int = 3) -> DataFrame:
    """Low-risk mails whose words, files and recipients add up to more than ``limit`` points."""
    return _hidden_ip(scope).where(F.col("ip_risk_score") > limit).drop("is_business_hours", "is_banking")


def _hidden_ip(scope: DataFrame) -> DataFrame:
    rows = scope.withColumns({"_t": _subject_text(scope), "_a": F.lower(blank_if_null("attachments"))})
    rows = rows.withColumns({
        "_ip": words_in("_t", V.IP_WORDS), "_bank": words_in("_t", V.BANKING_WORDS),
        "_named": words_in("_a", V.IP_FILE_WORDS),
        "_free": words_in(F.lower(F.array_join("recipient_domains", ",")), V.IP_FREE_MAIL)})
    ip, bank = F.size("_ip") > 0, F.size("_bank") > 0
    to_free = F.when(bank, F.size("_free") * 2).otherwise(0)
    score = (F.size("_ip") * 2 + F.when(ip & bank, 5).otherwise(0) + count_words_in("_a", V.IP_FILE_TYPES)
             + F.size("_named") * 2 + to_free)
    none = F.array().cast("array<string>")
    factors = F.concat(
        F.when(ip, F.array(F.concat(F.lit("IP keywords: "), F.array_join(F.slice("_ip", 1, 3), ", ")))).otherwise(none),
        F.when(ip & bank, F.array(F.lit("Banking + Confidential content combination"))).otherwise(none),
        F.transform("_named", lambda w: F.concat(F.lit("Sensitive filename pattern: "), w)),
        F.when(to_free > 0, F.array(F.lit("Banking content to external domains"))).otherwise(none))
    return (rows.withColumn("ip_risk_score", score)
            .select("mail_id", "sender", "subject", "time", "ip_risk_score", F.array_join(factors, "; ").alias("risk_factors"),
                    F.array_join(F.slice("_bank", 1, 5), ", ").alias("banking_keywords"),
                    F.array_join(F.slice("_ip", 1, 5), ", ").alias("ip_keywords"), *[c for c in ("is_business_hours",) if c in scope.columns], bank.alias("is_banking")))


def bau_recommendations(scope: DataFrame) -> DataFrame:
    """The measures whose share or count is above its limit; everything is counted in one scan."""
    counts = _hidden_ip(scope).agg(
        _count().alias("n"), F.count_if(~F.col("is_business_hours")).alias("off"), F.count_if("is_banking").alias("bank"),
        F.count_if(F.col("ip_risk_score") > 3).alias("ip"))
    def row(category, priority, value, action, limit):
        return F.struct(F.lit(category).alias("category"), F.lit(priority).alias("priority"), value.cast("double").alias("value"),
                        F.lit(action).alias("action"), F.lit(limit).alias("_limit"))
    return counts.select(F.inline(F.array(
        row("Operational Security", "Medium", F.round(F.col("off") * 100.0 / F.nullif("n", F.lit(0)), 4),
            "Review after-hours email policies and monitoring", 20.0),
        row("Financial Data Protection", "High", F.col("bank"), "Implement enhanced monitoring for financial content", 0.0),
        row("Intellectual Property", "High", F.col("ip"), "Review classification rules and implement content-based risk scoring", 0.0),
    ))).where(F.col("value") > F.col("_limit")).drop("_limit")

"""Roll-ups by business unit and department."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.frames import rolled, share, totalled
from ..functions.text import blank_if_null, filled
from .content import has_word_match
from .normalize import comma_recipients


def _count() -> Column:
    return F.count(F.lit(1))


def _pct(part: Column, whole: Column) -> Column:
    return F.round(part * 100.0 / whole, 4)


def _mean(c) -> Column:
    return F.round(F.avg(c), 4)


EXTERNAL = "sender_domain_category != 'Internal'"


def _top(df: DataFrame, by, order: str, k: int, name: str) -> DataFrame:
    """Rank by a count within each group and keep the first k; Spark prunes before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(order), name)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(df: DataFrame, order: str, name: str, k: int) -> DataFrame:
    """The k largest groups overall with their rank (the window sees k rows)."""
    best = df.orderBy(F.desc(order), name).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(order), name)))


def unit_activity(df: DataFrame, top: int = 15) -> DataFrame:
    units, total = totalled(df.groupBy("bunit").agg(
        _count().alias("mails"), F.countDistinct("sender").alias("senders"),
        F.countDistinct("department").alias("departments"), F.count_if(has_word_match()).alias("word_matches"),
        _mean("risk_score").alias("mean_risk")), "mails")
    return _best(units.where("bunit IS NOT NULL"), "mails", "bunit", top).withColumn("pct", share(F.col("mails"), total))


def unit_departments(df: DataFrame, top: int = 10) -> DataFrame:
    groups = df.where("bunit IS NOT NULL AND department IS NOT NULL").groupBy("bunit", "department").agg(
        _count().alias("mails"), F.countDistinct("sender").alias("senders"),
        F.count_if(has_word_match()).alias("word_matches"))
    totals = df.groupBy("bunit").agg(_count().alias("unit_mails"))
    return (_top(groups, ["bunit"], "mails", top, "department").join(totals, "bunit")
            .select("bunit", "department", "mails", "senders", "word_matches", "rank",
                    _pct(F.col("mails"), F.col("unit_mails")).alias("pct")))


def unit_overview(df: DataFrame) -> DataFrame:
    h = F.hour("time")
    return df.where("bunit IS NOT NULL").groupBy("bunit").agg(
        _count().alias("mails"), F.countDistinct("department").alias("departments"),
        F.countDistinct("sender").alias("senders"), F.count_if(has_word_match()).alias("word_matches"),
        _mean("risk_score").alias("mean_risk"),
        F.round(F.count_if((h >= 9) & (h <= 17)) * 100.0 / _count(), 4).alias("business_hours_pct"))


def unit_concentration(df: DataFrame) -> DataFrame:
    units, total = totalled(df.groupBy("bunit").agg(_count().alias("mails")), "mails")
    best = _best(units.where("bunit IS NOT NULL"), "mails", "bunit", 5).withColumn("total", total)
    def part(k):
        return F.round(F.sum(F.when(F.col("rank") <= k, F.col("mails")).otherwise(0)) * 100.0 / F.max("total"), 4)
    return best.agg(part(5).alias("top5_pct"), part(3).alias("top3_pct"), part(1).alias("top1_pct"))


def unit_word_leader(df: DataFrame) -> DataFrame:
    hits = df.where(has_word_match() & F.col("bunit").isNotNull()).groupBy("bunit").agg(_count().alias("mails"))
    return hits.agg(F.min_by("bunit", F.struct(-F.col("mails"), F.col("bunit"))).alias("bunit"),
                    F.max("mails").alias("word_matches"), _count().alias("units"))


def org_kpis(df: DataFrame, *kinds: str) -> DataFrame:
    """Per kind of group: groups, mails per group, groups with high risk, with external mail and with anomalies.  One scan."""
    anomaly = F.col("is_anomaly") if "is_anomaly" in df.columns else F.lit(False)
    kinds = kinds or ("department",)
    sections = rolled(df, {k: [k] for k in kinds}, mails=_count(), high=F.bool_or(F.col("risk_level") == "High"),
                      external=F.bool_or(F.expr(EXTERNAL)), anomaly=F.bool_or(anomaly))
    return reduce(DataFrame.unionByName, [sections[k].where(F.col(k).isNotNull()).agg(
        F.lit(k).alias("kind"), _count().alias("groups"), _mean("mails").alias("mails_per_group"), F.count_if("high").alias("high_risk_groups"),
        F.count_if("external").alias("external_groups"), F.count_if("anomaly").alias("anomalous_groups")) for k in kinds])


def _level_matrix(df: DataFrame, key: str) -> DataFrame:
    levels = ["High", "Medium", "Low"]
    return (df.where(F.col(key).isNotNull()).groupBy(key).pivot("risk_level", levels).agg(_count())
            .select(key, *[F.coalesce(level, F.lit(0)).alias(level.lower()) for level in levels]))


def dept_risk_matrix(df: DataFrame) -> DataFrame:
    return _level_matrix(df, "department")


def unit_risk_matrix(df: DataFrame) -> DataFrame:
    return _level_matrix(df.where("recipients IS NOT NULL"), "bunit")


def dept_external(df: DataFrame) -> DataFrame:
    return df.where(F.expr(EXTERNAL) & F.col("department").isNotNull()).groupBy("department").agg(
        F.count("sender").alias("external_mails"), F.sum(comma_recipients()).alias("recipients"),
        F.count_if(filled("attachments")).alias("with_attachments")).orderBy(F.desc("external_mails"), "department")


def dept_keywords(df: DataFrame) -> DataFrame:
    return df.where("ip_keywords_detected > 0 AND department IS NOT NULL").groupBy("department").agg(
        _count().alias("mails"), F.sum("ip_keywords_detected").alias("keywords"),
        F.round(F.avg("ip_keywords_detected"), 2).alias("mean_keywords")).orderBy(F.desc("keywords"), "department")


def unit_anomalies(df: DataFrame) -> DataFrame:
    return df.where("is_anomaly AND bunit IS NOT NULL").groupBy("bunit").agg(
        _count().alias("anomalies"), _mean("anomaly_score").alias("mean_score"),
        F.round(F.max("anomaly_score"), 4).alias("max_score"), F.countDistinct("sender").alias("senders"))


def cross_dept_kpis(df: DataFrame) -> DataFrame:
    groups = df.where("department IS NOT NULL").groupBy("department").agg(
        F.countDistinct("sender").alias("senders"), F.countDistinct("sender_domain").alias("domains"),
        F.count_if(F.col("risk_level") == "High").alias("high"))
    return groups.agg(_count().alias("departments"), F.sum("senders").alias("department_senders"),
                      F.sum("high").alias("high_risk"), F.sum("domains").alias("department_domains"))


def _departments(df: DataFrame) -> DataFrame:
    """One row per department with everything the department reports need."""
    h = F.hour("time")
    return df.where("department IS NOT NULL").groupBy("department").agg(
        _count().alias("mails"), F.count_if(F.expr(EXTERNAL)).alias("external"),
        F.countDistinct("sender").alias("senders"), F.avg(comma_recipients()).alias("recipients"),
        F.count_if(filled("attachments")).alias("files"), 
        F.count_if(F.col("ip_keywords_detected") > 0).alias("keywords"),
        F.count_if(F.col("risk_level") == "High").alias("high"),
        F.avg(F.length(blank_if_null("subject"))).alias("subject_length"),
        F.count_if((h >= 22) | (h <= 5)).alias("night"))


def dept_volumes(df: DataFrame) -> DataFrame:
    """Internal and external mails per department; needs no score."""
    groups = df.where("department IS NOT NULL").groupBy("department").agg(_count().alias("mails"), F.count_if(F.expr(EXTERNAL)).alias("external"))
    return groups.select("department", "mails", (F.col("mails") - F.col("external")).alias("internal"),
                                   "external", _pct(F.col("external"), F.col("mails")).alias("external_pct"))


def dept_direction(df: DataFrame) -> DataFrame:
    groups = _departments(df)
    mean = groups.agg(F.avg("mails").alias("m")).scalar()
    return groups.select("department", F.col("mails").alias("initiated"), "senders",
                         F.round("recipients", 4).alias("mean_recipients"),
                         F.when(F.col("mails") > mean, "High").otherwise("Normal").alias("initiation_rate"))


def dept_content(df: DataFrame) -> DataFrame:
    return _departments(df).select(
        "department", F.col("files").alias("with_attachments"), _pct(F.col("files"), F.col("mails")).alias("attachment_pct"),
        F.col("keywords").alias("keyword_mails"), F.col("high").alias("high_risk"),
        F.round("subject_length", 4).alias("mean_subject_length"))


def _finding(cond: Column, kind: str, value: Column, severity, factor: str) -> Column:
    return F.when(cond, F.struct(
        F.lit(kind).alias("anomaly"), F.round(value, 4).alias("value"),
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        F.lit(factor).alias("risk_factor")))


def dept_anomalies(df: DataFrame) -> DataFrame:
    """Departments out of line with the average: volume, attachments, external share, night mail.  One scan."""
    h = F.hour("time")
    sections = rolled(df, {"departments": ["department"], "all": []}, mails=_count(), external=F.count_if(F.expr(EXTERNAL)),
                      files=F.count_if(filled("attachments")), night=F.count_if((h >= 22) | (h <= 5)))
    groups = sections["departments"].where("department IS NOT NULL")
    mean = groups.agg(F.avg("mails").alias("m")).scalar()
    overall = sections["all"].select((F.col("files") / F.col("mails")).alias("r")).scalar()
    n = F.col("mails")
    rates = {c: F.col(c) / n for c in ("files", "external", "night")}
    return groups.select("department", F.inline(F.array_compact(F.array(
        _finding(n > mean * 2, "High Volume", n.cast("double"), "Medium", "Volume Spike"),
        _finding(n < mean * 0.3, "Low Volume", n.cast("double"), "Low", "Unusual Quietness"),
        _finding(rates["files"] > overall * 3, "High Attachment Usage", rates["files"], "Medium", "Data Transfer Risk"),
        _finding(rates["external"] > 0.8, "High External Communication", rates["external"], "High",
                 "External Data Flow"),
        _finding(rates["night"] > 0.3, "After-Hours Activity", rates["night"], "Medium", "Unusual Timing")))))


def dept_anomaly_kpis(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity") == "High").alias("high"),
                        F.count_if(F.col("severity") == "Medium").alias("medium"),
                        F.countDistinct("department").alias("departments"))


def dept_sizes(df: DataFrame) -> DataFrame:
    return df.where("department IS NOT NULL").groupBy("department").agg(_count().alias("mails"))


def dept_hour_matrix(df: DataFrame) -> DataFrame:
    hours = list(range(24))
    return (df.where("department IS NOT NULL AND time IS NOT NULL").groupBy("department")
            .pivot("hour", hours).agg(_count())
            .select("department", *[F.coalesce(F.col(str(h)), F.lit(0)).alias(f"h{h:02d}") for h in hours]))


def dept_flags(df: DataFrame) -> DataFrame:
    groups = _departments(df)
    external, words = F.col("external") / F.col("mails"), F.col("keywords") / F.col("mails")
    def flag(cond, name, value, level):
        return F.when(cond, F.struct(F.lit(name).alias("pattern"), F.round(value, 4).alias("share"),
                                     (level if isinstance(level, Column) else F.lit(level)).alias("level")))
    return groups.select("department", F.inline(F.array_compact(F.array(
        flag(external > 0.7, "High External Communication", external,
             F.when(external > 0.8, "Medium").otherwise("Low")),
        flag(words > 0.3, "High IP Keyword Usage", words, "High")))))


def dept_insights(df: DataFrame) -> DataFrame:
    groups = _departments(df)
    def leader(n):
        return F.min_by("department", F.struct(-F.col(n), F.col("department")))
    return groups.agg(_count().alias("departments"), leader("mails").alias("most_active"),
                      F.max("mails").alias("most_active_mails"), leader("external").alias("most_external"),
                      F.max("external").alias("most_external_mails"))


def domain_dept_unit_stats(df: DataFrame) -> DataFrame:
    return (df.where("sender_domain IS NOT NULL AND department IS NOT NULL AND bunit IS NOT NULL")
            .groupBy("sender_domain", "department", "bunit")
            .agg(F.count("sender").alias("mails"), F.count_if(F.col("risk_level") == "High").alias("high_risk"),
                 F.sum("ip_keywords_detected").alias("keywords"))
            .where(((F.col("mails") > 0) & (F.col("high_risk") > 0)) | (F.col("keywords") > 0)))


def domain_totals(df: DataFrame) -> DataFrame:
    """Distinct sender domains by category (a domain counts in every category it was seen in)."""
    seen = df.where("sender_domain IS NOT NULL").groupBy("sender_domain", "sender_domain_category").agg(F.lit(1))
    def distinct(label):
        return F.countDistinct(F.when(F.col("sender_domain_category") == label, F.col("sender_domain")))
    return seen.agg(F.countDistinct("sender_domain").alias("sender_domains"), distinct("Internal").alias("internal"),
                    distinct("Free Email").alias("free"), distinct("Business").alias("business"))


def policy_recommendations(df: DataFrame) -> DataFrame:
    """Up to four policy rows: riskiest department, most anomalous unit, free mail use, keyword use.  One scan."""
    anomaly = F.col("is_anomaly") if "is_anomaly" in df.columns else F.lit(False)
    sections = rolled(df, {"department": ["department"], "bunit": ["bunit"], "all": []}, high=F.count_if(F.col("risk_level") == "High"),
                      anomalies=F.count_if(anomaly), free=F.count_if(F.col("sender_domain_category") == "Free Email"),
                      words=F.count_if(F.col("ip_keywords_detected") > 0))

    def leader(count: str, key: str) -> DataFrame:
        counts = sections[key].where(F.col(key).isNotNull() & (F.col(count) > 0)).select(F.col(key).alias("subject"), F.col(count).alias("n"))
        return counts.orderBy(F.desc("n"), "subject").limit(1)

    def total(count: str) -> DataFrame:
        return sections["all"].where(F.col(count) > 0).select(F.lit("").alias("subject"), F.col(count).alias("n"))

    def row(rows: DataFrame, category, priority, before, after, what) -> DataFrame:
        return rows.select(F.lit(category).alias("category"), F.lit(priority).alias("priority"),
                           F.concat(F.lit(before), "subject", F.lit(after)).alias("recommendation"),
                           F.concat(F.col("n").cast("string"), F.lit(what)).alias("rationale"))
    out = row(leader("high", "department"), "Department Monitoring", "High",
              "Implement enhanced monitoring for ", " department due to high-risk email activity",
              " high-risk emails detected")
    if "is_anomaly" in df.columns:
        out = out.unionByName(row(leader("anomalies", "bunit"), "Business Unit Policy", "Medium",
                                  "Review email policies for ", " business unit", " anomalous emails detected"))
    out = out.unionByName(row(
        total("free"), "Domain Policy", "Medium",
        "Consider restricting or monitoring free email domain usage for business communications", "",
        " emails sent from free email domains detected"))
    return out.unionByName(row(
        total("words"), "Content Monitoring", "High",
        "Implement automated flagging for emails containing IP-related keywords", "",
        " emails with IP keywords detected"))


def report_executive(df: DataFrame) -> DataFrame:
    high = F.count_if(F.col("risk_level") == "High")
    return df.agg(_count().alias("total"), high.alias("high_risk"),
                  F.round(high * 100.0 / _count(), 4).alias("high_risk_pct"))


def describe(c: Column) -> list[Column]:
    """count, mean, std, min, quartiles, max of an integer-like column (few distinct values)."""
    return [F.count(c).alias("count"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"),
            F.min(c).cast("double").alias("min"), F.round(F.percentile(c, 0.25), 4).alias("p25"),
            F.round(F.percentile(c, 0.5), 4).alias("p50"), F.round(F.percentile(c, 0.75), 4).alias("p75"),
            F.max(c).cast("double").alias("max")]


def report_score_describe(df: DataFrame) -> DataFrame:
    return df.agg(*describe(F.col("risk_score")))


def report_top_domains(df: DataFrame, top: int = 20) -> DataFrame:
    return (df.groupBy("email_domain").agg(_count().alias("mails"))
            .orderBy(F.desc("mails"), "email_domain").limit(top))


def report_coverage(df: DataFrame) -> DataFrame:
    return df.groupBy("security_coverage").agg(_count().alias("mails"))

"""Rule-based risk score, levels and alert tiers."""
from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .. import vocab as V
from ..functions.frames import INLINE_LIMIT, inline_values, materialize, spread_join
from ..functions.text import blank_if_null, col, compact_labels, contains_any, filled, is_blank, memo, strip
from .normalize import comma_recipients
from .whitelist import whitelist_filter, whitelist_reason

BUSY_SENDER = 10


def _second_part(address: Column) -> Column:
    return F.lower(strip(F.split_part(address, F.lit("@"), F.lit(2))))


@memo
def risk_domain(sender="sender", recipients="recipients") -> Column:
    to_free = F.exists(F.split(blank_if_null(recipients), ","), lambda r: _second_part(r).isin(V.RISK_FREE_DOMAINS))
    return (F.when(_second_part(blank_if_null(sender)).isin(V.RISK_FREE_DOMAINS), 25).otherwise(0)
            + F.when(to_free, 15).otherwise(0))


@memo
def risk_content(subject="subject", words="word_list_match") -> Column:
    return (F.when(contains_any(F.lower(blank_if_null(subject)), V.RISK_SUBJECT_WORDS), 10).otherwise(0)
            + F.when(strip(blank_if_null(words)) != "", 20).otherwise(0))


def has_real_attachment(attachments="attachments") -> Column:
    a = blank_if_null(attachments)
    return (strip(a) != "") & (a != "0")


@memo
def risk_attachment(attachments="attachments") -> Column:
    risky = contains_any(F.lower(blank_if_null(attachments)), V.RISK_EXTENSIONS)
    return F.when(has_real_attachment(attachments), F.when(risky, 25).otherwise(15)).otherwise(0)


def risk_timing(time="time", dtype: T.DataType | None = None) -> Column:
    """Words of a textual time; a typed timestamp never scores."""
    if not isinstance(dtype, (T.StringType, T.VarcharType)):
        return F.lit(0)
    return F.when(contains_any(F.lower(col(time)), V.RISK_TIME_WORDS), 10).otherwise(0)


@memo
def risk_recipients(recipients="recipients") -> Column:
    n = comma_recipients(recipients)
    return F.when(is_blank(recipients), 0).when(n > 5, 15).when(n > 2, 10).otherwise(0)


def risk_leaver(last_working_day="last_working_day") -> Column:
    return F.when(col(last_working_day).isNotNull() & (strip(col(last_working_day).cast("string")) != ""), 30
                  ).otherwise(0)


def sender_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("sender").agg(F.count(F.lit(1)).alias("sender_mails"))


def risk_volume(df: DataFrame) -> DataFrame:
    """Add ``risk_volume``: 10 points if the sender has more than ten mails in the frame."""
    senders = materialize(sender_counts(df))
    busy = senders.where((F.col("sender_mails") > BUSY_SENDER) & filled("sender"))
    return (spread_join(df, busy, "sender", written=True, counts=senders.withColumnRenamed("sender_mails", "_rows"))
            .withColumn("risk_volume", F.when(F.col("sender_mails").isNotNull(), 10).otherwise(0))
            .drop("sender_mails"))


def risk_whitelist_credit(df: DataFrame, whitelist: DataFrame, inline_limit: int = INLINE_LIMIT) -> DataFrame:
    """Add ``risk_whitelist_credit``: 30 if the sender address or its domain is listed.

    The domain is the lower-cased second part of the address.  A short list is a constant hash set; a longer one is
    semi-joined with the distinct senders, and the listed senders are joined back.  Both give the same points.
    """
    domain = F.lower(strip(F.split_part(blank_if_null("sender"), F.lit("@"), F.lit(2))))
    by_address = whitelist.where(filled("email_address"))
    by_domain = whitelist.where(filled("domain"))
    addresses = inline_values(by_address, "email_address", inline_limit)
    domains = inline_values(by_domain, "domain", inline_limit)
    if addresses is not None and domains is not None:
        hit = filled("sender") & (F.col("sender").isin(addresses) | domain.isin(domains))
        return df.withColumn("risk_whitelist_credit", F.when(hit, 30).otherwise(0))
    senders = df.where(filled("sender")).select("sender", domain.alias("_domain")).distinct()
    listed = (senders.join(by_address.select(F.col("email_address").alias("sender")), "sender", "left_semi")
              .unionByName(senders.join(by_domain.select(F.col("domain").alias("_domain")), "_domain", "left_semi"))
              .select("sender", F.lit(True).alias("_listed")).distinct())
    return (spread_join(df, listed, "sender").withColumn("risk_whitelist_credit", F.when(F.col("_listed"), 30).otherwise(0))
            .drop("_listed"))


RISK_PARTS = ["risk_domain", "risk_content", "risk_attachment", "risk_timing", "risk_recipients", "risk_leaver"]


def risk_parts(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "risk_domain": risk_domain(), "risk_content": risk_content(), "risk_attachment": risk_attachment(),
        "risk_timing": risk_timing("time", df.schema["time"].dataType), "risk_recipients": risk_recipients(),
        "risk_leaver": risk_leaver()})


def risk_score(df: DataFrame, whitelist: DataFrame | None = None, whitelist_credit: bool = False,
               keep_parts: bool = False) -> DataFrame:
    """Add ``risk_score`` (0 to 100).

    ``whitelist_credit=True`` takes 30 points off for listed senders; by default the list has no effect on
    the score, which is what the scoring rules do in practice.
    """
    out = risk_volume(risk_parts(df))
    points = reduce(add, [F.col(c) for c in RISK_PARTS + ["risk_volume"]])
    parts = RISK_PARTS + ["risk_volume"]
    if whitelist is not None and whitelist_credit:
        out = risk_whitelist_credit(out, whitelist)
        points = F.greatest(F.lit(0), points - F.col("risk_whitelist_credit"))
        parts = parts + ["risk_whitelist_credit"]
    out = out.withColumn("risk_score", F.least(F.lit(100), F.greatest(F.lit(0), points)))
    return out if keep_parts else out.drop(*parts)


def risk_level(score="risk_score", labels=V.LEVELS_ENGINE) -> Column:
    s = col(score)
    return F.when(s >= V.HIGH_CUT, labels[0]).when(s >= V.MEDIUM_CUT, labels[1]).otherwise(labels[2])


def risk_summary(df: DataFrame) -> DataFrame:
    s = F.col("risk_score")
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(s >= V.HIGH_CUT).alias("high"),
                  F.count_if((s >= V.MEDIUM_CUT) & (s < V.HIGH_CUT)).alias("medium"),
                  F.count_if(s < V.MEDIUM_CUT).alias("low"), F.round(F.avg(s), 4).alias("mean_score"),
                  F.max(s).alias("max_score"), F.min(s).alias("min_score"))


def risk_attach_filtered(df: DataFrame, whitelist: DataFrame, labels=V.LEVELS_SHORT,
                         whitelist_credit: bool = False) -> DataFrame:
    """Score all mails, then keep the mails that are not whitelisted."""
    scored = risk_score(df, whitelist, whitelist_credit)
    return whitelist_filter(scored, whitelist).withColumn("risk_level", risk_level("risk_score", labels))


@memo
def alert_tier() -> Column:
    leaver = F.col("last_working_day").isNotNull()
    files = ~blank_if_null("attachments").isin("", "0")
    words = filled("word_list_match")
    free = F.coalesce(contains_any(F.lower(F.col("email_domain")), V.TIER_FREE_MAIL), F.lit(False))
    return (F.when(leaver & files & words & free, "Critical").when(leaver & files, "High")
            .when(files & words & ~leaver & ~free, "Medium").otherwise("Low"))


def tier_kpis(df: DataFrame) -> DataFrame:
    tiered = df.select(alert_tier().alias("tier"), "risk_score")
    return (tiered.groupBy("tier").agg(F.count(F.lit(1)).alias("mails"),
                                       F.round(F.avg("risk_score"), 4).alias("mean_score"))
            .withColumn("pct", F.round(F.col("mails") * 100.0 / F.sum("mails").over(Window.partitionBy()), 4)))   # four rows


def tier_views(df: DataFrame, tier: str | None = None) -> DataFrame:
    """The alert lists in reading order: leavers first, then score (ascending for Low), then newest."""
    out = df.withColumns({"tier": alert_tier(), "is_leaver_first": F.col("last_working_day").isNotNull()})
    if tier is not None:
        out = out.where(F.col("tier") == tier)
    rank = F.when(F.col("tier") == "Critical", 0).when(F.col("tier") == "High", 1).when(
        F.col("tier") == "Medium", 2).otherwise(3)
    signed = F.when(F.col("tier") == "Low", F.col("risk_score")).otherwise(-F.col("risk_score"))
    return out.orderBy(rank, F.desc("is_leaver_first"), signed, F.desc_nulls_last("time"), "mail_id")


def risk_factor_means(df: DataFrame) -> DataFrame:
    """Mean score and number of mails per risk factor, highest mean first."""
    h = F.hour("time")
    factors = [
        ("Free Email Domains", F.lower(F.col("email_domain")).isin(V.RISK_FREE_DOMAINS)),
        ("Business Email Domains", F.col("email_domain_type") == "business"),
        ("Emails with Attachments", ~blank_if_null("attachments").isin("", "0")),
        ("Leaver Activity", F.col("last_working_day").isNotNull()),
        ("Sensitive Keywords", filled("word_list_match")),
        ("After Hours Activity", (h < 9) | (h > 17)),
    ]
    aggs = []
    for i, (_, cond) in enumerate(factors):
        aggs += [F.count_if(cond).alias(f"n{i}"), F.avg(F.when(cond, F.col("risk_score"))).alias(f"m{i}")]
    rows = F.array(*[F.struct(F.lit(name).alias("factor"), F.col(f"n{i}").alias("mails"),
                              F.round(F.col(f"m{i}"), 4).alias("mean_score")) for i, (name, _) in enumerate(factors)])
    return df.agg(*aggs).select(F.inline(rows)).where("mails > 0").orderBy(F.desc("mean_score"), "factor")


def risk_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("risk_level").agg(F.count(F.lit(1)).alias("mails"))


def high_risk_factors() -> Column:
    free = contains_any(F.lower(blank_if_null("email_domain")), "gmail yahoo hotmail".split())
    return compact_labels(
        (~blank_if_null("word_list_match").isin("", "0", "nan"), "IP Keywords"),
        (free, "Free Email Domain"),
        (~blank_if_null("attachments").isin("", "0"), "Has Attachments"),
        (F.col("recipient_count") > 5, "Multiple Recipients"))


def high_risk_list(df: DataFrame, level: str = "High") -> DataFrame:
    """Mails of the high level with the factors that explain the score."""
    factors = F.array_join(high_risk_factors(), " • ")
    return (df.where(F.col("risk_level") == level)
            .withColumn("risk_factors", F.when(factors == "", "General Risk Indicators").otherwise(factors)))


def high_risk_kpis(df: DataFrame, level: str = "High") -> DataFrame:
    listed = high_risk_list(df, level)
    has = lambda label: F.count_if(F.contains("risk_factors", F.lit(label)))
    return listed.agg(F.count_if(F.col("risk_score") >= 90).alias("score_90_plus"), has("IP Keywords").alias("with_words"),
                      has("Free Email Domain").alias("free_domains"), has("Has Attachments").alias("with_attachments"))


def quick_stats(df: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Total, analysed (not whitelisted) and high-score mails."""
    return whitelist_reason(df, whitelist).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("whitelist_reason").isNull()).alias("analysed"),
        F.count_if(F.col("risk_score") >= V.HIGH_CUT).alias("high_risk"))

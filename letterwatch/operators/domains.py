"""Domain classification of the mail log and the reports built on it."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import domains as D
from ..functions.frames import arrival, materialize, share, totalled
from ..functions.text import filled, listed


def classify_domains(df: DataFrame) -> DataFrame:
    """Add type, category and industry of the sender domain and the recipient analysis.

    Existing domain columns are kept; ``recipient_domains`` is always rebuilt from the addresses.
    """
    base = df
    if "sender_domain" not in df.columns:
        base = base.withColumn("sender_domain", D.domain_extract("sender"))
    if "email_domain" not in df.columns:
        base = base.withColumn("email_domain", F.col("sender_domain"))
    if "recipient_domain" not in df.columns:
        base = base.withColumn("recipient_domain", D.first_recipient_domain("recipients"))
    return (base.withColumns({"recipient_domains": D.recipient_domains("recipients"),
                              "_s": D.host("sender_domain"), "_r": D.host("recipient_domain")})
            .withColumns({
                "email_domain_type": D.sender_domain_type("sender_domain", "recipient_domain", "_s", "_r"),
                "email_domain_category": D.domain_category("sender_domain", "_s"),
                "email_domain_industry": D.domain_industry("sender_domain", "_s"),
                "recipient_domain_types": D.recipient_domain_types("recipient_domains"),
                "external_recipient_count": D.external_recipient_count("sender_domain", "recipient_domains"),
                "is_internal_communication": D.internal_flag("sender_domain", "recipient_domains", "_s"),
            })
            .withColumn("sender_domain_category", D.page_category("email_domain_type")).drop("_s", "_r"))


def domain_class_summary(df: DataFrame) -> DataFrame:
    """Long table of counts and shares by type, category and industry, and the internal total."""
    kinds = ["email_domain_type", "email_domain_category", "email_domain_industry"]
    groups, total = totalled(df.groupBy(*kinds, "is_internal_communication").agg(F.count(F.lit(1)).alias("n")), "n")
    counted = (groups.select(F.col("n"), "is_internal_communication", F.explode(F.array(
                   *[F.struct(F.lit(k).alias("section"), F.col(k).alias("value")) for k in kinds],
                   F.struct(F.lit("internal_communication").alias("section"), F.lit("true").alias("value")),
               )).alias("kv")))
    keep = (F.col("kv.section") != "internal_communication") | F.col("is_internal_communication")
    return (counted.where(keep).groupBy("kv.section", "kv.value").agg(F.sum("n").alias("mails"))
            .withColumn("pct", share(F.col("mails"), total)))


def _sender_domain_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("sender_domain").alias("domain")).agg(F.count(F.lit(1)).alias("mails"))


def anomalous_domains(df: DataFrame, limit: float = 0.15) -> DataFrame:
    counts, total = totalled(_sender_domain_counts(df), "mails")
    counts = counts.withColumn("total", total)
    kinds = F.array_compact(F.array(
        F.when(F.col("mails") > F.col("total") * limit,
               F.struct(F.lit("high_volume").alias("type"), F.lit("high").alias("risk_level"),
                        share(F.col("mails"), F.col("total")).alias("pct"), F.lit("").alias("reasons"))),
        F.when(D.suspicious_domain("domain"),
               F.struct(F.lit("suspicious_pattern").alias("type"), F.lit("medium").alias("risk_level"),
                        F.lit(None).cast("double").alias("pct"),
                        listed(D.suspicion_reasons("domain"), "; ").alias("reasons")))))
    return counts.select("domain", "mails", F.inline(kinds))


def domain_report(df: DataFrame) -> DataFrame:
    """One row per sender domain, largest first."""
    counts, total = totalled(_sender_domain_counts(df), "mails")
    counts = counts.where(filled("domain"))
    suspicious = D.suspicious_domain("domain")
    return counts.select(
        "domain", "mails", share(F.col("mails"), total).alias("pct"),
        D.domain_category("domain").alias("category"), D.domain_industry("domain").alias("industry"),
        D.is_free("domain").alias("is_free"), suspicious.alias("is_suspicious"),
        F.when(suspicious, listed(D.suspicion_reasons("domain"), "; ")).otherwise("").alias("suspicion_reasons"),
    ).orderBy(F.desc("mails"), "domain")


def comm_pairs(df: DataFrame) -> DataFrame:
    """One row per mail and distinct recipient domain, with direction and risk of external mail."""
    internal = D.internal_pair("sender_domain", "recipient_domain")
    pairs = (df.select("mail_id", "time", "subject", D.domain_extract("sender").alias("sender_domain"),
                       F.explode(D.recipient_domains("recipients")).alias("recipient_domain")))
    return pairs.withColumn("direction", F.when(internal, "internal").otherwise("external")).withColumn(
        "risk_level", F.when(F.col("direction") == "external",
                             D.external_risk_level("sender_domain", "recipient_domain")))


def sender_domain_stats(df: DataFrame) -> DataFrame:
    """Mails per sender domain; internal if the domain ever wrote to its own organisation."""
    pairs = df.select(D.domain_extract("sender").alias("domain"), "subject",
                      F.explode_outer(D.recipient_domains("recipients")).alias("r"),
                      ).groupBy("domain", "r").agg(F.count(F.lit(1)).alias("n"))
    internal = (pairs.where(filled("domain")).groupBy("domain")
                .agg(F.bool_or(F.coalesce(D.internal_pair("domain", "r"), F.lit(False))).alias("is_internal")))
    mails = (df.select(D.domain_extract("sender").alias("domain"), "subject").where(filled("domain"))
             .groupBy("domain").agg(F.count(F.lit(1)).alias("mails"),
                                    F.countDistinct("subject").alias("subjects")))
    return mails.join(internal, "domain").select(
        "domain", "mails", "subjects",
        F.when(F.col("is_internal"), "internal").otherwise(D.domain_strict_type("domain")).alias("classification"),
        D.domain_category("domain").alias("category"), D.domain_industry("domain").alias("industry"),
        D.business_domain("domain").alias("is_business"))


def recipient_domain_stats(df: DataFrame) -> DataFrame:
    """Mails per recipient domain; class decided by the first sender domain seen.

    Mails are counted per pair of domains in one scan, with the first arrival as a number; the pair that holds a recipient domain's
    first arrival names the sender domain.  Hash aggregates only.
    """
    pairs = materialize(df.select(arrival().alias("_at"), D.domain_extract("sender").alias("sender_domain"),
                                  F.explode(D.recipient_domains("recipients")).alias("domain"))
                        .groupBy("sender_domain", "domain").agg(F.count(F.lit(1)).alias("mails"), F.min("_at").alias("_at")))
    grouped = pairs.groupBy("domain").agg(F.sum("mails").alias("mails"), F.min("_at").alias("_at"), F.count(F.lit(1)).alias("sender_domains"))
    firsts = pairs.select("domain", "_at", F.col("sender_domain").alias("first_sender"))
    return grouped.join(firsts, ["domain", "_at"]).select(
        "domain", "mails", "sender_domains",
        F.when(D.internal_pair("first_sender", "domain"), "internal")
         .otherwise(D.domain_strict_type("domain")).alias("classification"),
        D.domain_category("domain").alias("category"), D.domain_industry("domain").alias("industry"),
        D.business_domain("domain").alias("is_business"))


def industry_breakdown(df: DataFrame) -> DataFrame:
    """Distinct sender and recipient domains per industry."""
    both = df.select(F.explode(F.array_union(F.array(D.domain_extract("sender")),
                                             D.recipient_domains("recipients"))).alias("domain"))
    return (both.where(filled("domain")).distinct()
            .groupBy(D.domain_industry("domain").alias("industry")).agg(F.count(F.lit(1)).alias("domains")))


def domain_risk_summary(df: DataFrame) -> DataFrame:
    """Pairs of domains and the domains by class, from one table of pairs that is written in one scan.

    A mail without a valid recipient domain still counts for its sender domain (a pair without a second end).
    """
    pairs = materialize(df.select(D.domain_extract("sender").alias("sender_domain"), F.explode_outer(D.recipient_domains("recipients")).alias("recipient_domain"))
                        .groupBy("sender_domain", "recipient_domain").agg(F.count(F.lit(1)).alias("mails")))
    internal = F.coalesce(D.internal_pair("sender_domain", "recipient_domain"), F.lit(False))
    ends = F.col("recipient_domain").isNotNull()
    def mails(which):
        return F.coalesce(F.sum(F.when(ends & which, F.col("mails"))), F.lit(0))
    traffic = pairs.agg(mails(~internal).alias("external_pairs"), mails(internal).alias("internal_pairs"),
                        F.countDistinct("recipient_domain").alias("recipient_domains"))
    senders = pairs.where(filled("sender_domain")).groupBy("sender_domain").agg(F.bool_or(internal).alias("internal")).agg(
        F.count(F.lit(1)).alias("sender_domains"), F.count_if(D.business_domain("sender_domain")).alias("business_domains"),
        F.count_if(~F.col("internal") & (D.domain_strict_type("sender_domain") == "free")).alias("free_domains"))
    return traffic.select("*", *[senders.select(c).scalar().alias(c) for c in ("sender_domains", "business_domains", "free_domains")])


def domain_type_volume(df: DataFrame) -> DataFrame:
    """Mails per class of sender domain; classified once per distinct domain."""
    kind = D.domain_strict_type("domain")
    label = (F.when(kind == "free", "Free Email").when(kind == "internal", "Internal Domain")
             .when(kind == "business", "Business Domain").otherwise("Unknown"))
    return (_sender_domain_counts(df).groupBy(label.alias("domain_class"))
            .agg(F.sum("mails").alias("mails")))

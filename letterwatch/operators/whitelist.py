"""Removal and reporting of whitelisted traffic."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.frames import INLINE_LIMIT, inline_values, rolled, share
from ..functions.text import blank_if_null, filled, let, strip


def _domain_of(address: Column) -> Column:
    return F.when(F.contains(address, F.lit("@")), F.substring_index(address, "@", -1)).otherwise("")


def _candidates() -> Column:
    """All (kind, value) pairs of a mail in order of precedence."""
    def entry(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    sender = blank_if_null("sender")
    own = F.array(entry("Sender email", sender), entry("Sender domain", _domain_of(sender)))
    others = F.flatten(F.transform(
        F.split(blank_if_null("recipients"), ","),
        lambda r: F.array(entry("Recipient email", strip(r)), entry("Recipient domain", _domain_of(strip(r))))))
    return F.concat(own, others)


def _listed(addresses, domains) -> Column:
    """True if an address of the mail or its domain is listed; every address is cut out once."""
    def known(address: Column) -> Column:
        return let(address, lambda a: a.isin(addresses) | _domain_of(a).isin(domains))
    return known(blank_if_null("sender")) | F.exists(F.split(blank_if_null("recipients"), ","), lambda r: known(strip(r)))


def _message(c: Column) -> Column:
    return F.concat(c["kind"], F.lit(" '"), c["value"], F.lit("' is whitelisted"))


def whitelist_reason(df: DataFrame, whitelist: DataFrame, inline_limit: int = INLINE_LIMIT) -> DataFrame:
    """Add ``whitelist_reason``: the first entry that whitelists the mail, or null.

    The list is counted first.  A short one is inlined as a constant hash set, so mails are not shuffled at
    all; a longer one is semi-joined with the exploded addresses, where Spark picks the join strategy.
    """
    addresses = inline_values(whitelist.where(filled("email_address")), "email_address", inline_limit)
    domains = inline_values(whitelist.where(filled("domain")), "domain", inline_limit)
    if addresses is not None and domains is not None:
        hits = F.filter(_candidates(), lambda c: F.when(c["kind"].endswith("email"), c["value"].isin(addresses))
                        .otherwise(c["value"].isin(domains)))
        return df.withColumn("whitelist_reason", let(F.get(hits, F.lit(0)), _message))
    listed = (whitelist.where(filled("email_address")).select(F.lit("email").alias("what"),
                                                              F.col("email_address").alias("value"))
              .unionByName(whitelist.where(filled("domain")).select(F.lit("domain").alias("what"),
                                                                    F.col("domain").alias("value"))))
    first = (df.select("mail_id", F.posexplode(_candidates()).alias("pos", "c"))
             .select("mail_id", "pos", "c", F.substring_index("c.kind", " ", -1).alias("what"),
                     F.col("c.value").alias("value"))
             .join(listed, ["what", "value"], "left_semi")
             .groupBy("mail_id").agg(F.min_by("c", "pos").alias("c")))
    return (df.join(first, "mail_id", "left").withColumn("whitelist_reason", _message(F.col("c"))).drop("c"))


def whitelist_filter(df: DataFrame, whitelist: DataFrame, inline_limit: int = INLINE_LIMIT) -> DataFrame:
    """Mails that no whitelist entry matches.  A short list needs no reason for that (see ``whitelist_reason``)."""
    addresses = inline_values(whitelist.where(filled("email_address")), "email_address", inline_limit)
    domains = inline_values(whitelist.where(filled("domain")), "domain", inline_limit)
    if addresses is not None and domains is not None:
        return df.where(~_listed(addresses, domains))
    return (whitelist_reason(df, whitelist, inline_limit).where(F.col("whitelist_reason").isNull())
            .drop("whitelist_reason"))


def whitelist_hits(df: DataFrame, whitelist: DataFrame, inline_limit: int = INLINE_LIMIT) -> DataFrame:
    return (whitelist_reason(df, whitelist, inline_limit).where(F.col("whitelist_reason").isNotNull())
            .select("mail_id", "time", "sender", "recipients", "subject", "department",
                    F.col("bunit").alias("business_unit"), "whitelist_reason", "attachments", "word_list_match"))


def whitelist_append(whitelist: DataFrame, new_entries: DataFrame, dedupe: bool = False) -> DataFrame:
    out = whitelist.unionByName(new_entries)
    return out.dropDuplicates() if dedupe else out


def whitelist_totals(df: DataFrame, whitelist: DataFrame) -> DataFrame:
    listed = F.count_if(F.col("whitelist_reason").isNotNull())
    return (whitelist_reason(df, whitelist).agg(F.count(F.lit(1)).alias("total"), listed.alias("whitelisted"))
            .select("total", "whitelisted", (F.col("total") - F.col("whitelisted")).alias("remaining"),
                    share(F.col("whitelisted"), F.col("total")).alias("whitelisted_pct")))


def whitelist_reason_counts(hits: DataFrame, top: int = 5) -> DataFrame:
    """Counts by reason, and the departments with most whitelisted mail."""
    sections = rolled(hits, {"reason": ["whitelist_reason"], "department": ["department"], "all": []}, mails=F.count(F.lit(1)))
    reasons = sections["reason"].withColumnRenamed("whitelist_reason", "name")
    depts = sections["department"].withColumnRenamed("department", "name").orderBy(F.desc("mails"), "name").limit(top)
    total = sections["all"].scalar()
    return (reasons.select(F.lit("reason").alias("section"), "name", "mails")
            .unionByName(depts.select(F.lit("department").alias("section"), "name", "mails"))
            .withColumn("pct", share(F.col("mails"), total)))


def whitelist_daily(hits: DataFrame) -> DataFrame:
    return (hits.where("time IS NOT NULL").groupBy(F.to_date("time").alias("day"))
            .agg(F.count(F.lit(1)).alias("mails")))


def whitelist_domain_counts(hits: DataFrame, top: int = 10) -> DataFrame:
    reason = F.col("whitelist_reason")
    counted = (hits.where(F.contains(reason, F.lit("Sender domain")) | F.contains(reason, F.lit("Recipient domain")))
               .groupBy(F.when(reason.startswith("Sender"), "sender").otherwise("recipient").alias("kind"),
                        F.get(F.split(reason, "'"), F.lit(1)).alias("domain"))
               .agg(F.count(F.lit(1)).alias("mails")))
    w = Window.partitionBy("kind").orderBy(F.desc("mails"), "domain")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def whitelist_review(hits: DataFrame, as_of) -> DataFrame:
    """Review advice: stale entries, sensitive words, attachments."""
    as_of = F.lit(as_of).cast("timestamp") if not isinstance(as_of, Column) else as_of
    counts = hits.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("time") > as_of - F.expr("INTERVAL 30 DAYS")).alias("recent"),
        F.count_if(filled("word_list_match")).alias("words"), F.count_if(filled("attachments")).alias("files"))

    def row(kind, n, what, action, priority):
        return F.struct(F.lit(kind).alias("type"), n.cast("long").alias("mails"),
                        F.concat(n.cast("string"), F.lit(" whitelisted emails " + what)).alias("description"),
                        F.lit(action).alias("action"), F.lit(priority).alias("priority"))
    return counts.select(F.inline(F.array(
        row("Inactive Domains", F.col("n") - F.col("recent"), "are older than 30 days",
            "Review domains with no recent activity for potential removal", "Medium"),
        row("Sensitive Content", F.col("words"), "contain sensitive keywords",
            "Review if these domains should remain whitelisted", "High"),
        row("Attachment Activity", F.col("files"), "contain attachments",
            "Verify attachment activity is appropriate for whitelisted domains", "Medium")))).where("mails > 0")

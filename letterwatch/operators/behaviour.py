"""Volumes, spikes, bursts, first contacts and the sender-domain graph."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import domains as D
from ..functions.frames import around_rank, arrival, arrived, materialize, spread_join, value_at_rank
from ..functions.text import blank_if_null, filled, strip, truncate_ellipsis



def _count() -> Column:
    return F.count(F.lit(1))


def sender_days(df: DataFrame, sender: str = "sender", time: str = "time") -> DataFrame:
    return (df.where(F.col(time).isNotNull()).groupBy(F.col(sender).alias("sender"), F.to_date(time).alias("day"))
            .agg(_count().alias("mails")))


def volume_baseline(df: DataFrame, sender: str = "sender", time: str = "time") -> DataFrame:
    """Mean, deviation, median and maximum of the daily mail count of each sender."""
    return sender_days(df, sender, time).groupBy("sender").agg(
        F.avg("mails").alias("avg_daily"), F.coalesce(F.stddev_samp("mails"), F.lit(0.0)).alias("std_daily"),
        F.median("mails").alias("median_daily"), F.max("mails").alias("max_daily"))


def volume_spikes(df: DataFrame, baseline: DataFrame, threshold: float = 2) -> DataFrame:
    z = F.when(F.col("std_daily") > 0, (F.col("mails") - F.col("avg_daily")) / F.col("std_daily")).otherwise(0.0)
    return (sender_days(df).join(baseline, "sender", "left").withColumn("volume_zscore", z)
            .withColumn("is_volume_spike", F.col("volume_zscore") > threshold))


def _flagged(mails: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    """The mails with a flag that is true for those in ``hits`` (mail_id).

    Only hits are made distinct; the mails themselves are in an exchange only if the hits are too many to be broadcast.
    """
    found = hits.select("mail_id").distinct().withColumn("_hit", F.lit(True))
    return spread_join(mails, found, "mail_id").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit")


def new_domains_lookback(df: DataFrame, days: int = 30) -> DataFrame:
    """Mails of the last ``days`` days with a flag: goes to a domain this sender never wrote to before.

    Senders without older mail are not flagged.  The log is scanned once, into a narrow copy; pairs are aggregated before any
    join, and only the mails of fresh pairs go on from there.
    """
    rows = materialize(df.select("mail_id", "sender", "time", "recipient_domains"))
    cutoff = rows.agg(F.max("time").alias("t")).select((F.col("t") - F.make_dt_interval(F.lit(days))).alias("t")).scalar()
    pairs = materialize(rows.where("time IS NOT NULL").select("sender", (F.col("time") < cutoff).alias("old"), F.explode_outer("recipient_domains").alias("domain"))
                        .groupBy("sender", "domain").agg(F.bool_or("old").alias("old"), F.bool_or(~F.col("old")).alias("recent")))
    known = pairs.where("old").select("sender").distinct()
    fresh = pairs.where("recent AND NOT old AND domain IS NOT NULL").join(known, "sender", "left_semi").select("sender", "domain", F.lit(True).alias("_fresh"))
    recent = rows.where(F.col("time") >= cutoff)
    exploded = recent.select("mail_id", "sender", F.explode("recipient_domains").alias("domain")).where("domain IS NOT NULL")
    hits = spread_join(exploded, fresh, ["sender", "domain"]).where("_fresh")
    return _flagged(recent.select("mail_id", "sender", "time"), hits, "has_new_domain")


def burst_flag(df: DataFrame, window_minutes: int = 60, min_mails: int = 5) -> DataFrame:
    """One row per mail: is it one of ``min_mails`` mails by its sender to one domain within the window?

    The log is scanned once, into a narrow copy.  Equal times are counted first; pairs of sender and domain with fewer than
    ``min_mails`` mails in all cannot hit and go no further.  The running count then works in time buckets of one window
    length, each seeing its two neighbours, so a busy pair is spread over its hours instead of sorted whole.
    """
    span = window_minutes * 60 * 1_000_000
    mails = materialize(df.select("mail_id", "sender", F.unix_micros(F.col("time").cast("timestamp")).alias("at"),
                                  F.array_distinct("recipient_domains").alias("_domains")))
    rows = mails.where("at IS NOT NULL").select("mail_id", "sender", "at", F.explode("_domains").alias("domain")).where("domain IS NOT NULL")
    pair = ["sender", "domain", "at"]
    ticks = materialize(rows.groupBy(*pair).agg(_count().alias("n")))
    busy = ticks.groupBy("sender", "domain").agg(F.sum("n").alias("_all")).where(F.col("_all") >= min_mails)
    likely = spread_join(ticks, busy, ["sender", "domain"], row_id="at").where("_all IS NOT NULL").drop("_all")
    home = ((F.col("at") - F.pmod(F.col("at"), F.lit(span))) / span).cast("long")
    seen = (likely.withColumn("home", home)
            .withColumn("bucket", F.explode(F.array(F.col("home") - 1, F.col("home"), F.col("home") + 1))))
    w = Window.partitionBy("sender", "domain", "bucket").orderBy("at").rangeBetween(-span, span)
    bursts = (seen.withColumn("near", F.sum("n").over(w))
              .where((F.col("bucket") == F.col("home")) & (F.col("near") >= min_mails))
              .select(*pair, F.col("n").alias("_n")))
    hits = spread_join(rows, bursts, pair).where("_n IS NOT NULL")
    return _flagged(mails.select("mail_id"), hits, "has_burst_pattern")


CONTACT_ADDRESS = D.ADDRESS


def first_contact(df: DataFrame) -> DataFrame:
    """The first mail of each sender to each recipient domain.

    Two phases: a hash minimum of one number per pair (see ``arrival``), combined before the shuffle, so a busy pair needs no sort
    and no text is carried along; then the winning mails are fetched by their number.
    """
    domains = F.array_distinct(F.transform(
        F.regexp_extract_all(blank_if_null("recipients"), F.lit(CONTACT_ADDRESS), F.lit(1)),
        lambda d: strip(F.lower(d))))
    mails = df.where(filled("sender") & filled("recipients"))
    first = (mails.select("sender", arrival().alias("_at"), F.explode(domains).alias("new_domain")).groupBy("sender", "new_domain")
             .agg(F.min("_at").alias("_at")).select("new_domain", arrived("_at").alias("_mail")))
    won = mails.select("mail_id", "time", "sender", "department", "bunit", "subject").join(first, F.col("mail_id") == F.col("_mail"))
    return won.select(
        "sender", "new_domain", "mail_id", "time", "department", F.col("bunit").alias("business_unit"),
        truncate_ellipsis("subject", 50).alias("subject"),
        D.domain_category("new_domain").alias("domain_category"),
        F.when(D.is_free("new_domain"), "High").otherwise("Medium").alias("risk_level"),
        F.lit(True).alias("requires_review"))


def first_contact_kpis(contacts: DataFrame) -> DataFrame:
    return contacts.agg(F.countDistinct("sender").alias("senders"), F.countDistinct("new_domain").alias("domains"),
                        F.count_if(F.col("risk_level") == "High").alias("high_risk"),
                        F.countDistinct("department").alias("departments"))


def first_contact_filter(contacts: DataFrame, level: str | None = None, department: str | None = None,
                         category: str | None = None) -> DataFrame:
    for name, value in (("risk_level", level), ("department", department), ("domain_category", category)):
        if value is not None and value != "All":
            contacts = contacts.where(F.col(name) == value)
    return contacts


def first_contact_top_domains(contacts: DataFrame, top: int = 10) -> DataFrame:
    return (contacts.groupBy("new_domain").agg(_count().alias("contacts"))
            .orderBy(F.desc("contacts"), "new_domain").limit(top)
            .withColumn("category", D.domain_category("new_domain")))


def first_contact_rollups(contacts: DataFrame) -> DataFrame:
    """Department by level matrix of first contacts."""
    return (contacts.groupBy("department").pivot("risk_level", ["High", "Medium"]).agg(_count())
            .select("department", F.coalesce("High", F.lit(0)).alias("high"),
                    F.coalesce("Medium", F.lit(0)).alias("medium")))


def late_sender_domains(df: DataFrame) -> DataFrame:
    """Sender domains that occur only in the later half of the log (by time, then mail number).

    Three scans: a quantile sketch brackets the middle of the log, the few mails inside the bracket are written and the halfway
    mail is found among them, then one aggregation.  The log is never sorted.
    """
    rows = df.select("mail_id", "sender_domain", "department", "bunit",
                     F.coalesce(F.unix_micros(F.col("time").cast("timestamp")), F.lit(2 ** 62)).alias("at"))
    near, below, n = around_rank(rows.select("at", "mail_id"), "at", 0.5, lambda n: [n // 2])
    half = n // 2
    if half:
        at = value_at_rank(near, "at", half - below)
        skipped = below + near.where(F.col("at") < at).count()
        first_late = value_at_rank(near.where(F.col("at") == at), "mail_id", half - skipped)
        late = (F.col("at") > at) | ((F.col("at") == at) & (F.col("mail_id") >= first_late))
    else:
        late = F.lit(True)
    def names(c):
        return F.array_join(F.array_sort(F.collect_set(c)), ", ")
    # department and unit names are combined into distinct sets before the shuffle
    return (rows.where("sender_domain IS NOT NULL").groupBy("sender_domain")
            .agg(_count().alias("mails"), F.bool_and(late).alias("_late"), names("department").alias("departments"),
                 names("bunit").alias("units"))
            .where("_late").drop("_late"))


def daily_volume(df: DataFrame) -> DataFrame:
    return df.where("time IS NOT NULL").groupBy(F.to_date("time").alias("day")).agg(_count().alias("mails"))


def volume_ma7(df: DataFrame) -> DataFrame:
    """Centred seven-day mean; the window runs over daily totals, one row per calendar day."""
    w = Window.orderBy("day").rowsBetween(-3, 3)
    return daily_volume(df).withColumn(
        "ma7", F.when(F.count("mails").over(w) == 7, F.round(F.avg("mails").over(w), 4)))


def timeline(df: DataFrame) -> DataFrame:
    return (df.where("time IS NOT NULL").groupBy(F.to_date("time").alias("day"), "risk_level")
            .agg(_count().alias("mails")))


def hourly_activity(df: DataFrame) -> DataFrame:
    return (df.where("time IS NOT NULL").groupBy(F.hour("time").alias("hour")).agg(_count().alias("mails"))
            .withColumn("after_hours", (F.col("hour") < 8) | (F.col("hour") >= 18)))


def mail_graph_edges(df: DataFrame, first: int = 3) -> DataFrame:
    """Weighted sender-domain edges over the first recipient domains of each mail."""
    return (df.select("sender", F.explode(F.slice("recipient_domains", 1, first)).alias("domain"))
            .where(filled("domain") & (F.col("domain") != F.col("sender")))
            .groupBy("sender", "domain").agg(_count().alias("weight")))


def mail_graph_top(df: DataFrame, top: int = 50, first: int = 3) -> DataFrame:
    """The nodes with most neighbours, with their mail counts."""
    edges = mail_graph_edges(df, first)
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("sender").alias("node"), F.lit("sender").alias("type"), F.lit(0).cast("long").alias("mails")),
        F.struct(F.col("domain").alias("node"), F.lit("domain").alias("type"), F.col("weight").alias("mails")))))
    own = df.groupBy(F.col("sender").alias("node")).agg(_count().alias("mails"))
    degrees = (ends.groupBy("node").agg(_count().alias("degree"), F.max("type").alias("type"),
                                        F.sum("mails").alias("received"))
               .orderBy(F.desc("degree"), "node").limit(top))
    return (degrees.join(own, "node", "left")
            .select("node", "type", "degree", (F.col("received") + F.coalesce("mails", F.lit(0))).alias("mails")))


def mail_graph_top_edges(df: DataFrame, top: int = 50, first: int = 3) -> DataFrame:
    """Edges between the best connected nodes (at most ``top`` of them)."""
    nodes = F.broadcast(mail_graph_top(df, top, first).select("node"))
    return (mail_graph_edges(df, first).join(nodes.withColumnRenamed("node", "sender"), "sender", "left_semi")
            .join(nodes.withColumnRenamed("node", "domain"), "domain", "left_semi")
            .select("sender", "domain", "weight"))

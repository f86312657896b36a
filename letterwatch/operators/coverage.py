"""Coverage of mails by the two security tools."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.frames import share, totalled
from ..functions.text import blank_if_null, strip


def _label(first: Column, second: Column, both: str) -> Column:
    return (F.when(first & second, both).when(first, "Missing Mimecast").when(second, "Missing Tessian")
            .otherwise("No Coverage"))


def coverage_sources(tessian="tessian", mimecast="mimecast") -> Column:
    def on(c):
        return ~F.lower(strip(blank_if_null(c))).isin("", "0", "false", "none", "null")
    return _label(on(tessian), on(mimecast), "Full Coverage")


def coverage_policy(policy="tessian_policy", mimecast="mimecast") -> Column:
    def on(c):
        return ~strip(blank_if_null(c)).isin("", "0", "nan", "None")
    return _label(on(policy), on(mimecast), "Both")


def coverage_counts(df: DataFrame, label: Column | None = None) -> DataFrame:
    label = coverage_sources() if label is None else label
    groups, total = totalled(df.groupBy(label.alias("coverage")).agg(F.count(F.lit(1)).alias("mails")), "mails")
    return groups.withColumn("pct", share(F.col("mails"), total))


def coverage_domains(df: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent mail domains of each coverage class, with their share of the class."""
    counts = (df.groupBy(coverage_sources().alias("coverage"), "email_domain")
              .agg(F.count(F.lit(1)).alias("mails")))
    totals = counts.groupBy("coverage").agg(F.sum("mails").alias("class_mails"))      # four classes
    w = Window.partitionBy("coverage").orderBy(F.desc("mails"), "email_domain")
    best = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return (best.join(F.broadcast(totals), "coverage")
            .select("coverage", "email_domain", "mails", "rank",
                    share(F.col("mails"), F.col("class_mails")).alias("pct")))


def coverage_advice(df: DataFrame) -> DataFrame:
    label = coverage_sources()
    n = df.agg(F.count(F.lit(1)).alias("total"),
               F.count_if(label == "No Coverage").alias("none"), F.count_if(label == "Full Coverage").alias("full"),
               F.count_if(label == "Missing Tessian").alias("no_first"),
               F.count_if(label == "Missing Mimecast").alias("no_second"))

    def row(kind, cond, mails):
        return F.when(cond, F.struct(F.lit(kind).alias("advice"), mails.alias("mails")))
    partial = F.col("no_first") + F.col("no_second")
    return n.select(F.inline(F.array_compact(F.array(
        row("Close the coverage gap", F.col("none") > 0, F.col("none")),
        row("Complete partial coverage", partial > 0, partial),
        row("Coverage is good", F.col("full") >= F.col("total") * 0.8, F.col("full"))))))

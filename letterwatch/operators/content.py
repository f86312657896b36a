"""Content scanning of the mail log and the keyword reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab as V
from ..functions import content as C
from ..functions.frames import materialize, rolled, share, totalled
from ..functions.text import blank_if_null, col, contains_any, listed


def detect_keywords(df: DataFrame, phrases=None) -> DataFrame:
    """Add keyword, pattern and sensitivity columns."""
    staged = df.withColumn("_text", C.mail_text()).withColumns({
        "_hits": C.keyword_hits("_text", phrases), "_patterns": C.pattern_hits("_text")})
    return staged.withColumns({
        "has_ip_keywords": F.size("_hits") > 0,
        "ip_keyword_count": F.size("_hits"),
        "detected_keywords": listed("_hits"),
        "sensitive_patterns_found": listed(C.pattern_names("_patterns")),
        "sensitivity_score": C.sensitivity_score("_hits", C.keyword_categories("_hits"), "_patterns",
                                                 C.attachment_content_score("attachments")),
        "ip_keywords_detected": F.size("_hits"),
    }).drop("_text", "_hits", "_patterns")


def content_level(score="sensitivity_score", low: str = "Low") -> Column:
    s = col(score)
    return F.when(s >= 70, "Critical").when(s >= 50, "High").when(s >= 30, "Medium").otherwise(low)


def keyword_counts(df: DataFrame) -> DataFrame:
    return (df.select(F.explode(F.split("detected_keywords", ",")).alias("k"))
            .select(F.trim("k").alias("keyword")).where("keyword != ''")
            .groupBy("keyword").agg(F.count(F.lit(1)).alias("n")))


def keyword_stats(df: DataFrame, top: int = 10) -> DataFrame:
    """Long table: detection totals, the most frequent keywords, and the score distribution."""
    score = F.col("sensitivity_score")
    totals = df.agg(F.count(F.lit(1)).alias("total"), F.count_if("has_ip_keywords").alias("flagged"),
                    F.avg(score).alias("mean"), F.percentile(score, 0.5).alias("median"),
                    F.max(score).alias("max"), F.count_if(score >= 50).alias("high"))

    def row(section, key, value):
        return F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"),
                        F.round(value.cast("double"), 4).alias("value"))
    summary = totals.select(F.inline(F.array(
        row("detection", "total", F.col("total")), row("detection", "flagged", F.col("flagged")),
        row("detection", "rate_pct", share(F.col("flagged"), F.col("total"))),
        row("sensitivity", "mean", F.col("mean")), row("sensitivity", "median", F.col("median")),
        row("sensitivity", "max", F.col("max")), row("sensitivity", "high_count", F.col("high")))))
    best = (keyword_counts(df).orderBy(F.desc("n"), "keyword").limit(top)
            .select(F.lit("top_keyword").alias("section"), F.col("keyword").alias("key"),
                    F.col("n").cast("double").alias("value")))
    return summary.unionByName(best)


def high_risk_content(df: DataFrame, threshold: int = 30) -> DataFrame:
    """Mails from the threshold on, highest score first.  The scores are written once, as the filter, the sort's sample and the sort
    would each scan all texts again; select the columns that are needed first."""
    return (materialize(df).where(F.col("sensitivity_score") >= threshold)
            .withColumn("content_risk_level", content_level(low="Medium"))
            .orderBy(F.desc("sensitivity_score"), "mail_id"))


def keyword_report(df: DataFrame, threshold: int = 30, top: int = 5) -> DataFrame:
    risky = F.count_if(F.col("sensitivity_score") >= threshold)
    head = df.agg(risky.alias("n"), F.count(F.lit(1)).alias("total")).select(F.inline(F.array(
        F.struct(F.lit("high_risk").alias("section"), F.lit("count").alias("key"),
                 F.col("n").cast("double").alias("value")),
        F.struct(F.lit("high_risk").alias("section"), F.lit("pct").alias("key"),
                 share(F.col("n"), F.col("total")).alias("value")))))
    patterns = (df.select(F.explode(F.split("sensitive_patterns_found", ", ")).alias("key")).where("key != ''")
                .groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(top)
                .select(F.lit("pattern").alias("section"), "key", F.col("n").cast("double").alias("value")))
    return head.unionByName(patterns)


def keyword_export(df: DataFrame) -> DataFrame:
    wanted = ["mail_id", "time", "sender", "recipients", "subject", "has_ip_keywords", "ip_keyword_count",
              "detected_keywords", "sensitive_patterns_found", "sensitivity_score"]
    return (df.select(*[c for c in wanted if c in df.columns])
            .withColumn("content_risk_category", content_level()))


def keyword_dim(spark, phrases=None) -> DataFrame:
    phrases = V.SENSITIVE_PHRASES if phrases is None else phrases
    return spark.createDataFrame([(p,) for p in phrases], "keyword string").withColumn(
        "category", C.keyword_category("keyword"))


def keyword_dim_edit(dim: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """Add and remove custom keywords (a ``keyword`` column each); entries are trimmed and lower-cased."""
    out = dim.select("keyword")
    if add is not None:
        out = out.unionByName(add.select(F.trim(F.lower("keyword")).alias("keyword"))).distinct()
    if remove is not None:
        out = out.join(remove.select(F.trim(F.lower("keyword")).alias("keyword")), "keyword", "left_anti")
    return out.withColumn("category", C.keyword_category("keyword"))


# ---- word list statistics ---------------------------------------------------

def has_word_match(c="word_list_match") -> Column:
    return ~blank_if_null(c).isin("", "0")


def word_rows(df: DataFrame) -> DataFrame:
    """One row per word of the word-list column (longer than two letters)."""
    text = F.lower(blank_if_null("word_list_match"))
    return (df.where(has_word_match())
            .select("sender", "bunit", "department", F.explode(F.split(text, r"(?U)[,;|\s]+")).alias("word"))
            .where(F.length("word") > 2))


def word_frequencies(df: DataFrame, top: int = 20) -> DataFrame:
    words, total = totalled(word_rows(df).groupBy("word").agg(F.count(F.lit(1)).alias("frequency"), F.countDistinct("sender").alias("senders"),
                                                              F.countDistinct("bunit").alias("units")), "frequency")
    return (words.withColumn("pct", share(F.col("frequency"), total)).orderBy(F.desc("frequency"), "word").limit(top))


def _word_counts(df: DataFrame) -> DataFrame:
    return word_rows(df).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def word_freq_bands(df: DataFrame) -> DataFrame:
    n = F.col("n")
    return _word_counts(df).agg(F.count_if(n >= 50).alias("high_words"),
                                F.count_if((n >= 20) & (n < 50)).alias("medium_words"),
                                F.count_if(n < 20).alias("low_words"))


def word_categories(df: DataFrame) -> DataFrame:
    groups = F.array_compact(F.array(*[F.when(contains_any("word", words), F.lit(label))
                                       for label, words in V.WORD_GROUPS.items()]))
    return (_word_counts(df).select(F.explode(groups).alias("category"), "n")
            .groupBy("category").agg(F.sum("n").alias("occurrences")))


def word_breakdown(df: DataFrame, word: str, top: int = 5) -> DataFrame:
    """Top units and departments of one word, with shares."""
    rows = word_rows(df).where(F.col("word") == word.lower())
    sections = rolled(rows, {"bunit": ["bunit"], "department": ["department"], "all": []}, n=F.count(F.lit(1)))
    counted = (sections["bunit"].select(F.lit("bunit").alias("section"), F.col("bunit").alias("name"), "n")
               .unionByName(sections["department"].select(F.lit("department").alias("section"), F.col("department").alias("name"), "n")))
    w = Window.partitionBy("section").orderBy(F.desc("n"), "name")
    return (counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .withColumn("pct", share(F.col("n"), sections["all"].scalar())))


def common_subject_words(df: DataFrame, top: int = 50) -> DataFrame:
    words = F.regexp_extract_all(F.lower(blank_if_null("subject")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return (df.select(F.explode(words).alias("word"))
            .where(~F.col("word").isin(V.STOP_WORDS) & (F.length("word") > 2))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "word").limit(top))

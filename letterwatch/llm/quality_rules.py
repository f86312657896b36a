"""Quality rules with thresholds that adapt to each language and source. DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.frames import materialize
from .common import BLANKS, let, whole_text, without, words

# Fixed cutoffs of the base rules.
MIN_WORDS = 50
MAX_REPEAT_SHARE = 50              # per cent of the words
# A group with fewer documents takes the merged sketch of its language, or else that of all documents.
GROUP_MIN = 100
SPAN = 3                           # fences lie this many quartile distances outside the quartiles,
# and at least so far: rates per thousand, word length in hundredths of a character.
SLACK = {"word_length": 150, "symbol_rate": 150, "dup_line_rate": 300, "repeat_rate": 250}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_window_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array ``w``, first occurrences included.

    Windows are compared by 64-bit hashes, which keeps a row's arrays at eight bytes a word.
    """
    hashes = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))

    def steps(p):          # p: ascending starts of repeated windows; each adds the words that the one before does not cover
        return F.aggregate(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(3))),
                           F.lit(3), lambda acc, x: acc + x)

    def covered(s):        # s: (hash, start) sorted
        return let(F.sort_array(F.array_distinct(F.flatten(F.zip_with(
            F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))))), steps)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)))


def text_stats(df: DataFrame) -> DataFrame:
    """Add the counts of STATS and ``n_lines`` (lines with a word) to rows with a ``text``; a null text has none of anything."""
    t = whole_text()
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    per_word = let(words(t), lambda w: F.struct(F.size(w).alias("n"), repeated_window_words(w).alias("r")))
    per_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return (without(df, *STATS, "n_lines", "_w", "_l").withColumn("_w", per_word).withColumn("_l", per_line)
            .withColumns({"n_words": F.col("_w.n").cast("long"), "n_repeat_words": F.col("_w.r").cast("long"),
                          "word_chars": F.length(F.regexp_replace(t, BLANKS, "")).cast("long"),
                          "n_symbols": F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"),
                          "n_dup_lines": F.col("_l.d").cast("long"), "n_lines": F.col("_l.n").cast("long")})
            .drop("_w", "_l"))


def rates() -> dict[str, Column]:
    """Whole numbers; null for a text without words."""
    some, lines = F.expr("nullif(n_words, 0)"), F.greatest("n_lines", F.lit(1))
    return {"word_length": F.floor(100 * F.col("word_chars") / some), "symbol_rate": F.floor(1000 * F.col("n_symbols") / some),
            "dup_line_rate": F.floor(1000 * F.col("n_dup_lines") / lines), "repeat_rate": F.floor(1000 * F.col("n_repeat_words") / some)}


def bucket(v: Column) -> Column:
    """Bucket of a mergeable quantile sketch over whole numbers: exact below 32, then 16 buckets per power of two."""
    shift = F.length(F.bin(v)) - 5
    return F.when(v < 32, v).otherwise(shift * 16 + F.call_function("shiftright", v, shift)).cast("long")


def bucket_top(b: Column) -> Column:
    """Largest value of a bucket."""
    shift = F.floor((b - 16) / 16).cast("int")
    return F.when(b < 32, b).otherwise(F.call_function("shiftleft", b - shift * 16 + 1, shift) - 1)


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): one count sketch per language, source and metric, built with map-side combine."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("long").alias("value")) for m, v in rates().items()]))
    return (stats.where("NOT base_failed").select("lang", "source", each.alias("m"))
            .groupBy("lang", "source", F.col("m.metric").alias("metric"), bucket(F.col("m.value")).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def fences(sketch: DataFrame) -> DataFrame:
    """One row per language and source: lower and upper fence of every metric, from the narrowest sketch with enough documents.

    Sketches merge by adding counts: those of a language are the sum over its sources, the widest one is the sum of all.
    """
    level = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    merged = (sketch.select(level.alias("level"), "lang", "source", "metric", "bucket", "n")
              .select("level", "metric", "bucket", "n", F.when(F.col("level") < 2, F.col("lang")).alias("lang"),
                      F.when(F.col("level") < 1, F.col("source")).alias("source"))
              .groupBy("level", "lang", "source", "metric", "bucket").agg(F.sum("n").alias("n")))
    group = Window.partitionBy("level", "lang", "source", "metric")
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "docs": F.sum("n").over(group)})
    top = bucket_top(F.col("bucket"))
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * q, top))
    slack = F.create_map(*[F.lit(x) for pair in SLACK.items() for x in pair])[F.col("metric")]
    per_metric = (ranked.groupBy("level", "lang", "source", "metric").agg(F.max("docs").alias("docs"), quartile(1).alias("q1"), quartile(3).alias("q3"))
                  .withColumn("reach", SPAN * (F.col("q3") - F.col("q1")) + slack))
    wide = per_metric.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *[
        F.max(F.when(F.col("metric") == m, v)).alias(f"{m}_{side}") for m in SLACK
        for side, v in (("lo", F.col("q1") - F.col("reach")), ("hi", F.col("q3") + F.col("reach")))])
    limits = F.struct(*[f"{m}_{side}" for m in SLACK for side in ("lo", "hi")])
    of = lambda k: wide.where(F.col("level") == k).select(
        F.col("lang").alias(f"l{k}"), F.col("source").alias(f"s{k}"), F.col("docs").alias(f"n{k}"), limits.alias(f"f{k}"))
    own, language, every = of(0), of(1).drop("s1"), of(2).drop("l2", "s2")
    return (own.join(language, F.col("l0").eqNullSafe(F.col("l1"))).join(every, F.lit(True))      # ``every`` is one row
            .select(F.col("l0").alias("_lang"), F.col("s0").alias("_source"),
                    F.when(F.col("n0") >= GROUP_MIN, F.col("f0")).when(F.col("n1") >= GROUP_MIN, F.col("f1")).otherwise(F.col("f2")).alias("_f")))


def quality_rules(df: DataFrame) -> DataFrame:
    """Add counts, ``base_failed`` and ``kept`` to rows with ``text``, ``lang`` and ``source``.

    Base: fewer than 50 words, or more than half of the words in repeated 3-word windows, fails.  What passes is judged by
    word length, symbols, repeated lines and repeated windows against fences from the quartiles of its language and source,
    taken from one count sketch per group over all documents that pass the base rules; a group with fewer than GROUP_MIN such documents
    takes the fences of its language, or else those of all documents.  Joined by group, so thresholds follow the data, but
    for a fixed allowance: a fence lies at least SLACK outside the quartiles.  Where both quartiles are zero, as for symbols and
    repeats in most prose, that allowance decides (fences from the sketch above zero kept a tenth of the documents labelled bad
    and cut four times as many good ones on the test tables).

    A null or empty text has zero counts and fails the base rules.  Null languages and sources are groups of their own.
    Repeated rows count and are returned repeatedly; an empty table gives an empty table; input columns named like added ones
    are replaced, all others stay.  The texts are read twice, once for the sketches and once for the verdicts; to read them
    once, write ``text_stats`` without the texts and pass it to ``judge``.
    """
    return judge(text_stats(df))


def judge(stats: DataFrame) -> DataFrame:
    """The verdicts for rows that have ``lang``, ``source`` and the counts of ``text_stats``."""
    share = 100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words")
    stats = without(stats, "base_failed", "kept", "_lang", "_source", "_f").withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | share)
    limits = materialize(fences(materialize(sketches(stats))))      # written, so that its size decides on a broadcast
    inside = F.lit(True)
    for m, v in rates().items():
        inside = inside & v.between(F.col(f"_f.{m}_lo"), F.col(f"_f.{m}_hi"))
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("_lang", "_source", "_f", "n_lines")

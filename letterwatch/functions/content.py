"""Column functions that scan text for phrases and structured data."""
from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from .. import vocab as V
from .text import EDGE, blank_if_null, col, contains_any, count_words_in, let, memo, words_in

PUNCTUATION = r"[!-/:-@\[-`{-~]"


@memo
def mail_text(subject="subject", words="word_list_match", attachments="attachments") -> Column:
    def part(c):
        c = col(c).cast("string")
        return F.when((c != "") & (c != "nan"), c)
    return F.lower(F.concat_ws(" ", part(subject), part(words), part(attachments)))


@memo
def clean_for_keywords(text) -> Column:
    """Collapse white space first, then blank punctuation: the order decides which phrases can match."""
    collapsed = F.trim(F.regexp_replace(F.lower(blank_if_null(text)), r"(?U)[\s\x1c-\x1f]+", " "))
    return F.regexp_replace(collapsed, PUNCTUATION, " ")


def _grams(words: Column, n: int) -> Column:
    if n == 1:
        return words
    last = F.size(words) - (n - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def _labelled(words: Column, industry: str, members) -> Column:
    return F.transform(F.filter(words, lambda w: w.isin(members)), lambda w: F.concat(F.lit(industry + ":"), w))


@memo
def keyword_hits(text, phrases=None, industry_phrases=None) -> Column:
    """Sorted distinct phrases found as whole words, plus ``industry:word`` labels.

    Word n-grams are looked up in a constant hash set, so the cost grows with the text and
    not with the number of phrases.
    """
    phrases = V.SENSITIVE_PHRASES if phrases is None else list(phrases)
    industry_phrases = V.INDUSTRY_PHRASES if industry_phrases is None else industry_phrases
    # other non-word characters end a word but never join two words of a phrase
    spaced = F.regexp_replace(clean_for_keywords(text), r"[^\p{L}\p{N} ]", "  ")
    sizes = sorted({len(p.split(" ")) for p in phrases})
    industry_words = [w for ws in industry_phrases.values() for w in ws]

    def found(words: Column) -> Column:
        grams = F.filter(F.concat(*[_grams(words, n) for n in sizes]), lambda g: g.isin(phrases))
        labels = let(F.filter(words, lambda w: w.isin(industry_words)), lambda known: F.concat(
            *[_labelled(known, industry, members) for industry, members in industry_phrases.items()]))
        return F.array_sort(F.array_distinct(F.concat(grams, labels)))
    return let(F.split(spaced, " "), found)


def keyword_category(keyword) -> Column:
    k = col(keyword)
    out = None
    for label, members in V.PHRASE_CATEGORIES.items():
        out = F.when(k.isin(members), label) if out is None else out.when(k.isin(members), label)
    return out.when(F.contains(k, F.lit(":")), F.substring_index(k, ":", 1)).otherwise("general")


@memo
def keyword_categories(hits) -> Column:
    return F.array_sort(F.array_distinct(F.transform(col(hits), keyword_category)))


def pattern_regex(name: str) -> str:
    pattern = next(p for n, p, _ in V.DATA_PATTERNS if n == name)
    if name != "email":                       # begins and ends with a word character
        first, last = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
        return "(?i)" + "|".join(first + alternative.removeprefix(r"\b").removesuffix(r"\b") + last for alternative in pattern.split("|"))
    return "(?i)" + pattern.replace(r"\b", EDGE)


def _possible(text: Column, name: str) -> Column:
    """Cheap test that rules out most texts before the regular expression runs."""
    if name == "email":
        return F.contains(text, F.lit("@"))
    if name == "guid":
        return F.contains(text, F.lit("-"))
    if name == "api_key":
        return F.length(text) >= 32
    return text.rlike(r"\p{Nd}")


@memo
def pattern_hits(text) -> Column:
    """Struct with the number of hits of each structured-data pattern."""
    t = blank_if_null(text)
    return F.struct(*[F.when(_possible(t, name), F.regexp_count(t, F.lit(pattern_regex(name)))).otherwise(0).alias(name)
                      for name, _, _ in V.DATA_PATTERNS])


def pattern_names(hits) -> Column:
    h = col(hits)
    return F.array_compact(F.array(*[F.when(h[name] > 0, F.lit(name)) for name, _, _ in V.DATA_PATTERNS]))


def pattern_points(hits) -> Column:
    h = col(hits)
    return reduce(add, [h[name] * points for name, _, points in V.DATA_PATTERNS])


@memo
def attachment_factors(attachments) -> Column:
    a = F.lower(blank_if_null(attachments))
    dots = F.length(a) - F.length(F.replace(a, F.lit("."), F.lit("")))
    kinds = F.array(*[F.lit("." + t) for t in V.SENSITIVE_FILE_TYPES])
    return F.concat(
        F.transform(F.filter(kinds, lambda t: F.contains(a, t)),
                    lambda t: F.concat(F.lit("sensitive_file_type:"), F.substring(t, 2, 10))),
        F.transform(words_in(a, V.SIZE_WORDS), lambda w: F.concat(F.lit("large_attachment:"), w)),
        F.when(dots > 3, F.array(F.concat(F.lit("multiple_attachments:"), dots.cast("string"))))
         .otherwise(F.array().cast("array<string>")),
        F.transform(words_in(a, V.ARCHIVE_WORDS), lambda w: F.concat(F.lit("compressed_file:"), w)))


@memo
def attachment_content_score(attachments) -> Column:
    a = F.lower(blank_if_null(attachments))
    dots = F.length(a) - F.length(F.replace(a, F.lit("."), F.lit("")))
    scored = (count_words_in(a, ["." + t for t in V.SENSITIVE_FILE_TYPES]) * 5
              + count_words_in(a, V.SIZE_WORDS) * 3
              + F.when(dots > 3, 5).otherwise(0)
              + count_words_in(a, V.ARCHIVE_WORDS) * 8)
    return F.when(a == "", 0).otherwise(scored)


def sensitivity_score(keywords, categories, patterns, attachment_score) -> Column:
    bonus = F.size(F.filter(col(categories), lambda c: c.isin(V.BONUS_CATEGORIES))) * 10
    return F.least(F.lit(100), F.size(col(keywords)) * 5 + pattern_points(patterns) + col(attachment_score) + bonus)


@memo
def word_match_score(word_list_match) -> Column:
    w = F.lower(blank_if_null(word_list_match))
    out = F.when(w == "", 0)
    for points, words in V.WORD_MATCH_GROUPS:
        out = out.when(contains_any(w, words), points)
    return out.when(F.trim(w) != "", 1).otherwise(0)

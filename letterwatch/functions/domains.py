"""Column functions that classify mail domains; no shuffle, no UDF."""
from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from .. import vocab as V
from .text import EDGE, blank_if_null, col, compact_labels, contains_any, count_words_in, is_blank, let, memo, strip

ADDRESS = rf"{EDGE}[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}){EDGE}"


@memo
def domain_extract(email) -> Column:
    text = strip(blank_if_null(email))
    tail = F.lower(F.substring_index(text, "@", -1))
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(tail, r"[^\p{L}\p{N}_.\-]", "")).otherwise("")


def _clean_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"[^\p{L}\p{N}_.\-]", "")


@memo
def address_domains(recipients) -> Column:
    """Domains of all well-formed addresses, in order, with repeats."""
    return F.transform(F.regexp_extract_all(blank_if_null(recipients), F.lit(ADDRESS), F.lit(1)), _clean_host)


@memo
def first_recipient_domain(recipients) -> Column:
    return F.coalesce(_clean_host(F.regexp_extract(blank_if_null(recipients), ADDRESS, 1)), F.lit(""))


@memo
def recipient_domains(recipients) -> Column:
    return F.array_distinct(F.filter(address_domains(recipients), domain_valid))


def domain_valid(d) -> Column:
    d = col(d)
    return F.coalesce((F.length(d) >= 3) & d.rlike(V.DOMAIN_SHAPE), F.lit(False))


@memo
def is_free(d) -> Column:
    return F.coalesce(col(d).isin(V.FREE_DOMAINS), F.lit(False))


def root_domain(d) -> Column:
    return F.substring_index(blank_if_null(d), ".", -2)


def infra_domain(d) -> Column:
    return F.coalesce(col(d).rlike(V.INFRA_DOMAIN), F.lit(False))


@memo
def business_domain(d) -> Column:
    d = col(d)
    return (~is_blank(d) & ~is_free(d) & F.contains(d, F.lit(".")) & ~infra_domain(d)
            & ~d.rlike(V.NON_PRODUCTION) & domain_valid(d))


@memo
def same_organization(a, b) -> Column:
    return ~is_blank(a) & ~is_blank(b) & (root_domain(a) == root_domain(b)) & ~is_free(root_domain(a))


def host(d) -> Column:
    """Domain in comparable form: lower case, no surrounding blanks."""
    return strip(F.lower(col(d)))


@memo
def internal_pair(sender_domain, recipient_domain, sender_host=None, recipient_host=None) -> Column:
    s, r = col(sender_domain), col(recipient_domain)
    a = host(s) if sender_host is None else col(sender_host)
    b = host(r) if recipient_host is None else col(recipient_host)
    return ~is_blank(s) & ~is_blank(r) & (((a == b) & business_domain(a)) | same_organization(a, b))


@memo
def sender_domain_type(sender_domain, recipient_domain, sender_host=None, recipient_host=None) -> Column:
    s = host(sender_domain) if sender_host is None else col(sender_host)
    return (F.when(is_blank(sender_domain), "unknown")
            .when(internal_pair(sender_domain, recipient_domain, sender_host, recipient_host), "internal")
            .when(is_free(s), "free")
            .when(infra_domain(s), "internal")
            .otherwise("business"))


@memo
def domain_strict_type(d) -> Column:
    s = host(d)
    return (F.when(is_blank(d), "unknown").when(is_free(s), "free")
            .when(infra_domain(s), "internal").otherwise("business"))


@memo
def domain_category(d, clean=None) -> Column:
    s = host(d) if clean is None else col(clean)
    out = F.when(is_blank(d), "unknown").when(~is_free(s), "Business Domain")
    for label, members in V.PROVIDER_GROUPS.items():
        out = out.when(s.isin(members), label)
    return out.otherwise("Other Free Email Providers")


def industry_word_weight(word: str) -> int:
    if word in V.STRONG_INDUSTRY_WORDS:
        return 3
    return 2 if len(word) >= 4 else 1


def _industry_score(d: Column, words) -> Column:
    """Sum of the weights of the words found."""
    groups = [[w for w in words if industry_word_weight(w) == weight] for weight in (1, 2, 3)]
    return reduce(add, [count_words_in(d, group) * weight for weight, group in zip((1, 2, 3), groups) if group])


@memo
def domain_industry(d, clean=None) -> Column:
    if clean is None:
        return let(host(d), lambda s: domain_industry(col(d), s))
    raw, s = col(d), col(clean)
    out = F.when(is_blank(raw) | is_free(raw), "not_business")
    for label, members in V.INDUSTRY_DOMAINS.items():
        out = out.when(s.isin(members), label)
    any_word = contains_any(s, [w for ws in V.INDUSTRY_WORDS.values() for w in ws])
    # highest score wins, the earlier industry on a tie
    ranked = F.greatest(*[F.struct(_industry_score(s, words).alias("score"), F.lit(-i).alias("rank"),
                                   F.lit(label).alias("label"))
                          for i, (label, words) in enumerate(V.INDUSTRY_WORDS.items())])
    out = out.when(any_word, ranked["label"])
    for label, words, suffix in V.INDUSTRY_FALLBACKS:
        hit = contains_any(s, words)
        out = out.when(hit | s.endswith(suffix) if suffix else hit, label)
    return out.otherwise("business_other")


@memo
def recipient_domain_types(domains) -> Column:
    return F.transform(col(domains), lambda d: F.when(d.isin(V.FREE_DOMAINS), "free").otherwise("business"))


@memo
def external_recipient_count(sender_domain, domains) -> Column:
    own = F.array_remove(F.transform(col(domains), F.lower), F.lower(col(sender_domain)))
    return F.when(is_blank(sender_domain) | col(domains).isNull(), 0).otherwise(F.size(own))


@memo
def internal_flag(sender_domain, domains, sender_host=None) -> Column:
    s = host(sender_domain) if sender_host is None else col(sender_host)
    return F.coalesce(~is_blank(sender_domain) & ~is_free(s)
                      & F.array_contains(F.transform(col(domains), lambda d: F.trim(F.lower(d))), s), F.lit(False))


@memo
def suspicious_domain(d) -> Column:
    rules = "|".join(pattern for pattern, _ in V.SUSPICION_RULES)
    return ~is_blank(d) & F.lower(col(d)).rlike(rules)


@memo
def suspicion_reasons(d) -> Column:
    d = col(d)
    return compact_labels(*[((F.lower(d) if "spam" in pattern else d).rlike(pattern), reason)
                            for pattern, reason in V.SUSPICION_RULES])


@memo
def external_risk_level(sender_domain, recipient_domain) -> Column:
    r = col(recipient_domain)
    points = (F.when(is_free(r), 2).otherwise(0) + F.when(suspicious_domain(r), 3).otherwise(0)
              + F.when(business_domain(sender_domain) & is_free(r), 1).otherwise(0))
    return F.when(points >= 4, "high").when(points >= 2, "medium").otherwise("low")


def page_category(domain_type) -> Column:
    """Internal / Free Email / Business label of the roll-up pages."""
    t = col(domain_type)
    return F.when(t == "internal", "Internal").when(t == "free", "Free Email").otherwise("Business")

"""URL filters that see through redirects and canonical links. DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.frames import materialize
from .common import without
from .components import connected_components

# (verdict, host, path): a rule holds for its host and all subdomains, if the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does; of equally long ones the first listed."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def address(url: Column) -> Column:
    """What two spellings of one address share: scheme and fragment are left out, the host is in lower case."""
    return F.concat(host_of(url), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), F.lit("")))


def absolute(link: Column, base: Column) -> Column:
    """A link as found on the page ``base``."""
    scheme, host = F.regexp_extract(base, r"(?s)^(.*?)://", 1), host_of(base)
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    return (F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(scheme, F.lit("://"), host, link))
            .otherwise(F.concat(scheme, F.lit("://"), host, F.when(folder == "", "/").otherwise(folder), link)))


def alias_links(pages: DataFrame) -> DataFrame:
    """(url, target): canonical links and redirects in the HTML of each page, as full addresses."""
    targets = F.concat(F.regexp_extract_all("html", F.lit(CANONICAL), 1), F.regexp_extract_all("html", F.lit(REFRESH), 1))
    return (pages.where(F.col("url").contains("://") & F.col("html").isNotNull())
            .select("url", F.explode(targets).alias("link")).select("url", absolute(F.col("link"), F.col("url")).alias("target")))


def alias_verdicts(edges: DataFrame, rules=RULES) -> DataFrame:
    """(address, alias_verdict) of every address that has an alias: the verdict that the rules give to its component.

    Components over the links; an explicit allow anywhere in a component goes before a block; no entry if no rule fits.
    """
    ends = edges.select(F.inline(F.array(F.struct(F.col("url").alias("u")), F.struct(F.col("target").alias("u")))))
    ruled = ends.select(address(F.col("u")).alias("node"), rule_of(host_of(F.col("u")), path_of(F.col("u")), rules)["verdict"].alias("v")).distinct()
    groups = materialize(connected_components(edges.select(address(F.col("url")).alias("u"), address(F.col("target")).alias("v"))))
    decided = (groups.join(ruled, "node").groupBy("component").agg(F.min("v").alias("alias_verdict"))     # "allow" sorts before "block"
               .where("alias_verdict IS NOT NULL"))
    return groups.join(decided, "component").select(F.col("node").alias("_address"), "alias_verdict")


def url_filter(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to pages with ``url`` and ``html``.

    The longest rule that fits an address decides.  Where none fits, the address shares the verdict of its aliases: pages
    that redirect to it or name it canonical, or are named so by it, over any number of steps.  Explicit allows go before
    blocks, and what nobody blocks is allowed.  ``edges`` (url, target) gives further redirects, say of a crawl log.

    A null URL or one without ``://`` has empty host and path, fits no rule, has no alias and is allowed.  A null ``html``
    has no links.  Repeated rows are judged alike; an empty table gives an empty table; columns named like added ones are
    replaced.  Only links are shuffled for the components; pages are joined by address, which spreads hot hosts.
    """
    found = alias_links(pages)
    links = materialize((found.unionByName(edges) if edges is not None else found).distinct())
    decided = materialize(alias_verdicts(links, rules))
    plain = without(pages, "host", "path", "rule", "verdict", "_address", "_rule", "alias_verdict")
    judged = plain.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn(
        "_rule", rule_of(F.col("host"), F.col("path"), rules))
    key = F.when(F.col("url").contains("://"), address(F.col("url")))
    return (judged.join(decided, key == F.col("_address"), "left")
            .withColumn("rule", F.col("_rule.rule")).withColumn("verdict", F.coalesce("_rule.verdict", "alias_verdict", F.lit("allow")))
            .drop("_rule", "_address", "alias_verdict"))

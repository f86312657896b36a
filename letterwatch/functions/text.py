"""Column helpers for text: trimming, word edges, substring lists."""
from __future__ import annotations

from functools import reduce, wraps
from operator import or_

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

# white space that a plain strip removes, beyond the blank
SPACES = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_W = r"[\p{L}\p{N}_]"
# Unicode word edge; Java's own \b differs between JDK releases
EDGE = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_if_null(c) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c) -> Column:
    return F.trim(col(c), F.lit(SPACES))


def is_blank(c) -> Column:
    return F.coalesce(col(c) == "", F.lit(True))


def filled(c) -> Column:
    """Neither null nor the empty string."""
    return ~is_blank(c)


def contains_any(c, words) -> Column:
    """True if any of the words is a substring; stops at the first hit.

    Long lists go through ``exists`` over a constant array: as a chain of ORs they would make one generated
    method too large for the JVM to compile.
    """
    if len(words) <= 6:
        return reduce(or_, [F.contains(col(c), F.lit(w)) for w in words])
    known = F.array(*[F.lit(w) for w in words])
    return let(col(c), lambda text: F.exists(known, lambda w: F.contains(text, w)))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_in(c, words) -> Column:
    """The words (in list order) that are substrings of the text."""
    known = F.array(*[F.lit(w) for w in words])
    return let(col(c), lambda text: F.filter(known, lambda w: F.contains(text, w)))


def count_words_in(c, words) -> Column:
    return F.size(words_in(c, words))


def memo(build):
    """Build a column once per set of plain arguments: large expressions are costly to assemble from Python."""
    cache = {}

    @wraps(build)
    def wrapper(*args, **kwargs):
        plain = all(isinstance(a, (str, int, type(None))) for a in (*args, *kwargs.values()))
        if not plain:
            return build(*args, **kwargs)
        key = (id(SparkContext._gateway), args, tuple(sorted(kwargs.items())))
        if key not in cache:
            cache[key] = build(*args, **kwargs)
        return cache[key]
    return wrapper


def compact_labels(*pairs) -> Column:
    """Array of the labels whose condition holds; null conditions count as false."""
    return F.array_compact(F.array(*[F.when(cond, label if isinstance(label, Column) else F.lit(label))
                                     for cond, label in pairs]))


def truncate_ellipsis(c, n: int, always: bool = False) -> Column:
    text = col(c)
    cut = F.concat(F.substring(text, 1, n), F.lit("..."))
    return cut if always else F.when(F.length(text) > n, cut).otherwise(text)


def listed(arr, sep: str = ", ") -> Column:
    return F.array_join(col(arr), sep)

"""Reading times written in several formats, with day and month in either order."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .text import col, let, strip

# Tried in this order, after ISO.  A format with month and day in numbers also stands for the other order (see ``twin``);
# which of both is meant is settled by the column's own values (see ``vote_dates``).
FORMATS = ("yyyy/M/d[ H:mm[:ss]]", "yyyy-M-d[ H:mm[:ss]]", "yyyy-M-d h:mm[:ss] a", "M/d/yyyy[ H:mm[:ss]]", "M/d/yyyy h:mm[:ss] a",
           "M-d-yyyy[ H:mm[:ss]]", "M.d.yyyy[ H:mm[:ss]]", "d-MMM-yyyy[ H:mm[:ss]]", "d MMM yyyy[ H:mm[:ss]]",
           "MMM d, yyyy[ H:mm[:ss]]", "MMM d, yyyy h:mm[:ss] a", "d MMM yyyy H:mm:ss Z")
WEEKDAY = "^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), "           # left out before reading
ISO = "ISO"
LEADING = re.compile(r"^(M{1,2}|d{1,2})([^A-Za-z0-9\s])(M{1,2}|d{1,2})(?=\2)")
# What the letters of a format can stand for.
PARTS = (("yyyy", r"\d{4}"), ("MMM", "[A-Za-z]{3}"), ("MM", r"\d{2}"), ("dd", r"\d{2}"), ("HH", r"\d{2}"),
         ("hh", r"\d{2}"), ("mm", r"\d{2}"), ("ss", r"\d{2}"), ("M", r"\d{1,2}"), ("d", r"\d{1,2}"), ("H", r"\d{1,2}"), ("h", r"\d{1,2}"),
         ("a", "[AaPp][Mm]"), ("Z", r"[+-]\d{4}"), ("[", "(?:"), ("]", ")?"))


def twin(fmt: str) -> str | None:
    """The same format with day and month exchanged, if both lead it as numbers."""
    found = LEADING.match(fmt)
    if not found or found[1][0] == found[3][0]:
        return None
    return found[3] + found[2] + found[1] + fmt[found.end():]


def shape(fmt: str) -> str:
    """A pattern that every text of the format matches: a cheap test before parsing."""
    out, at = "", 0
    while at < len(fmt):
        letters, pattern = next(((k, p) for k, p in PARTS if fmt.startswith(k, at)), (fmt[at], re.escape(fmt[at])))
        out, at = out + pattern, at + len(letters)
    return f"^{out}$"


def month_first(fmt: str) -> str:
    """Of a format and its twin the one with the month in front; any other format as it is."""
    other = twin(fmt)
    return other if other and fmt.startswith("d") else fmt


def readings(text: Column, formats=FORMATS) -> Column:
    """How the text can be read: struct of the format's name and the times with the month and with the day in front; null if it can't.

    The two times are equal where the format has one order only; one is null where only the other exists.
    """
    def tried(value):
        found = [F.struct(F.lit(ISO).alias("format"), value.try_cast("timestamp").alias("month_first"), value.try_cast("timestamp").alias("day_first"))]
        for fmt in dict.fromkeys(map(month_first, formats)):
            time = F.try_to_timestamp(value, F.lit(fmt))
            other = F.try_to_timestamp(value, F.lit(twin(fmt))) if twin(fmt) else time
            found.append(F.when(value.rlike(shape(fmt)), F.struct(F.lit(fmt).alias("format"), time.alias("month_first"), other.alias("day_first"))))
        return F.get(F.filter(F.array(*found), lambda r: r["month_first"].isNotNull() | r["day_first"].isNotNull()), F.lit(0))
    return let(F.regexp_replace(strip(text.cast("string")), WEEKDAY, ""), tried)


def read_time(c, formats=FORMATS, day_first: Column | bool = False) -> Column:
    """Timestamp of a text; where day and month could be either, in the given order; null if it is in no format.

    A text that exists in one order only ("13/01/2024") is read in that one, whatever is given.
    """
    order = day_first if isinstance(day_first, Column) else F.lit(day_first)
    return let(readings(col(c), formats), lambda r: F.when(F.coalesce(order, F.lit(False)), F.coalesce(r["day_first"], r["month_first"]))
               .otherwise(F.coalesce(r["month_first"], r["day_first"])))

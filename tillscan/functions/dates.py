"""Dates of receipts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillscan import dictionaries as D

from .text import let


def parse_date(raw: Column, as_of_year: int) -> Column:
    """Day, month and optional year; without one ``as_of_year`` holds.

    Years below 100 are of this century. Impossible dates are null.
    """

    def read(p: Column) -> Column:
        year = F.get(p, 2).try_cast("int")
        year = F.when(F.size(p) == 2, F.lit(as_of_year)).when(year < 100, year + 2000).otherwise(year)
        text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.get(p, 1), F.get(p, 0))
        return F.when(F.size(p).isin(2, 3), text).try_cast("date")

    return let(F.split(raw, "[/-]"), read)


def find_date(line: Column, as_of_year: int) -> Column:
    """The first date of a line that can be a receipt's, as written without blanks."""
    plain = F.translate(line, "Oo|", "00/")
    found = F.transform(
        F.regexp_extract_all(plain, F.lit(D.DATE), F.lit(1)), lambda d: F.regexp_replace(d, r"\s+", "")
    )
    return F.get(F.filter(found, lambda d: F.year(parse_date(d, as_of_year)) >= D.FIRST_YEAR), 0)


def is_date_label(norm: Column) -> Column:
    """(P10)"""
    ok = norm.contains(D.DATE_LABEL)
    for word in D.NOT_DATE_LABELS:
        ok = ok & ~norm.contains(word)
    return ok


def normalize_date(raw: Column, as_of_year: int) -> Column:
    """Day/month/year without padding; blank is empty, what is no date stays (D3)."""
    text = F.date_format(parse_date(raw, as_of_year), "d/M/yyyy")
    blank = raw.isNull() | (F.trim(raw) == "")
    return F.when(blank, "").otherwise(F.coalesce(text, raw))

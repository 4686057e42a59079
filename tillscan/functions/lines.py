"""Predicates over lines (``line`` as cleaned, ``norm`` its normal form)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillscan import dictionaries as D

from .amounts import is_price_only
from .text import any_of, compact, has_letters, norm


def has_metadata(n: Column) -> Column:
    """(P2)"""
    return any_of(n, D.METADATA_WORDS)


def has_stop_word(n: Column) -> Column:
    """(P3)"""
    return any_of(n, D.STOP_WORDS)


def _either(n: Column) -> Column:
    return any_of(n, D.METADATA_WORDS + D.STOP_WORDS)


def is_skipped(n: Column, either: Column | None = None) -> Column:
    """Blank, a version, metadata or a stop word (P1). ``either`` tells of the last two, if there is a column that has it."""
    return (n == "") | n.rlike(D.VERSION_LINE) | (_either(n) if either is None else either)


def is_description(line: Column, n: Column, either: Column | None = None) -> Column:
    """A line that can be described by the next one's price (P4); ``either`` as in ``is_skipped``."""
    return (F.length(line) >= 5) & ~(_either(n) if either is None else either) & has_letters(line, 4) & ~is_price_only(line)


def is_product(description: Column, line_norm: Column, either: Column | None = None) -> Column:
    """(P5); ``either`` is as in ``is_skipped``, of the description."""
    return is_name(description, either) & ~is_adjusted(line_norm)


def is_name(description: Column, either: Column | None = None) -> Column:
    """(P5, the description)"""
    return has_letters(description, 3) & ~(_either(norm(description)) if either is None else either)


def is_adjusted(n: Column) -> Column:
    """(P5, the line)"""
    return any_of(n, D.ADJUSTMENT_WORDS) | any_of(compact(n), D.ADJUSTMENT_COMPACT)


def is_app_line(n: Column) -> Column:
    """Names the delivery app (P7, one line)."""
    return any_of(n, D.APP_NAMES)


def is_app_product(line: Column, n: Column, metadata: Column | None = None) -> Column:
    """(P8); ``metadata`` is ``has_metadata``, if there is a column that has it."""
    return (
        (F.length(line) >= 5)
        & ~(has_metadata(n) if metadata is None else metadata)
        & ~n.rlike(D.WEIGHT_LINE)
        & ~any_of(n, D.APP_PROMOTIONS)
        & has_letters(line, 4)
    )


def is_app_inline(line: Column, n: Column) -> Column:
    """(P9, without the amount)"""
    return ~any_of(n, D.METADATA_WORDS + D.APP_INLINE_STOPS) & has_letters(line, 4)


def is_ocr_item(text: Column) -> Column:
    """An OCR line that looks like an item."""
    low = F.lower(squeeze_ends(text))
    # What most lines lack comes first.
    return (
        (low.contains(",") | low.contains("."))
        & low.rlike(r"\p{Nd}")
        & (F.length(low) >= 8)
        & low.rlike(r"\p{L}")
        & ~any_of(low, D.OCR_NOT_ITEM)
    )


def squeeze_ends(text: Column) -> Column:
    """Without white space at both ends."""
    # The pattern tries every character; a look at the outer ones spares it (``$`` also stands before a last U+0085).
    outer = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(outer.rlike(r"[\s\p{Z}\x85]"), F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).otherwise(text)

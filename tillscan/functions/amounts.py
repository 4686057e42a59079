"""Amounts and quantities: finding, reading and writing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillscan import dictionaries as D

from .text import let


def amounts(text: Column) -> Column:
    """All amounts in a text, in order."""
    return F.regexp_extract_all(text, F.lit(D.AMOUNT), F.lit(0))


def first_amount(text: Column) -> Column:
    """The first amount, or null."""
    return F.nullif(F.regexp_extract(text, f"({D.AMOUNT})", 1), F.lit(""))


def without_amounts(text: Column) -> Column:
    return F.regexp_replace(text, D.AMOUNT, " ")


def is_price_only(text: Column) -> Column:
    return text.rlike(D.PRICE_ONLY)


def parse_amount(text: Column) -> Column:
    """The value of an amount (M1); null if it has no digits.

    The last comma or dot is the decimal mark. With a currency sign, five decimals are
    thousands that lost their mark plus cents, and three are thousands; other decimals
    beyond two are cut off.
    """

    money = text.contains("$")

    def read(x: Column) -> Column:
        plain, money = x["plain"], x["money"]
        mark = r"^(.*)[.,]([^.,]*)$"
        whole = F.regexp_replace(F.regexp_extract(plain, mark, 1), "[^0-9-]", "")
        cents = F.regexp_replace(F.regexp_extract(plain, mark, 2), "[^0-9]", "")
        return _decimal(F.when(~plain.rlike("[.,]"), F.regexp_replace(plain, "[^0-9-]", "")), money, whole, cents)

    # As it mostly is: the general way gives the same digits. Columns are compiled, the body of ``let`` is not.
    usual = F.regexp_extract(text, r"^(?:\$ ?)?(\d+[.,]\d\d)$", 1)
    general = let(F.struct(F.regexp_replace(text, r"[$\s]", "").alias("plain"), money.alias("money")), read)
    dotted = F.translate(text, ",$ ", ".")
    cents = F.substring_index(dotted, ".", -1)
    whole = F.replace(F.substr(dotted, F.lit(1), F.length(dotted) - F.length(cents) - 1), F.lit("."), F.lit(""))
    plain = _decimal(F.when(~dotted.contains("."), dotted), money, whole, cents)
    return (
        F.when(usual != "", F.replace(usual, F.lit(","), F.lit(".")).try_cast("double"))
        .when(text.rlike(r"^\$? ?[0-9][0-9.,]*\z"), plain.try_cast("double"))
        .otherwise(general.try_cast("double"))
    )


def _decimal(unmarked: Column, money: Column, whole: Column, cents: Column) -> Column:
    """The digits of an amount with a decimal point; ``unmarked`` if it is not null."""
    return (
        F.when(unmarked.isNotNull(), unmarked)
        .when(money & (F.length(cents) == 5), F.concat(whole, F.substring(cents, 1, 3), F.lit("."), F.substring(cents, 4, 2)))
        .when(money & (F.length(cents) == 3), F.concat(whole, cents))
        .otherwise(F.concat(whole, F.lit("."), F.substring(cents, 1, 2)))
    )


def format_amount(value: Column) -> Column:
    """Two decimals, rounded half to even, with a decimal comma (M5)."""
    return F.replace(F.call_function("format_number", value, F.lit("0.00")), F.lit("."), F.lit(","))


def unit_price(total: Column, quantity: Column) -> Column:
    """Total by quantity; null for quantity 0 (M3)."""
    return F.try_divide(total, quantity)


def quantity(text: Column) -> Column:
    """How many a description names: "n x amount", else "x n", else 1."""
    # An amount has a mark, which most descriptions lack.
    marked = text.contains(",") | text.contains(".")
    times = F.when(marked, F.nullif(F.regexp_extract(text, D.TIMES_AMOUNT, 1), F.lit("")))
    count = F.nullif(F.regexp_extract(text, D.TIMES_COUNT, 1), F.lit(""))
    return F.coalesce(times.try_cast("int"), count.try_cast("int"), F.lit(1))


def app_quantity(text: Column) -> Column:
    """A trailing "nx", else the last weight in kg, else null."""
    units = F.nullif(F.regexp_extract(text, D.TRAILING_UNITS, 1), F.lit(""))
    weights = F.regexp_extract_all(text, F.lit(D.KILOGRAMS), F.lit(1))
    return F.coalesce(units, F.translate(F.try_element_at(weights, F.lit(-1)), ",", "."))


def parse_quantity(text: Column) -> Column:
    """(M4)"""
    return F.coalesce(F.translate(text, ",", ".").try_cast("double"), F.lit(1.0))

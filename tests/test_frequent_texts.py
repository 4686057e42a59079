"""Receipts whose texts are few and frequent, and functions that look at a line no oftener than they need."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tillscan.functions import amounts as A
from tillscan.functions import lines as L
from tillscan.functions import text as X
from tillscan.operators import containment as C
from tillscan.operators.brands import known_brand
from tillscan.operators.header import receipt_header
from tillscan.operators.items import receipt_items
from tillscan.plans.registry import QUERIES
from tillscan.sources.dictionaries import (
    RULE_TABLE, STORE_TABLE, brand_aliases, product_rules, store_aliases,
)

ODD = ["", " ", "a", " a ", "\x01a\x1f", "a\u0085", "a \u0085", " a", "a ", "\xa0a\xa0", "é ", " é", "�", "~", "\x7f", "a\tb", "a  b", "　"]


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def store_table(spark):
    return spark.createDataFrame(store_aliases(), STORE_TABLE)


def test_a_table_of_stores_reads_receipts_once(spark):
    """they were parsed three times."""
    seen = spark.sparkContext.accumulator(0)

    def look(text):
        seen.add(1)
        return text

    receipts = spark.createDataFrame([(i, "SUPERMERCADO\nTienda Filipa") for i in range(20)], "receipt_id int, raw_text string")
    receipts = receipts.select("receipt_id", F.udf(look)("raw_text").alias("raw_text"))
    assert {r.store_name for r in receipt_header(receipts, 2026, store_table(spark)).collect()} == {"Tienda Filipa"}
    assert seen.value == 20


def test_frequent_texts_have_the_same_answers(spark, monkeypatch):
    """frequent and rare lines, with an answer and without, and repeated receipts."""
    monkeypatch.setattr(C, "HOT_ROWS", 2)
    monkeypatch.setattr(C, "HOT_SHARE", 6)
    texts = ["SUPERMERCADO\nTienda Filipa\nLECHE 10,00", "SUPERMERCADO\nOtra cosa\nPAN 10,00", "Los Tres Corazones\nPAPAS 3,00", "", None]
    rows = [(i, texts[0 if i < 9 else i % 5]) for i in range(24)]
    receipts = spark.createDataFrame(rows, "receipt_id int, raw_text string")
    rules = spark.createDataFrame([(r.pos, r.product, w) for r in product_rules() for w in r.words], RULE_TABLE)
    wanted = sorted(map(str, receipt_items(receipts, 2026).collect()))
    assert sorted(map(str, receipt_items(receipts, 2026, store_table(spark), rules=rules).collect())) == wanted


def test_amounts_are_found_once(spark):
    """F16: the text was written and searched again for every mention of an amount."""
    assert optimized(QUERIES["amounts_parsed"](spark, "/root/testdata/sf0.001")).count("regexp_extract_all") == 1


def read_amount(text):
    plain = re.sub(r"[$\s]", "", text)
    if not re.search("[.,]", plain):
        digits = re.sub("[^0-9-]", "", plain)
    else:
        whole, cents = re.fullmatch(r"(.*)[.,]([^.,]*)", plain).groups()
        whole, cents = re.sub("[^0-9-]", "", whole), re.sub("[^0-9]", "", cents)
        money = "$" in text and len(cents) in (3, 5)
        digits = whole + cents[:3] + ("." + cents[3:5] if len(cents) == 5 else "") if money else f"{whole}.{cents[:2]}"
    try:
        return float(digits)
    except ValueError:
        return None


def test_amounts_are_read_as_before(spark):
    """F16: the short ways and the general one give the same values."""
    texts = ["$ 1.234,56", "$1.23456", "$12345.000", "10,00", "1,234", "$ 7", "7", "$1,2,3", "1.", ".5", "$.50000", "-5,00", "$ -5,000", "a1,5", "1 000,50", "$  2,50", "1..2", "", "$", "1.234.567,8", "$1.2345678", "12,345 "]
    assert values(spark, texts, A.parse_amount) == [*map(read_amount, texts), None]


def test_a_line_is_searched_once_for_each_list(spark):
    """the lists of words were searched again for each class of lines."""
    assert optimized(QUERIES["line_classes"](spark, "/root/testdata/sf0.001")).count("whatsapp") == 1


def test_ends_are_trimmed_as_by_the_patterns(spark):
    """short ways for lines without marks or white space at the ends."""
    both = values(spark, ODD, L.squeeze_ends), values(spark, ODD, lambda t: F.regexp_replace(t, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    assert both[0] == both[1]
    controls = "".join(map(chr, range(33)))
    assert values(spark, ODD, X.trim_controls) == [*(t.strip(controls) for t in ODD), None]
    assert values(spark, ODD, X.is_blank) == values(spark, ODD, lambda t: t.rlike(X.BLANK))


def test_a_brand_is_searched_once(spark):
    """each mention of the alias found searched the catalog again."""
    assert str(known_brand(F.col("t"), brand_aliases())).count("filter(") == 1

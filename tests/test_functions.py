"""Scalar functions, as tables of input and expected value."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillscan.functions import amounts as A
from tillscan.functions import dates as T
from tillscan.functions import lines as L
from tillscan.functions import text as X


def values(spark, f, inputs):
    rows = [(i, x) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, x string").repartition(2)
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def check(spark, f, table):
    assert values(spark, f, [a for a, _ in table]) == [b for _, b in table]


def test_normal_forms(spark):
    check(spark, X.norm, [
        ("Ñandú ÁÉ/1.5\t x", "nandu ae/1 5 x"), ("café", "cafe"), ("--", ""), ("", ""), (None, None),
        ("İSTANBUL straße", "istanbul stra e"), ("Ｆ１ ½", ""),
    ])
    check(spark, X.dict_norm, [("a/b  C", "a b c"), (None, ""), ("'S", "s")])
    check(spark, lambda c: X.compact(X.dict_norm(c)), [("la  Pau-lina", "lapaulina")])


def test_cleaning(spark):
    check(spark, X.clean_noise, [('a|b"c`d', "aIb c d"), ("\t x \x01", "x"), ("", "")])
    check(spark, X.title_case, [("HELLO wORLD  x", "Hello World X"), ("ñu", "Ñu"), ("", "")])
    check(spark, X.beautify, [
        ("PITUSAS GALLET*300GR (21)", "Pitusas Gallet 300gr"), ("JABONX3*3UN", "Jabon X3 3un"),
        ("§AL €_°", "Sal C O"), ("CREMA 21", "Crema"), ("PACK X21", "Pack X21"),
    ])
    check(spark, X.clean_brand, [(None, ""), ("  a   b ", "a b")])
    check(spark, X.specs, [("Galletitas X300GR 4un n21x", "x300gr 4un"), ("nada", "")])
    check(spark, X.letters, [("ñ1 a-b", 3), ("", 0)])


def test_amounts_found(spark):
    check(spark, A.amounts, [
        ("1.0000x", []), ("$1.0000", ["$1"]), ("a $ 1.572,50 $1.850", ["$ 1.572,50", "$1.850"]),
        ("$11.47080 8", ["$11.47080"]), ("$5.082,15$5.979", ["$5.082,15", "$5.979"]), ("2400,00", ["2400,00"]),
        ("12", []), ("3097,50 1200,00", ["3097,50", "1200,00"]),
    ])


def test_amounts_read(spark):
    check(spark, A.parse_amount, [
        ("$ 1.572,50", 1572.5), ("$3.849", 3849.0), ("$11.47080", 11470.8), ("2,999", 2.99), ("$999", 999.0),
        ("10.500,00", 10500.0), ("$\t5", 5.0), ("", None), (None, None), ("1.234.567,89", 1234567.89),
    ])


def test_amounts_written(spark):
    df = spark.createDataFrame([(0.125,), (1.005,), (0.005,), (104997.88,), (-1.5,)], "x double")
    got = [r.v for r in df.select(A.format_amount(F.col("x")).alias("v")).collect()]
    assert got == ["0,12", "1,00", "0,01", "104997,88", "-1,50"]


def test_quantities(spark):
    check(spark, A.quantity, [
        ("JABON X3*3UN", 3), ("JABONX3*3UN", 1), ("SAL X500GR", 1), ("2 x 10,50 pan", 2), ("", 1),
        ("99999999999 x 1,00", 1),
    ])
    check(spark, A.app_quantity, [("Papas 2x", "2"), ("1kg 0.9 kg", "0.9"), ("1,5 KG pan", "1.5"), ("15% OFF", None)])
    check(spark, A.parse_quantity, [("0.9", 0.9), ("1,5", 1.5), ("x", 1.0), (None, 1.0)])


def test_zero_quantity_has_no_unit_price(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 2.0)], "t double, q double")
    assert [r[0] for r in df.select(A.unit_price(F.col("t"), F.col("q"))).collect()] == [None, 2.5]


def test_dates(spark):
    check(spark, lambda c: T.find_date(c, 2026), [
        ("FECHA 31/02/2026", None), ("Fecha 4/3/2014", None), ("Fecha O4/O3/26", "04/03/26"), ("Fecha 04/03", "04/03"),
        ("FECHA:13/06/202611:56", "13/06/2026"), ("1 / 2 - 2020 x", "1/2-2020"), ("99/99/2020 y 1/1/2020", "1/1/2020"),
        ("01|02|2020", "01/02/2020"), ("sin", None), (None, None),
    ])
    check(spark, lambda c: T.normalize_date(c, 2026), [
        ("04/03/26", "4/3/2026"), ("4-3", "4/3/2026"), ("x", "x"), ("", ""), (None, ""), ("31/02/2026", "31/02/2026"),
    ])
    check(spark, lambda c: T.is_date_label(X.norm(c)), [("FECHA: 1", True), ("Fecha Inicio", False), ("hora", False)])


def test_line_predicates(spark):
    check(spark, lambda c: L.is_skipped(X.norm(c)), [
        ("V:1.01", True), ("v 3", True), ("ACEITE OLIVA 900ML 100,00", True), ("TOTAL", True), ("pan", False), ("--", True),
    ])
    check(spark, lambda c: L.is_description(c, X.norm(c)), [("PAN 100,00", False), ("PANES 100,00", True), ("2700,00", False), ("Subtotal", False)])
    check(spark, lambda c: L.is_product(c, X.norm(c)), [("Descuento x", False), ("LEY 27.743", False), ("LE Y27743 x", False), ("LE 27 x", True), ("ab", False), ("pan", True)])
    check(spark, lambda c: L.is_app_product(c, X.norm(c)), [("15% OFF", False), ("Café", False), ("Cafés ricos", True), ("1kg 0.9 kg", False)])
    check(spark, L.is_ocr_item, [("pan 10,50 kg", True), ("total 10,50", False), ("pan 10", False), ("  a1, ", False)])
    check(spark, A.is_price_only, [("2700,00", True), ("$2700,00", False), ("1.234,56", True), ("x 1,00", False)])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_folding_agrees_with_unicode(spark, texts):
    clean = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t) and t.isascii() or all(ord(c) < 0x250 for c in t)]
    if clean:
        assert values(spark, X.norm, clean) == [X.py_norm(t) for t in clean]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=30))
def test_writing_then_reading_an_amount_is_stable(spark, cents):
    df = spark.createDataFrame([(c / 100,) for c in cents], "x double")
    back = A.parse_amount(A.format_amount(F.col("x")))
    assert [r[0] for r in df.select(back).collect()] == pytest.approx([c / 100 for c in cents])

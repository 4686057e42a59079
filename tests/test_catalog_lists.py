"""catalogs beyond one list, and receipts that meet a table of brands."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tillscan.operators import containment as C
from tillscan.operators.items import receipt_items
from tillscan.sinks import writers as W
from tillscan.sources import dictionaries as S
from tillscan.sources.files import read_files


def test_a_large_catalog_is_several_lists_in_one_order(spark, tmp_path, monkeypatch):
    """It was one value, which one task wrote and one task read."""
    monkeypatch.setattr(W, "LIST_NAMES", 3)
    names = [f"Marca {c}" for c in "jBhDfFbaIC"] + ["-", "Marca a"]
    W.write_catalog(spark.createDataFrame([(n,) for n in names], "brand string"), str(tmp_path))
    files = sorted((r.path, json.loads(r.content)) for r in read_files(spark, str(tmp_path)).collect())
    whole = [n for _, own in files for n in own]
    assert len(files) > 1 and whole == sorted(names, key=lambda n: (n.lower(), n))
    got = [tuple(r) for r in S.read_brands(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [(i, n) for i, n in enumerate(whole) if n != "-" and n not in whole[:i]]


def test_receipts_are_read_once_for_a_table_of_brands(spark, monkeypatch):
    """They were parsed three times; frequent and rare descriptions, with a brand and without, in both layouts."""
    monkeypatch.setattr(C, "HOT_ROWS", 2)
    monkeypatch.setattr(C, "HOT_SHARE", 6)
    seen = spark.sparkContext.accumulator(0)

    def look(text):
        seen.add(1)
        return text

    texts = ["TIENDA UNO\nSancor Leche 10,00", "PedidosYa Market\nPan con Sancor\n$ 10,00", "TIENDA UNO\nNada Nuevo 3,00", "PedidosYa Market\nNada Nuevo\n$ 3,00", "", None]
    rows = [(i, texts[0 if i < 9 else i % 6]) for i in range(24)]
    receipts = spark.createDataFrame(rows, "receipt_id int, raw_text string")
    wanted = sorted(map(str, receipt_items(receipts, 2026).collect()))
    looked = receipts.select("receipt_id", F.udf(look)("raw_text").alias("raw_text"))
    assert sorted(map(str, receipt_items(looked, 2026, aliases=S.brand_alias_table(spark)).collect())) == wanted
    assert seen.value == 24

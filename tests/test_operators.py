"""Brands, exports, OCR, sources, sinks and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tillscan import dictionaries as D
from tillscan.functions.text import title_case
from tillscan.operators import brands as B
from tillscan.operators import ocr as O
from tillscan.operators.export import escape
from tillscan.operators.lines import receipt_lines, split_lines
from tillscan.sinks.writers import write_catalog, write_exports
from tillscan.sources import dictionaries as S
from tillscan.sources import receipts as R
from tillscan.streaming.receipts import item_stream, text_stream, write_responses


def column(spark, expr, *values):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a string, b string, c string")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_lines(spark):
    df = spark.createDataFrame([(1, " a \r\n\r\n\tb\rc\n   \n\x01\n d"), (2, None), (3, "")], "receipt_id int, raw_text string")
    got = [tuple(r) for r in receipt_lines(df).select("receipt_id", "line_no", "line").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d")]
    assert df.select(F.size(split_lines(F.col("raw_text")))).collect()[1][0] == 0


def test_remove_brand(spark):
    expr = B.remove_brand(F.col("a"), F.col("b"), F.col("c"))
    table = [
        ("Red Widget", "Red Widget", "red widget", "Red Widget"),
        ("Small Ring", "Small", "small", "Ring"),
        ("Nisinsal X500gr", "Nisin", "nisin", "Nisinsal X500gr"),
        ("Par Nor Galletas", "Parnor", "parnor", "Galletas"),
        ("Lux Luxjabon 3un", "Lux", "lux", "jabon 3un"),
        ("La Paulina Rallado", "La Paulina", "la paulina", "Rallado"),
        ("Queso La Paulina", "La Paulina", "la paulina", "Queso La Paulina"),
        ("Anything", "Sin marca", "any", "Anything"),
        ("Anything", "Generico", "", "Anything"),
    ]
    assert column(spark, expr, *[t[:3] for t in table]) == [t[3] for t in table]


def test_known_brands(spark):
    aliases = S.brand_aliases()
    start = B.known_brand(F.col("a"), aliases)["brand"]
    inside = B.known_brand(F.col("a"), aliases, anywhere=True)["brand"]
    texts = ["LA PROVIDECIA *505GR", "UNION SALCHICH", "Luxor cosas", "Papas Mc Cain Finas", "nada"]
    rows = [(t, "", "") for t in texts]
    assert column(spark, start, *rows) == ["La Providencia", "Unión Ganadera", "Lux", None, None]
    assert column(spark, inside, *rows)[3:] == ["McCain", None]


def test_join_and_literals_agree(spark):
    texts = [(i, t) for i, t in enumerate(["Lucchetti Fideos", "la  paulina x", "Agua Loma", "zz Don Satur", "Mani", "", "x"])]
    df = spark.createDataFrame(texts, "i int, t string")
    aliases = S.brand_aliases()
    for anywhere in (False, True):
        joined = {(r.i, r.brand, r.alias) for r in B.match_brands(df, S.brand_alias_table(spark), "t", ["i"], anywhere).collect()}
        lit = df.select("i", B.known_brand(F.col("t"), aliases, anywhere).alias("b")).filter("b is not null")
        assert joined == {(r.i, r.b.brand, r.b.alias) for r in lit.collect()} and joined


def test_fallback_brand(spark):
    expr = B.fallback_brand(title_case(F.col("a")))["brand"]
    assert column(spark, expr, ("red widget", "", ""), ("small ring", "", ""), ("pan", "", ""), ("", "", "")) == ["Red Widget", "Small", "Pan", ""]


def test_learning(spark):
    rows = [(2, "Acme"), (1, "ACME"), (3, "Bolsa"), (4, "X9z"), (5, "ab"), (6, "sancor"), (7, "Seshia Uno"), (8, " Ñandú  Sur ")]
    learned = B.learned_brands(spark.createDataFrame(rows, "n int, brand string"), spark.createDataFrame([(0, "Sancor")], "pos int, brand string"), ["n"])
    assert sorted(map(tuple, learned.collect())) == [("acme", "ACME"), ("nandu sur", "Ñandú Sur")]


def test_catalog_files(spark, tmp_path):
    known = spark.createDataFrame([(0, "beta"), (1, "Alfa")], "pos int, brand string")
    learned = spark.createDataFrame([("gama", "alba")], "norm string, brand string")
    write_catalog(B.merged_catalog(known, learned), str(tmp_path / "brands"))
    again = S.read_brands(spark, str(tmp_path / "brands"))
    assert [r.brand for r in again.orderBy("pos").collect()] == ["alba", "Alfa", "beta"]
    (tmp_path / "b.json").write_text(json.dumps([" a  b ", "-", "", "c"]))
    assert [tuple(r) for r in S.read_brands(spark, str(tmp_path / "b.json")).collect()] == [(0, "a b"), (3, "c")]
    (tmp_path / "s.json").write_text('{"Kiosco Ñ": "K1", "otro": "O", "kiosco n": "K2"}')
    stores = S.read_stores(spark, str(tmp_path / "s.json")).orderBy("pos").collect()
    assert [(r.pos, r.alias, r.store) for r in stores] == [(0, "kiosco n", "K2"), (1, "otro", "O")]


def test_dictionaries_beyond_the_literals_are_joined():
    aliases = S.brand_aliases([f"brand {i}" for i in range(S.MAX_ENTRIES + 1)])
    assert len(aliases) > S.MAX_ENTRIES and S.joined(aliases) and not S.joined(S.brand_aliases())


def test_export_escape(spark):
    rows = [('a"b', "", ""), ("a|b", "", ""), ("a\tb", "", ""), ("a\nb", "", ""), ("a\rb", "", ""), (None, "", "")]
    assert column(spark, escape(F.col("a"), "|"), *rows) == ['"a""b"', '"a|b"', "a\tb", '"a\nb"', "a\rb", ""]
    assert column(spark, escape(F.col("a"), "\t"), *rows)[1:3] == ["a|b", '"a\tb"']


def boxes(spark, rows):
    cols = "receipt_id int, page int, variant_pos int, box_no int, text string, score double, top double, left double, height double"
    return spark.createDataFrame([(1, 0, 0, i, *r) for i, r in enumerate(rows)], cols)


def test_box_rows(spark):
    # Centres 10, 28 (gap 18: the same row, centre 19), 38 (gap 19: another row).
    rows = [("b", 0.9, 0.0, 50.0, 20.0), ("a", 0.8, 18.0, 10.0, 20.0), ("c", 0.7, 28.0, 0.0, 20.0)]
    got = [tuple(r)[3:] for r in O.box_rows(boxes(spark, rows)).orderBy("line_no").collect()]
    assert got == [(0, "a b", 0.8, 0.0, 10.0), (1, "c", 0.7, 28.0, 0.0)]


def test_box_rows_with_tall_boxes(spark):
    rows = [("x", 1.0, 0.0, 0.0, 100.0), ("y", 1.0, 30.0, 5.0, 100.0), ("z", 1.0, 200.0, 1.0, 10.0)]
    assert [r.text for r in O.box_rows(boxes(spark, rows)).orderBy("line_no").collect()] == ["x y", "z"]


def test_raw_results(spark):
    result = json.dumps([None, [[[[0, 0], [9, 0], [9, 5], [0, 5]], ["hola", 0.5]], [[[1, 1]], "solo"], [[[1, 1]], ["  ", 1]], [[[2, 2]]], [[[3, 4]], ["mal", "x"]]]])
    df = spark.createDataFrame([(1, 0, 0, result), (2, 0, 0, None), (3, 0, 0, "[]")], "receipt_id int, page int, variant_pos int, result string")
    got = [tuple(r)[4:] for r in O.boxes(df).orderBy("box_no").collect()]
    assert got == [("hola", 0.5, 0.0, 0.0, 5.0), ("solo", 0.0, 1.0, 1.0, 1.0), ("mal", 0.0, 4.0, 3.0, 1.0)]


def test_best_variant_is_the_first_of_equals(spark):
    rows = [(1, 0, 0, 5.0), (1, 0, 1, 7.0), (1, 0, 2, 7.0), (2, 0, 0, -1.0)]
    df = spark.createDataFrame(rows, "receipt_id int, page int, variant_pos int, score double")
    assert [tuple(r) for r in O.best_variant(df).collect()] == [(1, 0, 1, 7.0)]


def test_scores(spark):
    lines = [(1, 0, 0, "Fecha 1"), (1, 0, 0, "PAPEL 10,50 xx"), (2, 0, 0, None)]
    df = spark.createDataFrame(lines, "receipt_id int, page int, variant_pos int, text string")
    got = {r.receipt_id: r.score for r in O.score_texts(df).collect()}
    assert got[1] == pytest.approx(8 + 21 / 30 + 8 + 10 + 6 + 8 + 14) and got[2] == -1


def test_uploads_and_texts(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF")
    (tmp_path / "b.png").write_bytes(b"")
    (tmp_path / "c.jpeg").write_bytes(b"x")
    got = {r.path.rsplit("/")[-1]: (r.kind, r.message) for r in R.read_uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.PDF": ("pdf", None), "b.png": ("image", D.EMPTY_UPLOAD_MESSAGE), "c.jpeg": ("image", None)}
    empty = spark.createDataFrame([("b.png", 0, b"")], "path string, length long, content binary")
    assert R.uploads(empty).first().message == D.EMPTY_UPLOAD_MESSAGE
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "r.txt").write_text("uno\ndos\n")
    assert R.read_texts(spark, str(tmp_path / "t")).first().raw_text == "uno\ndos\n"


def test_replies(spark):
    rows = [(1, '{"text": "hola"}'), (2, '{"error": "x", "text": "y"}'), (3, '{"text": " "}'), (4, "broken"), (5, '{"error": " ", "text": "z"}')]
    out = R.decode_replies(spark.createDataFrame(rows, "receipt_id int, reply string"))
    got = {r.receipt_id: (r.text, r.message) for r in out.collect()}
    assert got[1] == ("hola", None) and got[5] == ("z", None)
    assert got[2] == (None, "PaddleOCR fallo: x") and got[3] == got[4] == (None, D.EMPTY_TEXT_MESSAGE)
    assert R.rejects(out).count() == 3


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text(f"Almacen Sol\nFecha 0{i + 1}/02/2026\nACME PAN {i + 1}0,00")
    stream = text_stream(spark, str(tmp_path / "in"), files_per_batch=2)
    out = str(tmp_path / "out")
    q = write_responses(stream, 2026, str(tmp_path / "ck"), lambda df, n: write_exports(df, f"{out}/{n}"))
    q.awaitTermination(60)
    rows = spark.read.parquet(f"{out}/*").collect()
    assert len(rows) == 3 and all("Pan|Acme|Almacen Sol|Supermercado|1" in r.csv for r in rows)
    items = (
        item_stream(stream, 2026).writeStream.format("memory").queryName("items")
        .option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    )
    items.awaitTermination(60)
    assert spark.table("items").count() == 3

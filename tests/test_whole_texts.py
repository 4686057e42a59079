"""What is asked of a receipt's whole text at once is what each of its lines would answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillscan.functions.text import clean_noise, norm
from tillscan.operators.header import headed
from tillscan.operators.items import candidate_lines
from tillscan.operators.lines import is_tidy

TEXTS = [
    None, "", "\n", "a", "TIENDA SUR\nFecha 01/02/2024\nLECHE X2 120,50\nTOTAL 1,00", "uno \n dos", "uno\n\ndos", "a\r\nb\rc",
    "---\nÁzúcar 3,20\n---", "|mani| 2,00\nsal", 'café "x"\n`y`', "a\x85\nb", "x y\n \nz", "　\nq", "a\tb\n c", "İx\nΣ",
    "Fecha inicio 03/04/2023\nfecha\n05/06/2024", "x\xady 1,00\nFECHA 1/1/2010\nFecha 02/03/2021", "v 1\n \x1c\nPan  lactal",
]


def test_lines_as_each_of_them_alone(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "receipt_id long, raw_text string")
    own = lambda f, c: F.transform(c, lambda x: f(x))
    out = headed(df, 2026).select(
        "receipt_id", "raw_text", "lines", "cleans", "clean_norms", "date_text",
        own(clean_noise, "lines").alias("own_cleans"), own(norm, "cleans").alias("own_norms"), is_tidy(F.col("raw_text")).alias("tidy"),
    )
    rows = {r.receipt_id: r for r in out.collect()}
    assert len(rows) == len(TEXTS)
    for r in rows.values():
        assert r.cleans == r.own_cleans and r.clean_norms == r.own_norms, r.raw_text
    assert rows[4].tidy and rows[4].lines == TEXTS[4].split("\n") and rows[4].date_text == "1/2/2024"
    assert [rows[i].lines for i in (0, 1, 2, 5, 6, 7)] == [[], [], [], ["uno", "dos"], ["uno", "dos"], ["a", "b", "c"]]
    assert rows[16].date_text == "5/6/2024" and rows[17].date_text == "2/3/2021"
    assert not any(rows[i].tidy for i in (0, 1, 2, 5, 6, 7, 11, 12, 13, 14, 18))


def test_only_the_apps_lines_carry_those_ahead(spark):
    df = spark.createDataFrame([(1, "Tienda\nPan 1,00\nSal 2,00"), (2, "PedidosYa\nPan\n$ 1,00\n2x")], "receipt_id long, raw_text string")
    got = {(r.receipt_id, r.line_no): (r.a1, r.a2) for r in candidate_lines(df, 2026).collect()}
    assert {v for k, v in got.items() if k[0] == 1} == {(None, None)}
    assert got[2, 1] == ("$ 1,00", "2x")

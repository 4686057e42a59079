"""Dictionaries from files, plans that run nothing while they are built, images."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscan import dictionaries as D
from tillscan.operators import brands as B
from tillscan.operators import images as I
from tillscan.plans import rendered as R
from tillscan.plans.parse import parse
from tillscan.sources import dictionaries as S

SF = "/root/testdata/sf0.001"


def written(path, value):
    path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_built_in_catalog_from_a_file_is_the_same(spark, tmp_path):
    path = written(tmp_path / "brands.json", [*D.BRANDS, D.BRANDS[0], "  ", "-"])
    loaded = S.load_brands(spark, path)
    assert [a[2:] for a in loaded] == [a[2:] for a in S.brand_aliases()]
    stores = written(tmp_path / "stores.json", dict(D.STORES))
    assert [(a.compact, a.store) for a in S.load_stores(spark, stores)] == [(a.compact, a.store) for a in S.store_aliases()]


def test_a_table_gives_what_literals_give(spark, tmp_path, monkeypatch):
    path = written(tmp_path / "brands.json", ["Union Ganadera", "La Providencia", "Don'Vito", "Casa del Sol", "Sol", "!!!"])
    literals = S.load_brands(spark, path)
    with monkeypatch.context() as small:
        small.setattr(S, "MAX_ENTRIES", 2)
        table = S.load_brands(spark, path)
    assert isinstance(literals, list) and isinstance(table, DataFrame)
    texts = ["UNION PAN 10,00", "LA PROVIDECIA QUESO 20,00", "DONVITO FIDEO 30,00", "CASADESOL ARROZ 5,00", "SOLITARIO VINO 7,00", "RARO WIDGET 8,00"]
    app = ["PedidosYa Market", "Queso La Providedcia", "$ 20,00", "Vino Casa De Sol", "$ 7,00", "Nada Conocido", "$ 1,00"]
    receipts = spark.createDataFrame([(1, "\n".join(texts)), (2, "\n".join(app)), (3, "")], "receipt_id long, raw_text string")
    seen = [
        {r.receipt_id: [(i.descripcion, i.marca) for i in r["items"]] for r in parse(receipts, 2026, aliases=a).collect()} for a in (literals, table)
    ]
    assert seen[0] == seen[1] and len(seen[0][1]) == 6 and len(seen[0][2]) == 3


def test_an_alias_without_letters_matches_last(spark):
    rows = [(0, 0, "Empty", "", ""), (1, 0, "Sol", "sol", "sol")]
    aliases = [S.Alias(*r) for r in sorted(rows, key=lambda r: -len(r[4]))]
    table = spark.createDataFrame(rows, "pos int, alias_pos int, brand string, norm string, compact string")
    df = spark.createDataFrame([(1, "Sol pan"), (2, "Luna pan"), (3, "")], "k int, t string")
    for anywhere in (False, True):
        joined = {r.k: r.brand for r in B.match_brands(df, table, "t", ["k"], anywhere).collect()}
        literal = {r.k: r.b for r in df.select("k", B.known_brand(F.col("t"), aliases, anywhere)["brand"].alias("b")).collect()}
        assert joined == literal == {1: "Sol", 2: "Empty", 3: "Empty"}


def test_building_a_query_runs_nothing(spark, monkeypatch):
    known = {}

    def table(spark, sf_dir, name):
        return known[name]

    for name in ("part", "lineitem", "customer", "nation", "region", "orders"):
        known[name] = spark.read.parquet(f"{SF}/{name}.parquet")
    monkeypatch.setattr(R, "table", table)
    spark.sparkContext.setJobGroup("building", "plans only")
    for render in (R.one_line, R.two_lines, R.app_lines, R.app_inline):
        parse(render(spark, SF), R.AS_OF, with_text=False)
    R.bare(spark, SF, F.array(F.lit("a")))
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_images(spark):
    draw = np.random.default_rng(1)
    gray = draw.integers(0, 256, (7, 5)).astype(np.uint8)
    assert I.prepared(gray).shape == (39, 37) and I.prepared(gray)[0, 0] == 255
    assert I.prepared(np.array([[0, 100, 250]], np.uint8))[16, 16:19].tolist() == [14, 142, 255]
    assert I.rotated(180)(gray).tolist() == gray[::-1, ::-1].tolist()
    wide = np.pad(gray, 1, mode="edge")
    want = [[sorted(wide[y : y + 3, x : x + 3].ravel())[4] for x in range(5)] for y in range(7)]
    assert I.median3(gray).tolist() == want
    assert I.crop_box(np.full((100, 100), 9, np.uint8)) == (0, 0, 100, 100)
    rows = [(1, 5, 7, gray.tobytes()), (2, 5, 7, b"short"), (3, None, 7, None), (4, 0, 0, b"")]
    df = spark.createDataFrame(rows, "k int, width int, height int, pixels binary")
    out = {r.k: r for r in I.transform_images(df, I.cropped, I.median3, I.prepared).collect()}
    assert (out[1].width, out[1].height, len(out[1].pixels)) == (37, 39, 37 * 39)
    assert out[2].pixels is None and out[3].pixels is None and len(out[4].pixels) == 32 * 32
    assert I.transform_images(df.limit(0), I.prepared).count() == 0


@pytest.mark.parametrize(("size", "want"), [((10, 20), (10, 20)), ((4400, 10), (2200, 5)), ((1, 9000), (1, 2200))])
def test_sizes(spark, size, want):
    w, h = I.limited_size(F.lit(size[0]), F.lit(size[1]))
    assert tuple(spark.range(1).select(w.cast("int"), h.cast("int")).first()) == want

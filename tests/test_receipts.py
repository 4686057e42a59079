"""Whole receipts of every known shape, written for this test."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tillscan import dictionaries as D
from tillscan.operators.export import to_response_json
from tillscan.operators.items import ITEM_COLUMNS, receipt_items
from tillscan.plans.parse import parse
from tillscan.sources.dictionaries import brand_aliases, product_rules, store_aliases

AS_OF = 2026

RECEIPTS = {
    "plain": """SUPERMERCADO
LOS TRES CORAZONES
Fecha 09/05/2026 Hora 10:00:01
AYUDIN LAVAN*750ML 1800,50
DOVE JABON X2*2UN 3000,00
TOTAL 4800,50""",
    "split": """Zou Wenguo
IVA RESPONSABLE INSCRIPTO
Fecha 1/12/2025
SANCOR MANTECA*200GR
2.100,00
HILERET AZUCAR*1KG (21)
1500,00
Subtotal
3600,00
Vuelto
400,00
ONSUMIDORLEY27.743
V:2.10""",
    "cheese": """ZOU WENGUC
Fecha 02/06/2026
0,3100 x 9000,00 PUNTA DE AGUA CR*1UN 2790,00 900,00""",
    "dates": """KIOSCO DEL PUERTO
Inicio de Actividades: 03/04/2001
Fecha
15/08/25 12:30
NIVEA CREMA*50ML 99,90""",
    "currency": """TIENDA FILIPA S.R.L.
FECHA:20/01/202609:15
CUMANA MIX DE SEMILLAS DE 1.0000 $3.000.00 $2.500.00
1.000x$70,00 LA FRANCIA.PAN MULTICEREA $4.100.00
MUCHAS GRACIAS!""",
    "app": """PedidosYa Market - Palermo
Cambio de peso
Zanahoria fresca
$ 500,10
10% OFF
1kg 0.5 kg
Leche La Serenisima Larga Vida 1 L
$ 2.400,00 $2.900
3x
Harina Morixe 000 1 kg
$ 1.111
1x""",
    "inline": """Pedidos Ya Market - Centro
Zanahoria fresca $500.10 1g0.5 kg
12%OFF
Leche La Serenisima 1 L $2.400,00 $2.900 3x
$11.47080 8 Papas Mc Cain Finas 700 g 2x""",
    "noise": """
\t
|Tienda Uno|
ACEITE OLIVA 900ML 100,00
PRECIO UNIT 120,00
Red Widget 10,00
Small Ring 20,00
Fecha 31/02/2026""",
    "empty": "",
}

ITEMS = {
    "plain": [("Lavan 750ml", "Ayudin", "1", "1800,50"), ("Jabon x2 2un", "Dove", "2", "1500,00")],
    "split": [("Manteca 200gr", "Sancor", "1", "2100,00"), ("Azucar 1kg", "Hileret", "1", "1500,00")],
    "cheese": [("Queso cremoso 1un", "Punta del agua", "1", "2790,00")],
    "dates": [("Crema 50ml", "Nivea", "1", "99,90")],
    "currency": [("Mix de semillas", "Cumana", "1", "2500,00"), ("Pan multicereal", "La Francia", "1", "4100,00")],
    "app": [
        ("Zanahoria Fresca", "Generico", "0.5", "1000,20"),
        ("Leche 1", "La Serenisima", "3", "800,00"),
        ("Harina 000 1", "Morixe", "1", "1111,00"),
    ],
    "inline": [
        ("Zanahoria Fresca", "Generico", "0.5", "1000,20"),
        ("Leche 1", "La Serenisima", "3", "800,00"),
        ("Papas 700", "McCain", "2", "5735,40"),
    ],
    "noise": [("Unit", "Precio", "1", "120,00"), ("Red Widget", "Red Widget", "1", "10,00"), ("Ring", "Small", "1", "20,00")],
    "empty": [],
}
HEADERS = {
    "plain": ("Los Tres Corazones", "9/5/2026"),
    "split": ("Los Tres Corazones", "1/12/2025"),
    "cheese": ("Los Tres Corazones", "2/6/2026"),
    "dates": ("Kiosco Del Puerto", "15/8/2025"),
    "currency": ("Tienda Filipa", "20/1/2026"),
    "app": ("Pedidosya Market - Palermo", ""),
    "inline": ("Pedidos Ya Market - Centro", ""),
    "noise": ("Itienda unoi", ""),
    "empty": (D.DEFAULT_STORE, ""),
}


@pytest.fixture(scope="module")
def receipts(spark):
    return spark.createDataFrame(list(RECEIPTS.items()), "receipt_id string, raw_text string")


@pytest.fixture(scope="module")
def parsed(receipts):
    return {r.receipt_id: r for r in parse(receipts, AS_OF).collect()}


@pytest.mark.parametrize("name", RECEIPTS)
def test_items(parsed, name):
    got = [(i.descripcion, i.marca, i.cantidad, i.precio_unitario) for i in parsed[name]["items"]]
    assert got == ITEMS[name]
    assert parsed[name].item_count == len(parsed[name]["items"])


@pytest.mark.parametrize("name", [n for n in RECEIPTS if n != "noise"])
def test_header(parsed, name):
    assert (parsed[name].store_name, parsed[name].date) == HEADERS[name]


def test_exports(parsed):
    r = parsed["plain"]
    head = "|".join(D.EXPORT_HEADER)
    rows = ["Lavan 750ml|Ayudin|Los Tres Corazones|Supermercado|1|1800,50|9/5/2026", "Jabon x2 2un|Dove|Los Tres Corazones|Supermercado|2|1500,00|9/5/2026"]
    assert r.csv == "\n".join([head, *rows])
    assert r.tsv_without_header == "\n".join(rows).replace("|", "\t")
    assert parsed["empty"].csv == head and parsed["empty"].tsv_without_header == ""
    assert r.raw_text == RECEIPTS["plain"]


def test_json(spark, receipts):
    out = parse(receipts.filter("receipt_id = 'plain'"), AS_OF)
    (js,) = [json.loads(x.j) for x in out.select(to_response_json(out).alias("j")).collect()]
    assert list(js) == ["storeName", "date", "itemCount", "csv", "tsv", "tsvWithoutHeader", "rawText", "items"]
    assert js["items"][1] == {
        "descripcion": "Jabon x2 2un", "marca": "Dove", "lugarDeCompra": "Los Tres Corazones", "categoria": "Supermercado",
        "cantidad": "2", "precioUnitario": "1500,00", "fecha": "9/5/2026", "precioTotal": "",
    }


def test_same_for_any_partitioning(receipts, parsed):
    again = {r.receipt_id: r for r in parse(receipts.repartition(5).orderBy(F.rand()), AS_OF).collect()}
    assert {k: (v.csv, v.store_name) for k, v in again.items()} == {k: (v.csv, v.store_name) for k, v in parsed.items()}


def test_typed_columns(receipts):
    items = receipt_items(receipts, AS_OF)
    assert tuple(items.columns) == ITEM_COLUMNS
    row = items.filter("receipt_id = 'app' and marca = 'La Serenisima'").first()
    assert (row.quantity, row.total_price, str(row.total_amount), row.unit_price) == (3.0, 2400.0, "2400.00", 800.0)
    assert not row.brand_is_new
    assert items.filter("receipt_id = 'noise' and marca = 'Small'").first().brand_is_new


def test_no_shuffle_between_text_and_items(receipts):
    plan = receipt_items(receipts, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_own_dictionaries(spark):
    df = spark.createDataFrame([(1, "Almacen Central\nACME CLAVOS*5UN 50,00")], "receipt_id int, raw_text string")
    out = parse(
        df, AS_OF, stores=store_aliases([("almacen central", "Central")]),
        aliases=brand_aliases(["Acme"]), rules=product_rules([("Clavos de acero", ["clavo"])]),
    ).first()
    assert out.tsv_without_header == "Clavos de acero 5un\tAcme\tCentral\tSupermercado\t1\t50,00\t"


def test_null_text_is_an_empty_receipt(spark):
    df = spark.createDataFrame([(1, None)], "receipt_id int, raw_text string")
    assert (parse(df, AS_OF).first().item_count, parse(df.limit(0), AS_OF).count()) == (0, 0)

"""The queries over receipts, one for each operator, and the SQL that checks them.

Each query takes (spark, sf_dir) and reads whole tables. The SQL is DuckDB's; where a query
parses rendered receipts, its SQL computes the answer from the source tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscan import dictionaries as D
from tillscan.functions import amounts as A
from tillscan.functions import lines as L
from tillscan.functions import text as X
from tillscan.functions.dates import find_date, normalize_date, parse_date
from tillscan.operators import brands as B
from tillscan.operators import export as E
from tillscan.operators import header as H
from tillscan.operators import ocr as O
from tillscan.operators.items import raw_items, receipt_items
from tillscan.operators.lines import receipt_lines
from tillscan.operators.products import expand_product
from tillscan.plans import rendered as R
from tillscan.plans.parse import parse
from tillscan.sinks.shared import shared_folder
from tillscan.sinks.writers import catalog_json
from tillscan.sources.dictionaries import (
    alias_frame,
    brand_aliases,
    product_rules,
    read_stores,
)
from tillscan.sources.files import write_files
from tillscan.sources.receipts import decode_replies, join_pages, rejects

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _alternation(words) -> str:
    return "|".join(w.replace(".", "\\.") for w in words)


# --- Pieces of SQL --------------------------------------------------------------------------

_ORDER = ", ".join(R.ITEM_ORDER)
#: Items of orders, numbered as the renderer numbers them, with what a parser should find.
_ITEMS = f"""
i AS (
  SELECT l_orderkey, l_quantity::INT AS q, l_extendedprice AS x, p_name,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey
), h AS (
  SELECT o_orderkey, o_orderdate + INTERVAL 20 YEAR AS d, r_name
  FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), t AS (
  SELECT *, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS w1,
    upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS w2
  FROM i JOIN h ON l_orderkey = o_orderkey
), s AS (
  SELECT *,
    CASE WHEN length(w1) <= 3 THEN w1 || ' ' || w2 ELSE w1 END AS brand,
    CASE WHEN length(w1) <= 3 THEN 'X' || q ELSE w2 || ' X' || q END AS descr,
    'Tienda ' || array_to_string(list_transform(string_split(lower(r_name), ' '),
      lambda w: upper(w[1]) || w[2:]), ' ') AS store,
    day(d) || '/' || month(d) || '/' || year(d) AS day_text,
    replace(format('{{:.2f}}', x / q), '.', ',') AS unit_text
  FROM t
)"""
_NORM = "trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9/]+', ' ', 'g'))"
_DICT_NORM = "trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'))"
_LINES = r"""
raw AS (
  SELECT doc_id, unnest(string_split_regex({0}, '\r\n|\r|\n')) AS l,
    unnest(range(len(string_split_regex({0}, '\r\n|\r|\n')))) AS ord
  FROM {1}
), l AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS line_no, line FROM (
    SELECT doc_id, ord, regexp_replace(l, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS line FROM raw)
  WHERE NOT regexp_matches(line, '^[\s\x1c-\x1f]*$')
)"""
_CLEAN = r"""regexp_replace(regexp_replace(translate({0}, '|"`', 'I  '), '\s+', ' ', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"""
_PRICE_ONLY = r"'^\d+([.,]\d{3})*[.,]\d{2}$'"


def _doc_lines(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    docs = R.spread(R.table(spark, sf_dir, name))
    return receipt_lines(docs.select(F.col(key).alias("receipt_id"), F.col(text).alias("raw_text")))


# --- Whole receipts ---------------------------------------------------------------------------

_SHOWN = ("receipt_id", "line_no", "descripcion", "marca", "lugar_de_compra", "categoria", "cantidad", "precio_unitario", "fecha")
_ITEM_SQL = f"""
WITH {_ITEMS}
SELECT l_orderkey AS receipt_id, (2 + {{step}} * k)::INT AS line_no, descr AS descripcion, brand AS marca,
  store AS lugar_de_compra, 'Supermercado' AS categoria, q::VARCHAR AS cantidad,
  unit_text AS precio_unitario, day_text AS fecha
FROM s
"""


@query(_ITEM_SQL.replace("{step}", "1"))
def receipt_items_query(spark, sf_dir):
    """Flagship: S9, N1-N6, P1-P7, X1, X2, X8, M1-M5, D1-D3, B1-B8, J1, J3, J5."""
    return receipt_items(R.one_line(spark, sf_dir), R.AS_OF).select(*_SHOWN)


QUERIES["receipt_items"] = QUERIES.pop("receipt_items_query")
SQL["receipt_items"] = SQL.pop("receipt_items_query")


@query(_ITEM_SQL.replace("{step}", "2"))
def two_line_items(spark, sf_dir):
    """B8's two-line case with look-ahead 1."""
    return receipt_items(R.two_lines(spark, sf_dir), R.AS_OF).select(*_SHOWN)


_APP_SQL = f"""
WITH {_ITEMS}
SELECT l_orderkey AS receipt_id, (1 + {{step}} * k)::INT AS line_no, w1 || ' ' || w2 AS descripcion,
  'Generico' AS marca, 'Supermercado' AS categoria, q::VARCHAR AS cantidad, unit_text AS precio_unitario, '' AS fecha
FROM s
"""
_APP_SHOWN = ("receipt_id", "line_no", "descripcion", "marca", "categoria", "cantidad", "precio_unitario", "fecha")


@query(_APP_SQL.replace("{step}", "3"))
def app_items(spark, sf_dir):
    """P8, X6, X7, J6, J7, J2, B9, B2, M3, M4."""
    return receipt_items(R.app_lines(spark, sf_dir), R.AS_OF).select(*_APP_SHOWN)


@query(_APP_SQL.replace("{step}", "1"))
def app_inline_items(spark, sf_dir):
    """A whole item on a line; the first of two amounts counts."""
    return receipt_items(R.app_inline(spark, sf_dir), R.AS_OF).select(*_APP_SHOWN)


@query(
    f"""
WITH {_ITEMS}, e AS (
  SELECT l_orderkey AS receipt_id, store AS store_name, day_text AS date, count(*) AS item_count,
    string_agg(descr || '|' || brand || '|' || store || '|Supermercado|' || q || '|' || unit_text || '|' || day_text,
      chr(10) ORDER BY k) AS body
  FROM s GROUP BY ALL
)
SELECT receipt_id, store_name, date, item_count::INT AS item_count,
  'Descripción|Marca|Lugar de compra|Categoria|Cantidad|Precio unitario|Fecha' || chr(10) || body AS csv,
  replace('Descripción|Marca|Lugar de compra|Categoria|Cantidad|Precio unitario|Fecha' || chr(10) || body, '|', chr(9)) AS tsv,
  replace(body, '|', chr(9)) AS tsv_without_header
FROM e
"""
)
def receipt_response(spark, sf_dir):
    """One row for each receipt."""
    out = parse(R.one_line(spark, sf_dir), R.AS_OF, with_text=False)
    return out.select("receipt_id", "store_name", "date", "item_count", "csv", "tsv", "tsv_without_header")


@query(
    f"""
WITH {_ITEMS}
SELECT l_orderkey AS receipt_id, store AS store, day_text AS date, count(*)::INT AS items,
  '["' || string_agg(unit_text, '","' ORDER BY k) || '"]' AS prices
FROM s GROUP BY ALL
"""
)
def receipt_json(spark, sf_dir):
    """K6: the response as JSON, read back."""
    out = parse(R.one_line(spark, sf_dir), R.AS_OF)
    js = out.select("receipt_id", E.to_response_json(out).alias("j"))
    return js.select(
        "receipt_id",
        F.get_json_object("j", "$.storeName").alias("store"),
        F.get_json_object("j", "$.date").alias("date"),
        F.get_json_object("j", "$.itemCount").cast("int").alias("items"),
        F.get_json_object("j", "$.items[*].precioUnitario").alias("prices"),
    ).withColumn("prices", F.when(F.col("prices").startswith("["), F.col("prices")).otherwise(F.concat(F.lit("["), F.col("prices"), F.lit("]"))))


@query(
    """
SELECT o_orderkey AS receipt_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE (o_orderkey % 3)::INT END AS item_count,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE 'AB' END AS firsts
FROM orders
"""
)
def item_count(spark, sf_dir):
    """A1, K3: receipts without items count 0 and export nothing."""
    key = F.col("o_orderkey") % 3
    lines = F.when(key == 0, F.array(F.lit("Gracias"), F.lit("TOTAL 1,00"))).when(
        key == 1, F.array(F.lit("Alpha Widget 10,00"))
    ).otherwise(F.array(F.lit("Alpha Widget 10,00"), F.lit("Bravo Widget 20,00")))
    out = parse(R.bare(spark, sf_dir, lines), R.AS_OF, with_text=False)
    firsts = F.array_join(F.transform("items", lambda i: F.substring(i["marca"], 1, 1)), "")
    return out.select(
        "receipt_id", "item_count",
        F.when(F.col("tsv_without_header") == "", "").otherwise(firsts).alias("firsts"),
    )


@query(
    f"""
WITH {_ITEMS}
SELECT store AS store_name, brand AS marca, month(d)::INT AS month, count(*) AS items, sum(x::DECIMAL(18,2))::DECIMAL(28,2) AS spent
FROM s GROUP BY ALL
"""
)
def spend_by_store_brand_month(spark, sf_dir):
    """An addition: analytics over parsed items."""
    items = receipt_items(R.one_line(spark, sf_dir), R.AS_OF)
    return items.groupBy(
        F.col("lugar_de_compra").alias("store_name"), "marca", F.month("date").alias("month")
    ).agg(F.count("*").alias("items"), F.sum("total_amount").cast("decimal(28,2)").alias("spent"))


# --- Lines and text -----------------------------------------------------------------------------


@query(f"WITH {_LINES.format('text', 'documents')} SELECT doc_id, line_no::INT AS line_no, line FROM l")
def line_split(spark, sf_dir):
    """S9"""
    lines = _doc_lines(spark, sf_dir)
    return lines.select(F.col("receipt_id").alias("doc_id"), "line_no", "line")


@query(f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def normalize_text(spark, sf_dir):
    """N1"""
    return R.spread(R.table(spark, sf_dir, "documents")).select("doc_id", X.norm(F.col("text")).alias("norm"))


@query(
    f"""SELECT conv_id, turn, {_DICT_NORM.format('text')} AS norm, replace({_DICT_NORM.format('text')}, ' ', '') AS compact
FROM conversations"""
)
def compact_text(spark, sf_dir):
    """N2, N3"""
    rows = R.spread(R.table(spark, sf_dir, "conversations"))
    n = X.dict_norm(F.col("text"))
    return rows.select("conv_id", "turn", n.alias("norm"), X.compact(n).alias("compact"))


@query(f"SELECT page_id, {_CLEAN.format('html')} AS clean FROM pages")
def clean_noise(spark, sf_dir):
    """N4"""
    return R.spread(R.table(spark, sf_dir, "pages")).select("page_id", X.clean_noise(F.col("html")).alias("clean"))


@query(
    """
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title
FROM part
"""
)
def title_case(spark, sf_dir):
    """N5"""
    return R.spread(R.table(spark, sf_dir, "part")).select("p_partkey", X.title_case(F.upper("p_name")).alias("title"))


@query(
    """
SELECT p_partkey, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' ||
  upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || ' X' || p_size || 'un C' AS shown
FROM part
"""
)
def beautify(spark, sf_dir):
    """Symbols, a glued size and a trailing tax rate."""
    raw = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("*"))), F.lit("x"), F.col("p_size"), F.lit('UN_."€  (21) '))
    return R.spread(R.table(spark, sf_dir, "part")).select("p_partkey", X.beautify(raw).alias("shown"))


@query("SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g'))::INT AS letters FROM documents")
def letter_count(spark, sf_dir):
    """N11"""
    return R.spread(R.table(spark, sf_dir, "documents")).select("doc_id", X.letters(F.col("text")).alias("letters"))


@query(
    """
SELECT p_partkey, lower('x' || p_size || 'un ' || (p_size + 3) || 'KG ' || p_partkey) AS specs FROM part
"""
)
def product_specs(spark, sf_dir):
    """N10"""
    text = F.concat_ws(
        " ", "p_name", F.concat(F.lit("X"), F.col("p_size"), F.lit("UN")),
        F.concat(F.col("p_size") + 3, F.lit("KG")), F.col("p_partkey").cast("string"), F.lit("a1 x"),
    )
    return R.spread(R.table(spark, sf_dir, "part")).select("p_partkey", X.specs(text).alias("specs"))


_META, _STOP = _alternation(D.METADATA_WORDS), _alternation(D.STOP_WORDS)


@query(
    f"""
WITH {_LINES.format('text', 'documents')}, n AS (
  SELECT doc_id, line_no, c, {_NORM.format('c')} AS n, length(regexp_replace(c, '[^\\p{{L}}]', '', 'g')) AS letters
  FROM (SELECT doc_id, line_no, {_CLEAN.format('line')} AS c FROM l)
)
SELECT doc_id, line_no::INT AS line_no,
  n = '' OR regexp_matches(n, '^v ?\\d+( \\d+)?$') OR regexp_matches(n, '{_META}') OR regexp_matches(n, '{_STOP}') AS skipped,
  regexp_matches(n, '{_META}') AS metadata,
  regexp_matches(n, '{_STOP}') AS stop_word,
  length(c) >= 5 AND NOT regexp_matches(n, '{_META}') AND NOT regexp_matches(n, '{_STOP}') AND letters >= 4
    AND NOT regexp_matches(c, {_PRICE_ONLY}) AS description,
  NOT regexp_matches(n, '{_META}') AND NOT regexp_matches(n, '{_STOP}') AND letters >= 3
    AND NOT regexp_matches(n, 'vuelto|ley 27|transparencia|descuento|recargo|envio')
    AND NOT contains(replace(n, ' ', ''), 'ley27') AS product,
  regexp_matches(c, {_PRICE_ONLY}) AS price_only,
  length(c) >= 5 AND NOT regexp_matches(n, '{_META}') AND NOT regexp_matches(n, '^[0-9 kg]+$')
    AND NOT regexp_matches(n, 'cambio de peso|off|market') AND letters >= 4 AS app_product,
  contains(n, 'fecha') AND NOT contains(n, 'inicio') AND NOT contains(n, 'actividad') AS date_label,
  length(c) >= 8 AND NOT regexp_matches(lower(c), '{_alternation(D.OCR_NOT_ITEM)}') AND letters > 0
    AND regexp_matches(c, '\\p{{Nd}}') AND regexp_matches(c, '[,.]') AS ocr_item
FROM n
"""
)
def line_classes(spark, sf_dir):
    """P1-P6, P8, P10, P17 over every line of the documents."""
    from tillscan.functions.dates import is_date_label

    c, n = F.col("clean"), F.col("norm")
    # The searches for words read a whole line: once each.
    lines = _doc_lines(spark, sf_dir).withColumns({"metadata": L.has_metadata(n), "stop_word": L.has_stop_word(n)})
    metadata, either = F.col("metadata"), F.col("metadata") | F.col("stop_word")
    return lines.select(
        F.col("receipt_id").alias("doc_id"),
        "line_no",
        L.is_skipped(n, either).alias("skipped"),
        "metadata",
        "stop_word",
        L.is_description(c, n, either).alias("description"),
        L.is_product(c, n, either).alias("product"),
        A.is_price_only(c).alias("price_only"),
        L.is_app_product(c, n, metadata).alias("app_product"),
        is_date_label(n).alias("date_label"),
        L.is_ocr_item(c).alias("ocr_item"),
    )


# --- Amounts, quantities, dates -------------------------------------------------------------------

_LINE_ID = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice"
_ID = _LINE_ID.split(", ")


@query(
    f"""
SELECT {_LINE_ID}, 2 AS found, l_extendedprice AS grouped, l_extendedprice AS lost_mark,
  floor(l_extendedprice) * 1000 AS thousands, l_extendedprice AS plain
FROM lineitem
"""
)
def amounts_parsed(spark, sf_dir):
    """Every way of writing an amount."""
    rows = R.spread(R.table(spark, sf_dir, "lineitem"))
    x = F.col("l_extendedprice")
    cents = F.round(x * 100).cast("long")
    lost = F.concat(F.lit("$"), F.floor(cents / 100000), F.lit("."), F.lpad((cents % 100000).cast("string"), 5, "0"))
    text = F.concat_ws(" ", F.lit("VIDRIO X3"), F.concat(F.lit("$ "), R.comma(x, "#,##0.00")), F.lit("y"), lost, F.lit("z"))
    # A column for each text: reading one names it many times.
    rows = rows.select(*_ID, A.amounts(text).alias("amounts"))
    written = F.array(F.get("amounts", 0), F.get("amounts", 1), F.concat(F.lit("$"), F.floor(x).cast("string"), F.lit(".000")), R.comma(x))
    rows = rows.select(*_ID, F.size("amounts").alias("found"), written.alias("texts"))
    names = ("grouped", "lost_mark", "thousands", "plain")
    return rows.select(*_ID, "found", *[A.parse_amount(F.get("texts", i)).alias(name) for i, name in enumerate(names)])


@query(
    f"""
SELECT {_LINE_ID}, l_extendedprice / l_quantity AS unit_price,
  replace(format('{{:.2f}}', l_extendedprice / l_quantity), '.', ',') AS unit_price_text
FROM lineitem
"""
)
def unit_price_text(spark, sf_dir):
    """M2, M5"""
    unit = A.unit_price(F.col("l_extendedprice"), F.col("l_quantity"))
    return R.spread(R.table(spark, sf_dir, "lineitem")).select(
        *_ID, unit.alias("unit_price"), A.format_amount(unit).alias("unit_price_text")
    )


@query(f"SELECT {_LINE_ID}, l_quantity::INT AS by_count, l_quantity::INT AS by_amount, 1 AS neither FROM lineitem")
def quantity_detect(spark, sf_dir):
    """X8"""
    q = F.col("l_quantity").cast("int").cast("string")
    return R.spread(R.table(spark, sf_dir, "lineitem")).select(
        *_ID,
        A.quantity(F.concat(F.lit("JABON X"), q)).alias("by_count"),
        A.quantity(F.concat(q, F.lit(" x "), R.comma(F.col("l_extendedprice")), F.lit(" JABON X7"))).alias("by_amount"),
        A.quantity(F.concat(F.lit("SAL X500GR "), q)).alias("neither"),
    )


@query(
    f"""
SELECT {_LINE_ID}, l_quantity::INT::VARCHAR AS units, (l_quantity::INT || '.5') AS weight, 
  l_quantity + 0.5 AS weight_value, l_quantity::INT IS NULL AS none
FROM lineitem
"""
)
def app_quantity(spark, sf_dir):
    """X7, M4"""
    q = F.col("l_quantity").cast("int").cast("string")
    weight = A.app_quantity(F.concat(F.lit("1kg "), q, F.lit(",5 kg")))
    return R.spread(R.table(spark, sf_dir, "lineitem")).select(
        *_ID,
        A.app_quantity(F.concat(F.lit("Papas 2 kg "), q, F.lit("x"))).alias("units"),
        weight.alias("weight"),
        A.parse_quantity(weight).alias("weight_value"),
        A.app_quantity(F.concat(q, F.lit("xOFF"))).isNotNull().alias("none"),
    )


_DATE_SQL = "SELECT o_orderkey AS receipt_id, {} AS date_text FROM orders"
_SHIFTED = "(o_orderdate + INTERVAL 20 YEAR)"
_DMY = f"day({_SHIFTED}) || '/' || month({_SHIFTED}) || '/' || year({_SHIFTED})"


def _dates(spark: SparkSession, sf_dir: str, lines) -> DataFrame:
    return H.receipt_header(R.bare(spark, sf_dir, lines), R.AS_OF).select("receipt_id", "date_text")


@query(_DATE_SQL.format(_DMY))
def receipt_date(spark, sf_dir):
    """Another date first, letters for zeros, the date on the next line."""
    day = F.add_months(F.to_date("o_orderdate"), 240)
    odd = F.col("o_orderkey") % 2 == 1
    text = F.translate(F.date_format(day, "dd/MM/yyyy"), "0", "O")
    lines = F.array(
        F.lit("Inicio de actividades fecha 01/02/2007"),
        F.when(odd, F.concat(F.lit("Fecha "), text)).otherwise("FECHA:"),
        F.when(odd, F.lit("01/01/2020")).otherwise(F.date_format(day, "d - M - yyyy")),
    )
    return _dates(spark, sf_dir, lines)


@query(_DATE_SQL.format("''"))
def date_rejected(spark, sf_dir):
    """Years before 2015 are no receipt dates."""
    return _dates(spark, sf_dir, F.array(R.date_line(0), F.lit("Fecha 31/02/2020")))


@query(_DATE_SQL.format(f"CASE WHEN o_orderkey % 2 = 0 THEN {_DMY} ELSE day({_SHIFTED}) || '/5/2026' END"))
def date_short_year(spark, sf_dir):
    """Two-digit years, and days without a year."""
    day = F.add_months(F.to_date("o_orderdate"), 240)
    short = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "dd/MM/yy")).otherwise(
        F.concat(F.date_format(day, "dd"), F.lit("/05"))
    )
    return _dates(spark, sf_dir, F.array(F.concat(F.lit("Fecha "), short)))


@query(
    f"""SELECT o_orderkey AS receipt_id, {_DMY} AS normal, 'x' || o_orderkey AS kept, '' AS blank,
  '31/2/' || year({_SHIFTED}) AS impossible, {_SHIFTED}::DATE AS day FROM orders"""
)
def date_normalize(spark, sf_dir):
    """What is no date stays as it is."""
    day = F.add_months(F.to_date("o_orderdate"), 240)
    text = F.date_format(day, "dd-MM-yyyy")
    return R.spread(R.table(spark, sf_dir, "orders")).select(
        F.col("o_orderkey").alias("receipt_id"),
        normalize_date(text, R.AS_OF).alias("normal"),
        normalize_date(F.concat(F.lit("x"), F.col("o_orderkey")), R.AS_OF).alias("kept"),
        normalize_date(F.lit(" "), R.AS_OF).alias("blank"),
        normalize_date(F.concat(F.lit("31/2/"), F.year(day)), R.AS_OF).alias("impossible"),
        parse_date(find_date(F.concat(F.lit("el "), text), R.AS_OF), R.AS_OF).alias("day"),
    )


# --- Stores -----------------------------------------------------------------------------------------


@query(
    """
SELECT o_orderkey AS receipt_id, CASE o_orderkey % 4 WHEN 0 THEN 'Almacen Del Sol' WHEN 1 THEN 'Kiosco Norte'
  WHEN 2 THEN 'Compra sin identificar' ELSE 'Compra sin identificar' END AS store_name
FROM orders
"""
)
def store_detect(spark, sf_dir):
    """After the label, else the first line that can be a name, within 14 lines."""
    key = F.col("o_orderkey") % 4
    lines = (
        F.when(key == 0, F.array(F.lit("SUPERMERCADO"), F.lit("almacen del sol"), F.lit("OTRO NOMBRE")))
        .when(key == 1, F.array(F.lit("CUIT 20-1"), F.lit("x9"), F.lit("KIOSCO NORTE")))
        .when(key == 2, F.array(F.lit("corto"), F.lit("numero 123 largo"), F.lit("IVA RESPONSABLE")))
        .otherwise(F.concat(F.array_repeat(F.lit("linea 1"), D.STORE_LINES), F.array(F.lit("NOMBRE TARDIO"))))
    )
    return H.receipt_header(R.bare(spark, sf_dir, lines), R.AS_OF).select("receipt_id", "store_name")


@query(
    """
SELECT o_orderkey AS receipt_id, CASE o_orderkey % 4 WHEN 0 THEN 'Los Tres Corazones' WHEN 1 THEN 'Tienda Filipa'
  WHEN 2 THEN 'Los Tres Corazones' ELSE 'Kiosco Norte' END AS store_name
FROM orders
"""
)
def store_map(spark, sf_dir):
    """The first line with a known name wins over the detected one."""
    key = F.col("o_orderkey") % 4
    lines = (
        F.when(key == 0, F.array(F.lit("KIOSCO NORTE"), F.lit("z0u-WENGUO"), F.lit("Tienda Filipa")))
        .when(key == 1, F.array(F.lit("KIOSCO NORTE"), F.lit("TiendaFilipa S.R.L."), F.lit("Zou Wenguo")))
        .when(key == 2, F.array(F.lit("LOS SUPERMERCADO"), F.lit("TRES CORAZÓNES")))
        .otherwise(F.array(F.lit("KIOSCO NORTE"), F.lit("zou")))
    )
    return H.receipt_header(R.bare(spark, sf_dir, lines), R.AS_OF).select("receipt_id", "store_name")


@query(
    f"""
WITH k AS (
  SELECT s_suppkey, s_name, 'súper ' || s_nationkey || repeat('!', row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT) AS key,
    row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier
)
SELECT {_DICT_NORM.format('key')} AS alias, min(i)::INT AS pos, arg_max(s_name, i) AS store FROM k GROUP BY 1
"""
)
def store_dictionary(spark, sf_dir):
    """A file of names of stores; of equal ones the first keeps its place and the last its store."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    key = F.concat(F.lit("SÚPER "), F.col("s_nationkey"), F.repeat(F.lit("!"), place))
    pairs = R.table(spark, sf_dir, "supplier").select("s_suppkey", key.alias("key"), "s_name")
    ordered = F.sort_array(F.collect_list(F.struct("s_suppkey", "key", "s_name")))
    entries = F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["key"], x["s_name"])))
    path = shared_folder(spark, "store-names")
    write_files(pairs.agg(F.to_json(entries).alias("v")).select(F.lit("stores").alias("n"), "v"), path, "n", "v", suffix=".json")
    return read_stores(spark, path).select("alias", "pos", "store")


# --- Brands and products --------------------------------------------------------------------------

_W1, _W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_T1, _T2 = f"upper({_W1}[1]) || {_W1}[2:]", f"upper({_W2}[1]) || {_W2}[2:]"


@query(f"SELECT p_partkey, CASE WHEN length({_W1}) <= 3 THEN {_T1} || ' ' || {_T2} ELSE {_T1} END AS brand, CASE WHEN length({_W1}) <= 3 THEN p_name ELSE {_W1} END AS alias FROM part")
def fallback_brand(spark, sf_dir):
    """B4"""
    b = B.fallback_brand(X.title_case(F.col("p_name")))
    return R.spread(R.table(spark, sf_dir, "part")).select("p_partkey", b["brand"].alias("brand"), b["alias"].alias("alias"))


@query(
    f"""SELECT p_partkey, CASE WHEN length({_W1}) <= 3 THEN {_T1} || ' ' || {_T2} ELSE {_T2} END AS left_over,
  {_T1} || {_T2} AS restored, {_T2} || ' 9' AS unglued FROM part"""
)
def brand_strip(spark, sf_dir):
    """Whole words, a word that only begins with the brand, a brand glued on twice."""
    shown = X.title_case(F.col("p_name"))
    b = B.fallback_brand(shown)
    first, second = F.get(F.split(shown, " "), 0), F.get(F.split(shown, " "), 1)
    return R.spread(R.table(spark, sf_dir, "part")).select(
        "p_partkey",
        B.remove_brand(shown, b["brand"], b["alias"]).alias("left_over"),
        B.remove_brand(F.concat(first, second), first, F.lower(first)).alias("restored"),
        B.remove_brand(F.concat(first, F.lit(" "), first, second, F.lit(" 9")), first, F.lower(first)).alias("unglued"),
    )


_BRAND_DIM = """
b AS (SELECT p_name AS brand, dense_rank() OVER (ORDER BY p_name) - 1 AS pos FROM (SELECT DISTINCT p_name FROM part)
  UNION ALL SELECT w, 1000 + dense_rank() OVER (ORDER BY w) FROM (SELECT DISTINCT split_part(p_name, ' ', {n}) AS w FROM part))"""


def _brand_dim(spark: SparkSession, sf_dir: str, word: int) -> DataFrame:
    """Whole names, then one of their words: a dictionary of unbounded size, as a table."""
    from pyspark.sql import Window

    names = R.table(spark, sf_dir, "part").select(F.col("p_name").alias("brand")).distinct()
    words = R.table(spark, sf_dir, "part").select(F.split("p_name", " ")[word - 1].alias("brand")).distinct()
    rank = F.dense_rank().over(Window.orderBy("brand"))
    both = names.select("brand", (rank - 1).alias("pos")).unionByName(words.select("brand", (rank + 1000).alias("pos")))
    n = X.dict_norm(F.col("brand"))
    return both.select("pos", F.lit(0).alias("alias_pos"), "brand", n.alias("norm"), X.compact(n).alias("compact"))


@query(
    f"""
WITH {_BRAND_DIM.format(n=1)}, d AS (SELECT DISTINCT p_partkey, p_name || ' x' || p_size AS t FROM part)
SELECT p_partkey, brand FROM (
  SELECT p_partkey, brand, row_number() OVER (PARTITION BY p_partkey ORDER BY length(replace(brand, ' ', '')) DESC, pos) AS r
  FROM d JOIN b ON starts_with(replace(t, ' ', ''), replace(brand, ' ', ''))) WHERE r = 1
"""
)
def brand_prefix(spark, sf_dir):
    """J1 by join: the longest name that starts a description."""
    rows = R.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.upper("p_name"), F.lit(" X"), F.col("p_size")).alias("t"))
    return B.match_brands(rows, _brand_dim(spark, sf_dir, 1), "t", ["p_partkey"]).select("p_partkey", "brand")


@query(
    f"""
WITH {_BRAND_DIM.format(n=2)}, d AS (SELECT DISTINCT p_partkey, 'zz' || replace(p_name, ' ', '') || 'x' || p_size || 'anvil' AS t FROM part)
SELECT p_partkey, brand FROM (
  SELECT p_partkey, brand, row_number() OVER (PARTITION BY p_partkey ORDER BY length(replace(brand, ' ', '')) DESC, pos) AS r
  FROM d JOIN b ON contains(t, replace(brand, ' ', ''))) WHERE r = 1
"""
)
def brand_anywhere(spark, sf_dir):
    """J2 by join: the longest name anywhere in a description."""
    text = F.concat(F.lit("Zz "), F.upper("p_name"), F.lit(" X"), F.col("p_size"), F.lit(" anvil"))
    rows = R.table(spark, sf_dir, "part").select("p_partkey", text.alias("t"))
    return B.match_brands(rows, _brand_dim(spark, sf_dir, 2), "t", ["p_partkey"], anywhere=True).select("p_partkey", "brand")


_BRAND_LIST = "[" + ", ".join("'" + b.replace("'", "''") + "'" for b in D.BRANDS) + "]"


@query(
    f"""
WITH b AS (SELECT unnest({_BRAND_LIST}) AS brand, unnest(range({len(D.BRANDS)}))::INT AS pos),
p AS (SELECT p_partkey, brand, p_name FROM part JOIN b ON pos = p_partkey % {len(D.BRANDS)})
SELECT p_partkey, brand AS at_start, brand AS anywhere FROM p
"""
)
def brand_literals(spark, sf_dir):
    """J1, J2 as expressions over the built-in catalog, N8."""
    aliases = brand_aliases()
    names = F.array(*[F.lit(b) for b in D.BRANDS])
    brand = F.get(names, (F.col("p_partkey") % len(D.BRANDS)).cast("int"))
    rows = R.table(spark, sf_dir, "part").withColumn("t", F.concat(F.upper(brand), F.lit(" "), F.lit("999")))
    return rows.select(
        "p_partkey",
        B.known_brand(F.col("t"), aliases)["brand"].alias("at_start"),
        B.known_brand(F.concat(F.lit("99 "), F.col("t")), aliases, anywhere=True)["brand"].alias("anywhere"),
    )


_NORM_ALIAS = _DICT_NORM.format("alias")


@query(
    f"""
WITH b AS (
  SELECT p_partkey::INT AS pos, CASE p_partkey % 6 WHEN 0 THEN 'Casa del ' || p_name WHEN 1 THEN 'Flor de la ' || p_name WHEN 2 THEN p_name || chr(39) || 's ' || p_size
    WHEN 3 THEN 'La Providencia' WHEN 4 THEN 'UNIÓN  Ganadera' ELSE 'Frutigram' END AS brand FROM part
),
a AS (
  SELECT brand, pos, unnest([brand, replace(brand, ' del ', ' de '), replace(brand, ' de la ', ' '), replace(brand, chr(39), '')]) AS alias FROM b
  UNION ALL SELECT b.brand, pos, s FROM b JOIN (SELECT * FROM (VALUES ('la providencia', 'la providecia'),
    ('la providencia', 'la providedcia'), ('frutigram', 'frutigran'), ('union ganadera', 'union')) v(n, s))
    ON n = {_DICT_NORM.format('b.brand')}
)
SELECT DISTINCT pos, brand, {_NORM_ALIAS} AS norm, replace({_NORM_ALIAS}, ' ', '') AS compact FROM a
"""
)
def brand_alias(spark, sf_dir):
    """Every spelling of every name of a table: left-out and changed words, an apostrophe, known misreadings."""
    key, name = F.col("p_partkey"), F.col("p_name")
    brand = (
        F.when(key % 6 == 0, F.concat(F.lit("Casa del "), name)).when(key % 6 == 1, F.concat(F.lit("Flor de la "), name))
        .when(key % 6 == 2, F.concat(name, F.lit("'s "), F.col("p_size"))).when(key % 6 == 3, "La Providencia")
        .when(key % 6 == 4, "UNIÓN  Ganadera").otherwise("Frutigram")
    )
    brands = R.table(spark, sf_dir, "part").select(key.cast("int").alias("pos"), brand.alias("brand"))
    return alias_frame(brands).select("pos", "brand", "norm", "compact")


@query(
    f"""SELECT p_partkey, CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 'Aro x' || p_size WHEN 'rod' THEN 'Vara x' || p_size
  WHEN 'widget' THEN 'Aro x' || p_size ELSE {_T1} || ' ' || {_T2} || ' X' || p_size END AS product, 'Queso cremoso ' || p_size || 'un' AS special FROM part"""
)
def product_rule(spark, sf_dir):
    """The first rule with a word in the description."""
    rules = product_rules([("Aro", ["ring", "wid.get", "widget"]), ("Vara", ["rod", "ring"])])
    shown = F.concat(X.title_case(F.col("p_name")), F.lit(" X"), F.col("p_size"))
    cheese = F.concat(F.lit("Cr "), F.col("p_size"), F.lit("Un"))
    return R.spread(R.table(spark, sf_dir, "part")).select(
        "p_partkey",
        expand_product(shown, F.lit("Acme"), rules).alias("product"),
        expand_product(cheese, F.lit("Punta Del Agua"), rules).alias("special"),
    )


@query(
    f"""
WITH c AS (SELECT p_partkey, {_T1} || CASE WHEN length({_W1}) <= 3 THEN ' ' || {_T2} ELSE '' END AS brand FROM part)
SELECT lower(brand) AS norm, brand FROM c WHERE lower(brand) NOT LIKE 'small%' GROUP BY ALL
"""
)
def learned_brands(spark, sf_dir):
    """Fallback brands that the catalog lacks."""
    parts = R.table(spark, sf_dir, "part")
    candidates = parts.select("p_partkey", B.fallback_brand(X.title_case(F.col("p_name")))["brand"].alias("brand"))
    known = spark.createDataFrame([("SMALL",), ("Sancor",)], "brand string")
    return B.learned_brands(candidates, known, ["p_partkey"])


@query(
    f"""
WITH c AS (SELECT DISTINCT {_T1} || CASE WHEN length({_W1}) <= 3 THEN ' ' || {_T2} ELSE '' END AS brand FROM part)
SELECT '[ "' || string_agg(brand, '", "' ORDER BY lower(brand), brand) || '" ]' AS value FROM (SELECT brand FROM c UNION SELECT 'sancor')
"""
)
def catalog_merge(spark, sf_dir):
    """K7: the catalog with learned brands, sorted regardless of case."""
    parts = R.table(spark, sf_dir, "part")
    candidates = parts.select("p_partkey", B.fallback_brand(X.title_case(F.col("p_name")))["brand"].alias("brand"))
    known = spark.createDataFrame([(0, "sancor")], "pos int, brand string")
    return catalog_json(B.merged_catalog(known, B.learned_brands(candidates, known, ["p_partkey"])))


# --- Layouts and special lines ----------------------------------------------------------------------


@query(
    """SELECT o_orderkey AS receipt_id, CASE WHEN o_orderkey % 3 = 0 THEN 'standard' ELSE 'app' END AS layout FROM orders"""
)
def layout_flag(spark, sf_dir):
    """P7, A2, B7"""
    key = F.col("o_orderkey") % 3
    last = F.when(key == 0, "PEDIDOS LISTOS").when(key == 1, "via PedidosYa Market").otherwise("pedidos   yá!")
    return H.receipt_header(R.bare(spark, sf_dir, F.array(F.lit("Ticket"), last)), R.AS_OF).select("receipt_id", "layout")


@query(
    """
SELECT o_orderkey AS receipt_id, 0 AS line_no, 'PUNTA DE AGUA CR*1UN' AS raw_description, replace(format('{:.2f}', o_totalprice), '.', ',') AS raw_price,
  'Queso cremoso 1un' AS descripcion, 'Punta del agua' AS marca, replace(format('{:.2f}', o_totalprice), '.', ',') AS precio_unitario FROM orders
"""
)
def special_line(spark, sf_dir):
    """A weight line merged with an item; the first amount after the name counts."""
    text = F.concat(F.lit("0,2950 x 10500,00 PUNTA DE AGUA CR*1UN "), R.comma(F.col("o_totalprice")), F.lit(" 1200,00"))
    items = receipt_items(R.bare(spark, sf_dir, F.array(text)), R.AS_OF)
    return items.select("receipt_id", "line_no", "raw_description", "raw_price", "descripcion", "marca", "precio_unitario")


@query(
    """SELECT o_orderkey AS receipt_id, 'PRECIO UNIT' AS raw_description, replace(format('{:.2f}', o_totalprice), '.', ',') AS raw_price FROM orders"""
)
def price_at_end(spark, sf_dir):
    """What is left when everything but the price is stripped."""
    text = F.concat(F.lit("PRECIO UNIT "), R.comma(F.col("o_totalprice")))
    return raw_items(R.bare(spark, sf_dir, F.array(text)), R.AS_OF).select("receipt_id", "raw_description", "raw_price")


# --- Export -------------------------------------------------------------------------------------------


def _quoted(v: str, d: str) -> str:
    return f"""CASE WHEN contains({v}, {d}) OR contains({v}, chr(10)) OR contains({v}, '"') THEN '"' || replace({v}, '"', '""') || '"' ELSE {v} END"""


_FIELD = """(p_name || CASE p_partkey % 5 WHEN 0 THEN '|' WHEN 1 THEN chr(9) WHEN 2 THEN '"q"' WHEN 3 THEN chr(10) ELSE chr(13) END || p_size)"""


@query(
    f"""SELECT p_partkey, {_quoted(_FIELD, "'|'")} AS pipe, {_quoted(_FIELD, "chr(9)")} AS tab,
  {_quoted(_FIELD, "'|'")} || '||' || p_brand AS pipe_row FROM part"""
)
def export_quoting(spark, sf_dir):
    """K4, K5"""
    key = F.col("p_partkey") % 5
    mark = F.when(key == 0, "|").when(key == 1, "\t").when(key == 2, '"q"').when(key == 3, "\n").otherwise("\r")
    rows = R.table(spark, sf_dir, "part").withColumns(
        {"v": F.concat("p_name", mark, F.col("p_size").cast("string")), "none": F.lit(None).cast("string")}
    )
    return rows.select(
        "p_partkey",
        E.escape(F.col("v"), "|").alias("pipe"),
        E.escape(F.col("v"), "\t").alias("tab"),
        E.export_row("|", ("v", "none", "p_brand")).alias("pipe_row"),
    )


# --- OCR ------------------------------------------------------------------------------------------------


def _rendered_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR results in JSON: for each item a name and a price box on about one height."""
    orders = R.order_items(spark, sf_dir)

    def box(text, left, top, height) -> str:
        corners = [F.concat_ws(",", x.cast("string"), y.cast("string")) for x in (left, left + 90) for y in (top, top + height)]
        polygon = F.concat_ws("],[", *corners)
        return F.concat(F.lit("[[["), polygon, F.lit(']],["'), text, F.lit('",0.9]]'))

    def pair(i, k):
        top = (k * 60).cast("double")
        return F.concat_ws(
            ",",
            box(R.comma(i["l_extendedprice"]), F.lit(400.0), top + F.pmod(k, F.lit(2)) * 14, F.lit(20.0)),
            box(F.upper(i["p_name"]), F.lit(10.0), top, F.lit(22.0)),
        )

    entries = F.concat_ws(",", F.transform("items", pair))
    result = F.concat(F.lit("[["), entries, F.lit(",[[[1,1]]],[[[1,1],[2,2]],[\"  \",0.5]]]]"))
    return orders.select(
        F.col("o_orderkey").alias("receipt_id"), F.lit(0).alias("page"), F.lit(0).alias("variant_pos"), result.alias("result")
    )


@query(
    f"""WITH {_ITEMS}
SELECT l_orderkey AS receipt_id, k::INT AS line_no, upper(p_name) || ' ' || replace(format('{{:.2f}}', x), '.', ',') AS text,
  0.9::DOUBLE AS score, (60 * k)::DOUBLE AS top, 10.0::DOUBLE AS "left" FROM s"""
)
def box_rows(spark, sf_dir):
    """Boxes of one height become a line, left to right."""
    lines = O.box_rows(O.boxes(_rendered_boxes(spark, sf_dir)))
    return lines.select("receipt_id", "line_no", "text", "score", "top", "left")


@query(
    f"""WITH {_ITEMS}
SELECT l_orderkey AS receipt_id, 0 AS page, string_agg(upper(p_name) || ' ' || replace(format('{{:.2f}}', x), '.', ','), chr(10) ORDER BY k) AS text
FROM s GROUP BY l_orderkey"""
)
def best_text(spark, sf_dir):
    """F1, A6, A7, A3 together: an empty rendering never wins."""
    results = _rendered_boxes(spark, sf_dir)
    both = F.array(F.struct("variant_pos", "result"), F.struct(F.lit(1).alias("variant_pos"), F.lit("[]").alias("result")))
    return O.best_texts(O.boxes(results.select("receipt_id", "page", F.inline(both))))


_VARIANT_LINES = _LINES.format("text", "documents")
_TOKEN_SUM = " + ".join(
    [f"8 * max(contains(low, '{t}')::INT)" for t in D.OCR_HEADER_TOKENS]
    + [f"10 * max(contains(low, '{t}')::INT)" for t in D.OCR_PRODUCT_TOKENS]
)
_SCORE = f"""
WITH {_VARIANT_LINES}, z AS (
  SELECT doc_id, line, lower(line) AS low, regexp_matches(line, '\\p{{Nd}}') AS digit,
    length(line) >= 8 AND NOT regexp_matches(lower(line), '{_alternation(D.OCR_NOT_ITEM)}') AND regexp_matches(line, '\\p{{L}}')
      AND regexp_matches(line, '\\p{{Nd}}') AND regexp_matches(line, '[,.]') AS item
  FROM l
), scored AS (
  SELECT doc_id, count(*) * 4 + sum(length(line)) / 30 + 6 * max(digit::INT)
    + 8 * sum((digit AND contains(line, ','))::INT) + 14 * sum(item::INT) + {_TOKEN_SUM} AS score
  FROM z GROUP BY doc_id
)"""


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as renderings: four of a receipt each."""
    lines = _doc_lines(spark, sf_dir)
    return lines.select(
        F.floor(F.col("receipt_id") / 4).alias("receipt_id"), F.lit(0).alias("page"),
        (F.col("receipt_id") % 4).alias("variant_pos"), F.col("line").alias("text"),
    )


@query(f"{_SCORE} SELECT doc_id // 4 AS receipt_id, doc_id % 4 AS variant_pos, score::DOUBLE AS score FROM scored")
def ocr_text_score(spark, sf_dir):
    """A6, P17"""
    return O.score_texts(_variants(spark, sf_dir)).select("receipt_id", "variant_pos", "score")


@query(
    f"""{_SCORE} SELECT receipt_id, variant_pos FROM (SELECT doc_id // 4 AS receipt_id, doc_id % 4 AS variant_pos,
  row_number() OVER (PARTITION BY doc_id // 4 ORDER BY score DESC, doc_id % 4) AS r FROM scored) WHERE r = 1"""
)
def best_variant(spark, sf_dir):
    """A7"""
    return O.best_variant(O.score_texts(_variants(spark, sf_dir))).select("receipt_id", "variant_pos")


_REPLIES = """
r AS (SELECT o_orderkey AS receipt_id, CASE o_orderkey % 4 WHEN 0 THEN 'sin papel' END AS err,
  CASE o_orderkey % 4 WHEN 1 THEN ' ' ELSE 'Fecha ' || o_orderkey END AS txt FROM orders)"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 4
    reply = F.to_json(
        F.struct(
            F.when(key == 0, "sin papel").when(key == 2, " ").alias("error"),
            F.when(key == 1, " ").otherwise(F.concat(F.lit("Fecha "), F.col("o_orderkey"))).alias("text"),
            F.lit("gray-original").alias("variant"),
        )
    )
    return R.spread(R.table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("receipt_id"), reply.alias("reply"))


@query(
    f"""WITH {_REPLIES}
SELECT receipt_id, CASE WHEN err IS NULL AND trim(txt) <> '' THEN txt END AS text, 'gray-original' AS variant,
  CASE WHEN err IS NOT NULL THEN 'PaddleOCR fallo: ' || err WHEN trim(txt) = '' THEN '{D.EMPTY_TEXT_MESSAGE}' END AS message FROM r"""
)
def ocr_reply(spark, sf_dir):
    """S8, N12"""
    return decode_replies(_replies(spark, sf_dir)).select("receipt_id", "text", "variant", "message")


@query(
    f"""WITH {_REPLIES}
SELECT receipt_id, CASE WHEN err IS NOT NULL THEN 'PaddleOCR fallo: ' || err ELSE '{D.EMPTY_TEXT_MESSAGE}' END AS message
FROM r WHERE err IS NOT NULL OR trim(txt) = ''"""
)
def reply_rejects(spark, sf_dir):
    """K8"""
    return rejects(decode_replies(_replies(spark, sf_dir)))


@query(
    """SELECT doc_id // 5 AS receipt_id, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS raw_text FROM documents GROUP BY 1"""
)
def page_join(spark, sf_dir):
    """S3, A3: pages of a document in order, a blank line between."""
    pages = R.spread(R.table(spark, sf_dir, "documents")).select(
        F.floor(F.col("doc_id") / 5).alias("receipt_id"), F.col("doc_id").alias("page"), "text"
    )
    return join_pages(pages)

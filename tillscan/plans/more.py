"""More queries over receipts: dictionaries from files, uploads, look-ahead, images."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillscan.operators import images as I
from tillscan.operators.items import receipt_items
from tillscan.plans import rendered as R
from tillscan.plans.registry import query
from tillscan.sinks.shared import shared_folder
from tillscan.sinks.writers import write_catalog
from tillscan.sources.dictionaries import load_brands, load_stores
from tillscan.sources.receipts import uploads

# --- Dictionaries from files ------------------------------------------------------------------


@query(
    """
SELECT o_orderkey AS receipt_id, 'Acme ' || n_name AS marca, 'Widget' AS descripcion, 'Casa ' || r_name AS lugar_de_compra
FROM orders JOIN nation ON n_nationkey = o_orderkey % 25 JOIN region ON r_regionkey = o_orderkey % 5
"""
)
def dictionary_files(spark, sf_dir):
    """Brands and stores from JSON files, down to the items."""
    nations = R.table(spark, sf_dir, "nation")
    regions = R.table(spark, sf_dir, "region")
    brands, stores = shared_folder(spark, "brands"), shared_folder(spark, "stores")
    listed = nations.select(F.concat(F.lit("Acme  "), "n_name").alias("brand"))
    write_catalog(listed.unionByName(listed).unionByName(spark.createDataFrame([("-",), (" ",)], "brand string")), brands)
    pairs = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("KIOSCO "), "r_name"), F.concat(F.lit("Casa "), "r_name"))))
    regions.agg(F.to_json(pairs).alias("value")).coalesce(1).write.mode("overwrite").text(stores)
    orders = R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("receipt_id"))
    named = orders.join(nations, F.col("n_nationkey") == F.col("receipt_id") % 25).join(
        regions, F.col("r_regionkey") == F.col("receipt_id") % 5
    )
    lines = [F.concat(F.lit("Kiosco  "), "r_name", F.lit(" 2")), F.concat(F.lit("ACME "), "n_name", F.lit(" WIDGET 10,00"))]
    receipts = named.select("receipt_id", F.concat_ws("\n", *lines).alias("raw_text"))
    items = receipt_items(receipts, R.AS_OF, load_stores(spark, stores), load_brands(spark, brands))
    return items.select("receipt_id", "marca", "descripcion", "lugar_de_compra")


@query(
    """
SELECT o_orderkey AS receipt_id, k::INT AS line_no, CASE k WHEN 0 THEN 'Marca' || o_orderkey ELSE 'Other' END AS marca,
  'Widget' AS descripcion FROM orders, (VALUES (0), (1)) v(k)
"""
)
def large_brand_file(spark, sf_dir):
    """S10, J1, B1 with a catalog beyond the literals: the longest of thousands of names, by join."""
    keys = R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    names = keys.unionByName(spark.range(6000).select(F.col("id").alias("k"))).distinct()
    path = shared_folder(spark, "large-brands")
    write_catalog(names.select(F.concat(F.lit("Marca"), "k").alias("brand")), path)
    own = F.concat(F.lit("MARCA"), F.col("o_orderkey"), F.lit(" WIDGET 10,00"))
    receipts = R.bare(spark, sf_dir, F.array(own, F.lit("OTHER WIDGET 20,00")))
    items = receipt_items(receipts, R.AS_OF, aliases=load_brands(spark, path))
    return items.select("receipt_id", "line_no", "marca", "descripcion")


@query(
    """
SELECT o_orderkey AS receipt_id, 'Marca' || o_orderkey AS marca FROM orders
"""
)
def large_brand_file_app(spark, sf_dir):
    """J2 in the app layout with the same catalog: the name stands inside the description."""
    keys = R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    names = keys.unionByName(spark.range(6000).select(F.col("id").alias("k"))).distinct()
    path = shared_folder(spark, "large-brands-app")
    write_catalog(names.select(F.concat(F.lit("Marca"), "k").alias("brand")), path)
    own = F.concat(F.lit("Agua Marca"), F.col("o_orderkey"), F.lit(" Fina"))
    receipts = R.bare(spark, sf_dir, F.array(F.lit("PedidosYa Market"), own, F.lit("$ 10,00")))
    return receipt_items(receipts, R.AS_OF, aliases=load_brands(spark, path)).select("receipt_id", "marca")


# --- Uploads ---------------------------------------------------------------------------------------


@query(
    """
SELECT 'in/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.png' END AS path,
  CASE WHEN p_partkey % 3 < 2 THEN 'pdf' ELSE 'image' END AS kind, p_partkey % 5 = 0 AS rejected FROM part
"""
)
def upload_kinds(spark, sf_dir):
    """The kind of a file by its suffix; empty files are rejected."""
    key = F.col("p_partkey")
    suffix = F.when(key % 3 == 0, ".pdf").when(key % 3 == 1, ".PDF").otherwise(".png")
    content = F.when(key % 5 == 0, F.lit("")).otherwise(F.col("p_name")).cast("binary")
    files = R.table(spark, sf_dir, "part").select(
        F.concat(F.lit("in/"), key, suffix).alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content")
    )
    return uploads(files).select("path", "kind", F.col("message").isNotNull().alias("rejected"))


# --- Look-ahead, counts and weights -------------------------------------------------------------------


_COUNT = "(o_orderkey % 90 + 1)"


@query(
    f"""
SELECT o_orderkey AS receipt_id, 'Rueda Verde' AS descripcion, {_COUNT}::VARCHAR AS cantidad,
  replace(format('{{:.2f}}', 1234.5 / {_COUNT}), '.', ',') AS precio_unitario FROM orders
"""
)
def app_counted_name(spark, sf_dir):
    """The count at the end of the name line."""
    name = F.concat(F.lit("Rueda Verde "), F.col("o_orderkey") % 90 + 1, F.lit("x"))
    receipts = R.bare(spark, sf_dir, F.array(F.lit("PedidosYa Market"), name, F.lit("$ 1.234,50"), F.lit("Subtotal")))
    return receipt_items(receipts, R.AS_OF).select("receipt_id", "descripcion", "cantidad", "precio_unitario")


@query(
    f"""
SELECT o_orderkey AS receipt_id, 'Rueda Verde' AS descripcion,
  CASE WHEN o_orderkey % 5 = 4 THEN '1' ELSE {_COUNT}::VARCHAR END AS cantidad
FROM orders WHERE o_orderkey % 5 <> 3
"""
)
def app_look_ahead(spark, sf_dir):
    """A price up to three lines on, a count up to four; beyond, none."""
    key = F.col("o_orderkey")
    amount, count, filler = F.lit("$ 1.234,50"), F.concat(key % 90 + 1, F.lit("x")), F.lit("12")
    rest = (
        F.when(key % 5 == 0, F.array(filler, filler, amount, count))
        .when(key % 5 == 1, F.array(filler, amount, filler, count))
        .when(key % 5 == 2, F.array(amount, filler, filler, count))
        .when(key % 5 == 3, F.array(filler, filler, filler, amount))
        .otherwise(F.array(amount, filler, filler, filler, count))
    )
    lines = F.concat(F.array(F.lit("PedidosYa Market"), F.lit("Rueda Verde")), rest)
    return receipt_items(R.bare(spark, sf_dir, lines), R.AS_OF).select("receipt_id", "descripcion", "cantidad")


@query(
    """
SELECT o_orderkey AS receipt_id, k::INT AS line_no, d AS raw_description,
  CASE k WHEN 0 THEN '100,00' WHEN 1 THEN '200,00' WHEN 2 THEN '3.000,50' ELSE '$ 2.400,00' END AS raw_price
FROM orders, (VALUES (0, 'TOMATE PERITA'), (1, 'PAPA BLANCA'), (2, 'QUESO CREMOSO'), (3, 'MIX DE SEMILLAS')) v(k, d)
"""
)
def counted_and_weighed(spark, sf_dir):
    """Counts before a name, weights, unit-price labels and several amounts on a line."""
    kilos = F.format_string("%d,%03d", (F.col("o_orderkey") % 3).cast("int"), (F.col("o_orderkey") % 900 + 100).cast("int"))
    lines = F.array(
        F.concat(F.col("o_orderkey") % 9 + 1, F.lit(" x TOMATE PERITA 100,00")),
        F.concat(F.lit("PAPA BLANCA "), kilos, F.lit(" 200,00")),
        F.lit("QUESO CREMOSO PRECIO UNIT 1.500,25 3.000,50"),
        F.lit("$ 1.200,00 MIX DE SEMILLAS $ 2.400,00"),
    )
    return receipt_items(R.bare(spark, sf_dir, lines), R.AS_OF).select("receipt_id", "line_no", "raw_description", "raw_price")


# --- Images ------------------------------------------------------------------------------------------


def _small_images(spark, sf_dir):
    """Gray images of three by two pixels."""
    samples = [F.format_string("%02x", ((F.col("p_partkey") * 7 + F.col("p_size") * 3 + i * 31) % 256).cast("int")) for i in range(6)]
    return R.spread(R.table(spark, sf_dir, "part")).select(
        "p_partkey", F.lit(3).alias("width"), F.lit(2).alias("height"), F.unhex(F.concat(*samples)).alias("pixels")
    )


def _sample(i: int) -> str:
    return f"((p_partkey * 7 + p_size * 3 + {31 * i}) % 256)"


def _hexes(values) -> str:
    return " || ".join(f"format('{{:02x}}', {v})" for v in values)


_LIT = [f"least(255, floor({_sample(i)} * 1.28 + 14))::INT" for i in range(6)]


@query(
    f"""
SELECT p_partkey, 35 AS width, 34 AS height,
  repeat('ff', 35 * 16 + 16) || {_hexes(_LIT[:3])} || repeat('ff', 32) || {_hexes(_LIT[3:])} || repeat('ff', 35 * 16 + 16) AS pixels
FROM part
"""
)
def image_prepare(spark, sf_dir):
    """Contrast and border of a gray image."""
    out = I.transform_images(_small_images(spark, sf_dir), I.prepared)
    return out.select("p_partkey", "width", "height", F.lower(F.hex("pixels")).alias("pixels"))


@query(
    f"""
SELECT p_partkey, 2 AS width, 3 AS height,
  {_hexes(f"CASE WHEN {_sample(i)} > 172 THEN 255 ELSE 0 END" for i in (2, 5, 1, 4, 0, 3))} AS pixels FROM part
"""
)
def image_turn_and_threshold(spark, sf_dir):
    """The rotation and the threshold of I2."""
    out = I.transform_images(_small_images(spark, sf_dir), I.rotated(90), I.threshold(172))
    return out.select("p_partkey", "width", "height", F.lower(F.hex("pixels")).alias("pixels"))


@query(
    """
SELECT p_partkey, (((p_partkey % 256) * 19595 + (p_size % 256) * 38470 + 200 * 7471 + 32768) // 65536)::INT AS gray
FROM part
"""
)
def image_gray(spark, sf_dir):
    """The gray level of a colour (a part of S4 and I2)."""
    colour = [F.format_string("%02x", (F.col(c) % 256).cast("int")) for c in ("p_partkey", "p_size")]
    images = R.spread(R.table(spark, sf_dir, "part")).select(
        "p_partkey", F.lit(1).alias("width"), F.lit(1).alias("height"), F.unhex(F.concat(*colour, F.lit("c8"))).alias("pixels")
    )
    out = I.transform_images(images, I.grayscale, channels=3)
    return out.select("p_partkey", F.conv(F.hex("pixels"), 16, 10).cast("int").alias("gray"))


@query(
    """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 120 ELSE least(x + 59 + 25, 120) - greatest(x - 25, 0) END::INT AS width,
  CASE WHEN s_suppkey % 3 = 0 THEN 110 ELSE least(y + 59 + 25, 110) - greatest(y - 25, 0) END::INT AS height,
  CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE least(y, 25) END::INT AS above
FROM (SELECT s_suppkey, s_suppkey % 60 AS x, s_suppkey % 50 AS y FROM supplier)
"""
)
def image_crop(spark, sf_dir):
    """The bright paper with a margin; an image with too little of it stays."""
    x, y, small = F.col("s_suppkey") % 60, F.col("s_suppkey") % 50, F.col("s_suppkey") % 3 == 0
    side = F.when(small, 30).otherwise(60).cast("int")
    dark, light = F.lit("14"), F.lit("c8")
    dull = F.repeat(dark, F.lit(120))
    row = F.concat(F.repeat(dark, x.cast("int")), F.repeat(light, side), F.repeat(dark, (120 - x - side).cast("int")))
    pixels = F.concat(F.repeat(dull, y.cast("int")), F.repeat(row, side), F.repeat(dull, (110 - y - side).cast("int")))
    images = R.spread(R.table(spark, sf_dir, "supplier")).select(
        "s_suppkey", F.lit(120).alias("width"), F.lit(110).alias("height"), F.unhex(pixels).alias("pixels")
    )
    out = I.transform_images(images, I.cropped)
    lines = F.sequence(F.lit(0), F.col("height") - 1)
    middle = F.filter(lines, lambda i: F.instr(F.hex(F.substr("pixels", i * F.col("width") + 1, F.col("width"))), "C8") > 0)
    above = F.when(small, 0).otherwise(F.get(middle, 0))
    return out.select("s_suppkey", "width", "height", above.cast("int").alias("above"))


@query(
    """
SELECT o_orderkey, CASE WHEN greatest(w, h) <= 2200 THEN w ELSE greatest(1, floor(w * (2200.0::DOUBLE / greatest(w, h)))) END::INT AS width,
  CASE WHEN greatest(w, h) <= 2200 THEN h ELSE greatest(1, floor(h * (2200.0::DOUBLE / greatest(w, h)))) END::INT AS height,
  least(4000, 1500 * (o_orderkey % 5 + 1))::INT AS delay
FROM (SELECT o_orderkey, (o_orderkey * 37 % 5000 + 1)::INT AS w, (o_orderkey * 53 % 4000 + 1)::INT AS h FROM orders)
"""
)
def image_limits(spark, sf_dir):
    """The size under a longest side; S7: the delay before a retry."""
    w, h = ((F.col("o_orderkey") * k % m + 1).cast("int") for k, m in ((37, 5000), (53, 4000)))
    width, height = I.limited_size(w, h)
    delay = I.retry_delay((F.col("o_orderkey") % 5 + 1).cast("int"))
    return R.table(spark, sf_dir, "orders").select(
        "o_orderkey", width.cast("int").alias("width"), height.cast("int").alias("height"), delay.alias("delay")
    )

"""Receipts written from the driver's order tables, to be parsed again.

The SQL beside each query computes what the parser must find from the source columns
alone, never from text, so an error of the parser cannot cancel out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEARS = 20
AS_OF = 2026
#: Columns that number the items of an order; ``l_linenumber`` alone is not unique.
ITEM_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


#: Parts of rendered receipts for each part of the table's files: their texts and the work on them are many times the files.
PARTS_EACH = 16


def parts_wanted(scan: DataFrame) -> int:
    """Parts that keep all cores busy, not fewer than an exchange has anyway, and more as the table's files grow.

    With a fixed number, the items of a part and their texts would outgrow a task's memory.
    """
    spark = scan.sparkSession
    fixed = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(fixed, PARTS_EACH * scan.rdd.getNumPartitions())


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a table dealt over all cores, where its files have too few parts to keep them busy.

    Parsing is far more work than moving a text, but a table of one file and one row group
    is one task. Large inputs have parts enough and are left as they are. Only for plain
    scans, whose parts are known from file sizes without running anything.
    """
    wanted = 4 * scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= wanted else scan.repartition(wanted)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comma(value: Column, pattern: str = "0.00") -> Column:
    """An amount with decimal comma and, if the pattern groups, points between thousands."""
    return F.translate(F.call_function("format_number", value, F.lit(pattern)), ".,", ",.")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, o_orderdate, r_name, items): items sorted, each with its part's name.

    Lines are dealt by order with a stated number of parts, so that the exchange which the
    aggregate needs in any case also keeps all cores busy with parsing. Regions meet the orders before the
    items do: items are far wider, and stay where that exchange has put them, in all its parts.
    """
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    scan = table(spark, sf_dir, "lineitem")
    n = parts_wanted(scan)
    lines = scan.join(parts, "l_partkey").repartition(n, "l_orderkey")
    packed = F.struct(*[F.col(c) for c in ITEM_ORDER], "p_name")
    items = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(packed)).alias("items"))
    region = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("o_custkey"), "r_name")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(region, "o_custkey")
    orders = orders.select("o_orderkey", "o_orderdate", "r_name").repartition(n, "o_orderkey")
    return orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderdate", "r_name", "items")


def _receipts(orders: DataFrame, head: Column, body: Column, foot: Column) -> DataFrame:
    """``body`` has a text for each item, of one line or several."""
    text = F.array_join(F.concat(head, body, foot), "\n")
    return orders.select(F.col("o_orderkey").alias("receipt_id"), text.alias("raw_text"))


def date_line(years: int = YEARS, pattern: str = "dd/MM/yyyy") -> Column:
    day = F.add_months(F.to_date("o_orderdate"), 12 * years)
    return F.concat(F.lit("Fecha "), F.date_format(day, pattern), F.lit(" Hora 18:30:00"))


def store_line() -> Column:
    return F.concat(F.lit("TIENDA "), F.col("r_name"))


def count_name(i: Column) -> Column:
    """NAME Xn"""
    return F.concat(F.upper(i["p_name"]), F.lit(" X"), i["l_quantity"].cast("int").cast("string"))


def one_line(spark: SparkSession, sf_dir: str, years: int = YEARS) -> DataFrame:
    """Store, date, "NAME Xn amount" for each item, total."""
    orders = order_items(spark, sf_dir)
    body = F.transform("items", lambda i: F.concat(count_name(i), F.lit(" "), comma(i["l_extendedprice"])))
    return _receipts(orders, F.array(store_line(), date_line(years)), body, F.array(F.lit("TOTAL 1,00")))


def two_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``one_line``, with the amount on a line of its own."""
    orders = order_items(spark, sf_dir)
    body = F.transform("items", lambda i: F.concat_ws("\n", count_name(i), comma(i["l_extendedprice"])))
    foot = F.array(F.lit("TOTAL"), F.lit("1,00"))
    return _receipts(orders, F.array(store_line(), date_line()), body, foot)


def app_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery app: name, price with a currency sign and a count on three lines."""
    orders = order_items(spark, sf_dir)
    body = F.transform(
        "items",
        lambda i: F.concat_ws(
            "\n",
            F.initcap(i["p_name"]),
            F.concat(F.lit("$ "), comma(i["l_extendedprice"], "#,##0.00")),
            F.concat(i["l_quantity"].cast("int").cast("string"), F.lit("x")),
        ),
    )
    return _receipts(orders, F.array(F.lit("PedidosYa Market - Centro")), body, F.array(F.lit("Subtotal")))


def app_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery app with a whole item on a line."""
    orders = order_items(spark, sf_dir)
    body = F.transform(
        "items",
        lambda i: F.concat(
            F.initcap(i["p_name"]), F.lit(" $"), comma(i["l_extendedprice"], "#,##0.00"), F.lit(" $9.999 "),
            i["l_quantity"].cast("int").cast("string"), F.lit("x"),
        ),
    )
    return _receipts(orders, F.array(F.lit("Pedidos Ya Market - Centro")), body, F.array(F.lit("Subtotal")))


def bare(spark: SparkSession, sf_dir: str, lines: Column) -> DataFrame:
    """One receipt for each order with the given lines (an array of strings)."""
    orders = spread(table(spark, sf_dir, "orders"))
    return orders.select(F.col("o_orderkey").alias("receipt_id"), F.array_join(lines, "\n").alias("raw_text"))

"""Dictionaries as ordered tables, from the built-in values or from JSON files.

A dictionary is small by nature (hundreds of entries): plain rows on the driver, which the plans
put into literals. Files may hold any number: ``load_brands``, ``load_stores`` and ``load_rules``
return more than ``MAX_ENTRIES`` as a table, which the same plans join.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscan import dictionaries as D
from tillscan.functions.text import clean_brand, dict_norm, norm, py_dict_norm, py_norm
from tillscan.sinks.shared import written

MAX_ENTRIES = 5000


class Alias(NamedTuple):
    pos: int
    alias_pos: int
    brand: str
    norm: str
    compact: str


class StoreAlias(NamedTuple):
    pos: int
    compact: str
    store: str


class Rule(NamedTuple):
    pos: int
    product: str
    words: tuple[str, ...]


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(pos, brand) of all names as they stand in JSON lists, one file after the other by name.

    Several files are read at once, each by one task, and parsed once (a job).
    """
    text = _whole_files(spark, path)
    names = text.select(
        F.col("_metadata.file_path").alias("file"), F.posexplode(F.from_json("value", "array<string>")).alias("pos", "brand")
    )
    if len(text.inputFiles()) < 2:
        return names.select("pos", "brand").repartition("brand")  # one task parses; all clean the names
    names = written(names, "names")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = names.groupBy("file").agg(F.max("pos").alias("last")).select(
        "file", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("start")
    )
    return names.join(F.broadcast(starts), "file").select((F.col("start") + F.col("pos")).alias("pos"), "brand")


def _brand_set(spark: SparkSession, path: str) -> DataFrame:
    names = _listed(spark, path).withColumn("brand", clean_brand(F.col("brand"))).filter(~F.col("brand").isin("", "-"))
    return names.groupBy("brand").agg(F.min("pos").alias("pos")).select("pos", "brand")


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    """(pos, brand) of a JSON list of names, or of a folder of them (S10); blank names and "-" are left out."""
    return _brand_set(spark, path).orderBy("pos")


def read_stores(spark: SparkSession, path: str) -> DataFrame:
    """(pos, alias, store) of a JSON object.

    Aliases are normal forms; of equal ones the first keeps its place and the last its store.
    """
    text = _whole_files(spark, path)
    pairs = text.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("i", "e"))
    rows = pairs.select("i", dict_norm(F.col("e.key")).alias("alias"), F.col("e.value").alias("store"))
    return rows.groupBy("alias").agg(F.min("i").alias("pos"), F.max_by("store", "i").alias("store"))


def brand_aliases(brands: Iterable[str] = D.BRANDS) -> list[Alias]:
    """Every spelling of every brand (N8), the longest first; ties by order of the catalog."""
    out, seen = [], set()
    for pos, brand in enumerate(brands):
        names = [brand, *(brand.replace(a, b) for a, b in D.BRAND_VARIANTS)]
        names += D.BRAND_SPELLINGS.get(py_dict_norm(brand), ())
        for alias_pos, name in enumerate(names):
            n = py_dict_norm(name)
            if (brand, n) not in seen:
                seen.add((brand, n))
                out.append(Alias(pos, alias_pos, brand, n, n.replace(" ", "")))
    return sorted(out, key=lambda a: (-len(a.compact), a.pos, a.alias_pos))


def alias_frame(brands: DataFrame) -> DataFrame:
    """Every spelling (N8) of a table (pos, brand) of any size, as ``brand_aliases`` has them."""
    named = F.array("brand", *[F.replace("brand", F.lit(a), F.lit(b)) for a, b in D.BRAND_VARIANTS])
    own = dict_norm(F.col("brand"))
    for brand, more in D.BRAND_SPELLINGS.items():
        named = F.when(own == brand, F.concat(named, F.array(*map(F.lit, more)))).otherwise(named)
    names = brands.select("pos", "brand", F.posexplode(named).alias("alias_pos", "name"))
    names = names.withColumn("norm", dict_norm(F.col("name")))
    return (
        names.groupBy("pos", "brand", "norm").agg(F.min("alias_pos").alias("alias_pos"))
        .select("pos", "alias_pos", "brand", "norm", F.replace("norm", F.lit(" "), F.lit("")).alias("compact"))
    )


def load_brands(spark: SparkSession, path: str) -> list[Alias] | DataFrame:
    """The brands of a JSON list, or of a folder of them, for ``parse``: literals, or a table of any size.

    At most ``MAX_ENTRIES`` and one rows come to the driver.
    """
    brands = written(_brand_set(spark, path), "brands")  # files are read once
    table = alias_frame(brands)
    if brands.count() > MAX_ENTRIES:  # and as many aliases, or more
        return written(table, "aliases")
    rows = table.limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        return written(table, "aliases")
    return sorted((Alias(*r) for r in rows), key=lambda a: (-len(a.compact), a.pos, a.alias_pos))


def load_stores(spark: SparkSession, path: str) -> list[StoreAlias] | DataFrame:
    """The stores of a JSON object for ``parse``, behind those that come first anyway.

    Literals, or a table (pos, compact, store) of any size.
    """
    table = read_stores(spark, path)
    rows = table.orderBy("pos").limit(MAX_ENTRIES + 1).collect()
    if len(rows) <= MAX_ENTRIES:
        return store_aliases([(r.alias, r.store) for r in rows])
    first = spark.createDataFrame(store_aliases(()), STORE_TABLE)
    return written(first.unionByName(table.select("pos", F.replace("alias", F.lit(" "), F.lit("")).alias("compact"), "store")), "stores")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(pos, product, word) of a JSON list of {"product": ..., "words": [...]}; words are normal forms."""
    text = _whole_files(spark, path)
    kind = "array<struct<product:string,words:array<string>>>"
    rules = text.select(F.posexplode(F.from_json("value", kind)).alias("pos", "r"))
    return rules.select("pos", F.col("r.product").alias("product"), F.explode(F.transform("r.words", norm)).alias("word"))


def load_rules(spark: SparkSession, path: str) -> list[Rule] | DataFrame:
    """Product rules for ``parse``: literals, or a table (pos, product, word) of any size."""
    table = read_rules(spark, path)
    rows = table.limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        return written(table, "rules")
    found: dict[int, tuple[str, list[str]]] = {}
    for r in rows:
        found.setdefault(r.pos, (r.product, []))[1].append(r.word)
    return [Rule(pos, product, tuple(words)) for pos, (product, words) in sorted(found.items())]


STORE_TABLE = "pos int, compact string, store string"
RULE_TABLE = "pos int, product string, word string"


def store_table(spark: SparkSession, stores: Sequence[StoreAlias] | DataFrame) -> DataFrame:
    return stores if isinstance(stores, DataFrame) else spark.createDataFrame(stores, STORE_TABLE)


def rule_table(spark: SparkSession, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    if isinstance(rules, DataFrame):
        return rules
    return spark.createDataFrame([(r.pos, r.product, w) for r in rules for w in r.words], RULE_TABLE)


def joined(entries: Sequence | DataFrame) -> bool:
    """Whether a dictionary is joined: it is a table, or too long for literals."""
    return isinstance(entries, DataFrame) or len(entries) > MAX_ENTRIES


def brand_alias_table(spark: SparkSession, brands: Iterable[str] = D.BRANDS) -> DataFrame:
    return spark.createDataFrame(brand_aliases(brands), "pos int, alias_pos int, brand string, norm string, compact string")


def store_aliases(stores: Iterable[tuple[str, str]] = D.STORES) -> list[StoreAlias]:
    """Names of stores in the order in which they are tried, those that come first anyway ahead."""
    named: dict[str, str] = {}
    for alias, store in stores:
        named[py_dict_norm(alias)] = store
    rows = [*D.STORE_FIRST, *named.items()]
    return [StoreAlias(i - len(D.STORE_FIRST), a.replace(" ", ""), s) for i, (a, s) in enumerate(rows)]


def product_rules(rules: Iterable[tuple[str, Sequence[str]]] = D.PRODUCT_RULES) -> list[Rule]:
    return [Rule(i, name, tuple(py_norm(w) for w in words)) for i, (name, words) in enumerate(rules)]

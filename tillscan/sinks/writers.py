"""Writing exports and the brand catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscan.sources.files import write_files

#: Names in one list of a catalog: more are several lists, each the work of one task.
LIST_NAMES = 100_000


def write_exports(response: DataFrame, path: str, column: str = "csv") -> None:
    """One Parquet row for each receipt: its id and the export in ``column``."""
    response.select("receipt_id", column).write.mode("overwrite").parquet(path)


def write_export_files(response: DataFrame, path: str, column: str = "csv", mode: str = "append") -> None:
    """One text file for each receipt, with its export as it is (K1-K3); a failed job leaves no file."""
    suffix = {"csv": ".csv", "tsv": ".tsv"}.get(column, ".txt")
    write_files(response, path, "receipt_id", column, mode, suffix=suffix)


def _list_json() -> Column:
    names = F.sort_array(F.collect_list(F.struct(F.lower("brand").alias("k"), "brand")))
    return F.to_json(F.transform(names, lambda n: n["brand"]), {"pretty": "true"}).alias("value")


def catalog_json(catalog: DataFrame) -> DataFrame:
    """The catalog as one spaced JSON list, sorted regardless of case (K7); small by nature."""
    return catalog.agg(_list_json())


def catalog_lists(catalog: DataFrame, lists: int) -> DataFrame:
    """(name, value): a catalog of any size as about so many lists, which one after the other by name are ``catalog_json``'s."""
    ranges = catalog.select("brand").repartitionByRange(lists, F.lower("brand"), "brand")
    parts = ranges.withColumn("part", F.spark_partition_id()).groupBy("part").agg(_list_json())
    return parts.select(F.format_string("catalog-%010d", "part").alias("name"), "value")


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Replace the catalog as a whole: the new one is there before the old one goes.

    It is one file, or beyond ``LIST_NAMES`` names several, each a list of about so many. Reads ``catalog`` several times.
    """
    lists = 1 + catalog.count() // LIST_NAMES
    one = catalog_json(catalog).select(F.lit("catalog").alias("name"), "value")
    files = one if lists == 1 else catalog_lists(catalog, lists)
    write_files(files, path, "name", "value", "overwrite", suffix=".json")

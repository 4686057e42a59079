"""Queries that write files and read them back: uploads, one export a receipt."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillscan.operators import export as E
from tillscan.plans import rendered as R
from tillscan.plans.registry import _FIELD, _quoted, query
from tillscan.sinks.shared import shared_folder
from tillscan.sinks.writers import write_export_files
from tillscan.sources.files import read_files, write_files
from tillscan.sources.receipts import read_uploads


@query(
    """
SELECT p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.png' END AS name,
  CASE WHEN p_partkey % 3 < 2 THEN 'pdf' ELSE 'image' END AS kind,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS content,
  CASE WHEN p_partkey % 5 = 0 THEN 'Subi una imagen o PDF de la factura.' END AS message
FROM part
"""
)
def upload_files(spark, sf_dir):
    """Files of a folder, the empty ones among them as errors."""
    key = F.col("p_partkey")
    suffix = F.when(key % 3 == 0, ".pdf").when(key % 3 == 1, ".PDF").otherwise(".png")
    content = F.when(key % 5 == 0, F.lit("")).otherwise(F.col("p_name"))
    path = shared_folder(spark, "uploads")
    files = R.spread(R.table(spark, sf_dir, "part")).select(F.concat(key, suffix).alias("name"), content.alias("content"))
    write_files(files, path, "name", "content")
    found = read_uploads(spark, path)
    return found.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "kind", F.col("content").cast("string").alias("content"), "message"
    )


@query(
    f"""
WITH f AS (SELECT p_partkey, {_FIELD} AS v FROM part), q AS (SELECT p_partkey, {_quoted("v", "'|'")} AS f FROM f)
SELECT p_partkey || '.csv' AS name, f || '|0' || chr(10) || f || '|1' AS content FROM q
"""
)
def export_files(spark, sf_dir):
    """K1, K4, K5: one file a receipt with fields that need quotes, as it was written."""
    key = F.col("p_partkey")
    mark = F.when(key % 5 == 0, "|").when(key % 5 == 1, "\t").when(key % 5 == 2, '"q"').when(key % 5 == 3, "\n").otherwise("\r")
    field = F.concat("p_name", mark, F.col("p_size").cast("string"))
    rows = R.table(spark, sf_dir, "part").select(key.alias("receipt_id"), field.alias("v"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    lines = F.sort_array(F.collect_list(F.struct("n", E.export_row("|", ("v", "n")).alias("line"))))
    exports = rows.groupBy("receipt_id").agg(F.array_join(lines["line"], "\n").alias("csv"))
    path = shared_folder(spark, "exports")
    write_export_files(exports, path)
    return read_files(spark, path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").cast("string").alias("content")
    )

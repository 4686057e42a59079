"""Receipts from files, OCR replies and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscan import dictionaries as D
from tillscan.sources.files import read_files

LARGE_UPLOAD_MESSAGE = "El archivo supera los 20 MB."


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(receipt_id, raw_text) of text files, one receipt a file; the id is the path."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("receipt_id"), F.col("value").alias("raw_text"))


def uploads(files: DataFrame) -> DataFrame:
    """(path, kind, content, message) of files (path, length, content).

    ``kind`` is ``pdf`` by the suffix, else ``image``; a file that is empty or too large to be
    read has a message instead of a result.
    """
    too_large = F.col("content").isNull() & (F.col("length") > 0)
    return files.select(
        "path",
        F.when(F.lower("path").endswith(".pdf"), "pdf").otherwise("image").alias("kind"),
        "content",
        F.when(F.col("length") == 0, D.EMPTY_UPLOAD_MESSAGE).when(too_large, LARGE_UPLOAD_MESSAGE).alias("message"),
    )


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploads from a folder; empty files, and those over 20 MB, are rows with a message."""
    return uploads(read_files(spark, path))


OCR_REPLY = "error string, text string, variant string, lines array<struct<text:string,score:double,top:double,left:double>>"


def decode_replies(df: DataFrame, reply_col: str = "reply") -> DataFrame:
    """OCR replies in JSON as columns (S8): ``text`` if usable, else ``message``."""
    reply = df.withColumn("__r", F.from_json(reply_col, OCR_REPLY))
    error, text = F.col("__r.error"), F.coalesce(F.col("__r.text"), F.lit(""))
    blank = F.trim(F.regexp_replace(text, r"\s+", " ")) == ""
    message = F.when(
        error.isNotNull() & (F.trim(error) != ""), F.concat(F.lit(D.OCR_ERROR_PREFIX), error)
    ).when(blank, F.lit(D.EMPTY_TEXT_MESSAGE))
    kept = [c for c in df.columns if c not in (reply_col, "text", "variant", "lines", "message")]
    return reply.select(
        *kept,
        F.when(message.isNull(), text).alias("text"),
        F.col("__r.variant").alias("variant"),
        F.col("__r.lines").alias("lines"),
        message.alias("message"),
    )


def join_pages(pages: DataFrame, id_col: str = "receipt_id", page_col: str = "page", text_col: str = "text") -> DataFrame:
    """(receipt_id, raw_text): the pages of a document in order, a blank line between (S3, A3)."""
    ordered = F.sort_array(F.collect_list(F.struct(page_col, text_col)))
    return pages.groupBy(id_col).agg(
        F.array_join(F.transform(ordered, lambda p: p[text_col]), "\n\n").alias("raw_text")
    )


def rejects(df: DataFrame, id_col: str = "receipt_id") -> DataFrame:
    """(id, message) of what could not be used (K8)."""
    return df.filter(F.col("message").isNotNull()).select(id_col, "message")

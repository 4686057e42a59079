"""Receipts to lines, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscan.functions.text import clean_noise, is_blank, norm, trim_controls


def is_tidy(raw: Column) -> Column:
    """Whether splitting at line feeds alone gives trimmed lines, none of them blank; plain searches over the whole text."""
    ends = (raw >= "!") & (F.right(raw, F.lit(1)) >= "!")  # strings are ordered by their bytes
    loose = raw.contains("\n ") | raw.contains(" \n") | raw.contains("\n\n")
    return F.coalesce(ends & ~loose & raw.rlike(r"\A[ -~\n\u00a1-\u024f]*+\z"), F.lit(False))


def split_lines(raw: Column, tidy: Column | None = None) -> Column:
    """Trimmed lines that are not blank, in order (S9). ``tidy`` is ``is_tidy``, if there is a column that has it."""
    lines = F.transform(F.split(F.coalesce(raw, F.lit("")), "\r\n|\r|\n", -1), lambda x: trim_controls(x))
    # Bodies of lambdas are interpreted for each line, and a pattern to split by is built for each text.
    plain = F.split(raw, "\n", -1)
    return F.when(is_tidy(raw) if tidy is None else tidy, plain).otherwise(F.filter(lines, lambda x: ~is_blank(x)))


def receipt_lines(receipts: DataFrame) -> DataFrame:
    """(receipt_id, line_no, line, clean, norm), one row for each line."""
    lines = receipts.select("receipt_id", F.posexplode(split_lines(F.col("raw_text"))).alias("line_no", "line"))
    cleaned = lines.withColumn("clean", clean_noise(F.col("line")))
    return cleaned.withColumn("norm", norm(F.col("clean")))

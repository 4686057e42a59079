"""Brands learned in reading order (A4, B4, J8): what a line teaches, later lines know.

A line of the standard layout that no brand of the catalog starts, and none learned before it,
teaches its fallback brand. Lines are not read one by one: only the first line of each
description can teach (after it the description has a brand), so the question is which of
these first lines were met by a name learned still earlier. That is a fixpoint over
positions. A round takes every name's position from the last one and drops the lines that an
earlier name starts; no round changes anything any more after as many as names depend on one another in a chain.
Its one solution is what reading in order gives.

A position is a struct of the order columns, compared as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscan.functions.text import clean_brand, compact, dict_norm
from tillscan.operators.brands import can_learn, fallback_brand
from tillscan.operators.containment import contained, starting
from tillscan.sinks.shared import written
from tillscan.sources.dictionaries import alias_frame


def teaching_lines(items: DataFrame, text_col: str, order: Sequence[str]) -> DataFrame:
    """(compact, norm, brand, at): each description that could teach a brand, where it stands first.

    ``items`` are those of the standard layout without a brand of the catalog.
    """
    brand = fallback_brand(F.col(text_col))["brand"]
    rows = items.select(
        compact(dict_norm(F.col(text_col))).alias("compact"), brand.alias("fallback"), F.struct(*order).alias("at")
    ).filter(can_learn(F.col("fallback")))
    rows = rows.select("compact", dict_norm(F.col("fallback")).alias("norm"), clean_brand(F.col("fallback")).alias("brand"), "at")
    first = F.min(F.struct("at", "brand")).alias("f")
    return rows.groupBy("compact", "norm").agg(first).select("compact", "norm", F.col("f.brand").alias("brand"), F.col("f.at").alias("at"))


def _spelled(names: DataFrame) -> DataFrame:
    """(norm, alias, pattern) of every spelling of (norm, brand)."""
    aliases = alias_frame(names.select(F.lit(0).alias("pos"), "brand"))
    return aliases.select(
        dict_norm(F.col("brand")).alias("norm"), F.col("norm").alias("alias"), F.col("compact").alias("pattern")
    ).distinct()


def learned_in_order(items: DataFrame, text_col: str, order: Sequence[str]) -> DataFrame:
    """(norm, brand, at): the brands that reading ``items`` in order teaches, and from where on.

    ``items`` are those of the standard layout without a brand of the catalog.
    """
    lines = written(teaching_lines(items, text_col, order), "teaching")
    first = F.min(F.struct("at", "brand")).alias("f")

    def taught(rows: DataFrame) -> DataFrame:
        return rows.groupBy("norm").agg(first).select("norm", F.col("f.brand").alias("brand"), F.col("f.at").alias("at"))

    names = taught(lines)
    spelled = _spelled(names).withColumnRenamed("norm", "other")
    texts = lines.select(F.col("compact").alias("text")).distinct()
    met = starting(texts, spelled.select("pattern").distinct()).join(spelled.select("pattern", "other"), "pattern")
    # Names of others that start the description of a line: the line teaches nothing once one is known.
    pairs = lines.join(met.select(F.col("text").alias("compact"), "other").distinct(), "compact").filter("norm <> other")
    pairs = written(pairs.select("compact", "norm", "other"), "met")
    names = written(names, "names")
    while True:
        known = pairs.join(names.select(F.col("norm").alias("other"), F.col("at").alias("known_at")), "other")
        earliest = known.groupBy("compact", "norm").agg(F.min("known_at").alias("known_at"))
        free = lines.join(earliest, ["compact", "norm"], "left").filter("known_at IS NULL OR known_at >= at")
        new = written(taught(free), "names")
        same = names.select("norm", F.col("at").alias("old")).join(new.select("norm", "at"), "norm", "full")
        if same.filter(~F.col("at").eqNullSafe(F.col("old"))).isEmpty():
            return new
        names = new


def with_learned_brands(df: DataFrame, text_col: str, app: Column, order: Sequence[str]) -> DataFrame:
    """``df`` with its ``known`` (brand, alias, or null) of the catalog replaced where a brand
    learned before the row has a longer alias: at the start of the text, or anywhere where ``app`` holds.

    Of equal aliases the catalog's comes first, then the one learned first.
    """
    keyed = df.withColumns({"__c": compact(dict_norm(F.col(text_col))), "__app": F.coalesce(app, F.lit(False)), "__at": F.struct(*order)})
    learned = learned_in_order(keyed.filter("NOT __app AND known IS NULL").select(text_col, *order), text_col, order)
    spelled = written(_spelled(learned).join(learned, "norm").select("pattern", "alias", "brand", "at"), "learned")
    patterns = spelled.select("pattern").distinct()

    def hits(flag: bool) -> DataFrame:
        texts = keyed.filter(F.col("__app") == flag).select(F.col("__c").alias("text")).distinct()
        found = (contained if flag else starting)(texts, patterns).join(spelled, "pattern")
        hit = F.struct(F.length("pattern").alias("n"), "at", "brand", "alias")
        # A text has as many as it has substrings that are brands.
        rows = found.groupBy("text").agg(F.collect_list(hit).alias("__hits"))
        return rows.select(F.col("text").alias("__c"), F.lit(flag).alias("__app"), "__hits")

    joined = keyed.join(hits(False).unionByName(hits(True)), ["__c", "__app"], "left")
    have = F.filter("__hits", lambda h: h["at"] < F.col("__at"))
    longest = F.array_max(F.transform(have, lambda h: h["n"]))
    best = F.array_min(F.transform(F.filter(have, lambda h: h["n"] == longest), lambda h: F.struct(h["at"], h["brand"], h["alias"])))
    of_catalog = F.coalesce(F.length(compact(F.col("known.alias"))), F.lit(-1))
    chosen = F.when(longest > of_catalog, F.struct(best["brand"].alias("brand"), best["alias"].alias("alias"))).otherwise(F.col("known"))
    return joined.withColumn("known", chosen).select(*df.columns)

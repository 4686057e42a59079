"""Which patterns stand in which texts, for tables of patterns of any size.

Patterns of 3 characters or more are found by their own text: a table of their first 3-grams with the lengths that
follow each (as many rows as there are 3-grams of normal forms, whatever the number of patterns) says at which
places of a text which substrings are worth a look, and these meet the patterns by an equal join. So a
text of n characters is at most n rows for each length, and never meets a pattern that it only resembles.
Patterns of one or two characters are met by substrings of that length; an empty one is in
every text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscan.sinks.shared import written

GRAM = 3
#: A text of more rows than this, and than one in so many of all, takes its answer from a broadcast (of fewer rows than ``HOT_SHARE``).
HOT_ROWS, HOT_SHARE = 1000, 100_000


def substrings(text: Column, n: int) -> Column:
    """The different substrings of ``n`` characters; none of a shorter text."""
    found = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def text_grams(texts: DataFrame) -> DataFrame:
    """(text, gram) of a table (text)."""
    return texts.select("text", F.explode(substrings(F.col("text"), GRAM)).alias("gram"))


def filed(patterns: DataFrame, grams: DataFrame) -> DataFrame:
    """(pattern, gram): each pattern of 3 characters or more under its rarest gram, if texts have all of them."""
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    own = substrings(F.col("pattern"), GRAM)
    rows = patterns.filter(F.length("pattern") >= GRAM).select("pattern", F.size(own).alias("wanted"), F.explode(own).alias("gram"))
    rarest = F.min(F.struct("n", "gram"))
    met = rows.join(counts, "gram").groupBy("pattern", "wanted").agg(rarest.alias("r"), F.count("*").alias("found"))
    return met.filter("found = wanted").select("pattern", F.col("r.gram").alias("gram"))


def beginnings(patterns: DataFrame) -> DataFrame:
    """(gram, lengths): the first 3-grams of patterns of 3 characters or more, and the lengths of those."""
    rows = patterns.filter(F.length("pattern") >= GRAM)
    return rows.groupBy(F.substr("pattern", F.lit(1), F.lit(GRAM)).alias("gram")).agg(F.collect_set(F.length("pattern")).alias("lengths"))


def pieces(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, place, pattern): substrings of texts that begin and are as long as some pattern."""
    n = F.length("text")
    grams = F.transform(F.sequence(F.lit(1), n - (GRAM - 1)), lambda i: F.substr("text", i, F.lit(GRAM)))
    rows = texts.filter(n >= GRAM).select("text", F.posexplode(grams).alias("at", "gram"))
    cuts = rows.join(F.broadcast(beginnings(patterns)), "gram").select("text", (F.col("at") + 1).alias("place"), F.explode("lengths").alias("n"))
    whole = cuts.filter(F.col("place") + F.col("n") - 1 <= F.length("text"))
    return whole.select("text", "place", F.substr("text", "place", "n").alias("pattern"))


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern): every pattern in every text; both tables have different rows, nulls match nothing."""
    # Both sides grow with the data: a merge join, which takes nothing to the driver.
    met = pieces(texts, patterns).join(patterns.filter(F.length("pattern") >= GRAM).hint("merge"), "pattern")
    # Of several places in a text the first counts.
    long = met.filter(F.position("pattern", "text") == F.col("place")).select("text", "pattern")
    small = F.concat(substrings(F.col("text"), 1), substrings(F.col("text"), 2))
    short = texts.select("text", F.explode(small).alias("pattern")).join(patterns.filter(F.length("pattern") < GRAM), "pattern")
    # At most one row.
    empty = F.broadcast(patterns.filter("pattern = ''").select(F.lit(True).alias("__all")).limit(1))
    every = texts.filter("text IS NOT NULL").withColumn("__all", F.lit(True)).join(empty, "__all")
    return long.unionByName(short.select("text", "pattern")).unionByName(every.select("text", F.lit("").alias("pattern")))


def starting(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern): every pattern that a text begins with.

    The different lengths of patterns (few) are gathered; a text is as many rows.
    """
    lengths = sorted(r[0] for r in patterns.select(F.length("pattern")).distinct().collect() if r[0] is not None)
    if not lengths:
        return texts.select("text", F.lit(None).cast("string").alias("pattern")).limit(0)
    cuts = F.transform(
        F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("text")), lambda n: F.substr(F.col("text"), F.lit(1), n)
    )
    return texts.select("text", F.explode(cuts).alias("pattern")).join(patterns.hint("merge"), "pattern").select("text", "pattern")


def answered(df: DataFrame, text_col: str, answers: Callable[[DataFrame], DataFrame], into: str) -> DataFrame:
    """``df`` with ``into``: what ``answers`` says of its text, or null. ``answers`` takes different texts (text), gives (text, into).

    Frequent texts are not dealt by text, which would make one task of each: their answers go to the rows. Rows know their
    text by 128 bits of hash. ``df`` is read several times; runs jobs at once.
    """
    keys = ["__t1", "__t2"]

    def keyed(rows: DataFrame, text: str) -> DataFrame:
        return rows.withColumns({"__t1": F.xxhash64(text), "__t2": F.xxhash64(F.lit(1), text)})

    counts = written(df.groupBy(F.col(text_col).alias("text")).agg(F.count("*").alias("n")), "texts")
    found = written(keyed(answers(counts.select("text")), "text").select(*keys, into), "answers")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = keyed(counts.filter(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)), "text").select(*keys, F.lit(True).alias("__hot"))
    rows = keyed(df, text_col).join(F.broadcast(often.join(found, keys, "left")), keys, "left")
    rare = rows.filter("__hot IS NULL").drop(into).join(found, keys, "left")
    return rows.filter("__hot").unionByName(rare).drop(*keys, "__hot")

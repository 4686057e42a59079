"""Operator 5, line dedup: one native plan, no Python on the executors.

Lines are exploded and normalised, hashed to 128 bits, counted by distinct document per
hash, and dropped where the count reaches the threshold, except in the smallest document
that holds the line. What stays is put together again by position.

Defined cases: null or empty text is one empty line; a null ``doc_id`` counts as one
document that sorts before all others; rows that repeat both ``doc_id`` and text are the
same document and get the same result each; columns of the input that carry the name of a
result column are replaced, all other columns pass through; an empty table stays empty.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, cut, hash128, id_or_least, table

#: Rows of one line that one task may take in a join, and a bound of the lines that are broadcast.
HOT_LINES, HOT_KEYS = 1000, 100_000


def line_key(line: Column) -> Column:
    """The line without outer white space and with A-Z in lower case."""
    return F.translate(
        F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase
    )


def _without(lines: Column, drops: Column) -> Column:
    """``lines`` without the positions ``drops``, in time linear in both."""

    def run(ls: Column) -> Column:
        edges = F.concat(F.array(F.lit(-1)), F.sort_array(drops), F.array(F.size(ls)))
        return F.transform(
            F.array(edges),
            lambda e: F.flatten(
                F.transform(
                    F.sequence(F.lit(1), F.size(e) - 1),
                    lambda i: F.slice(
                        ls,
                        F.get(e, i - 1) + 2,
                        F.get(e, i) - F.get(e, i - 1) - 1,
                    ),
                )
            ),
        )[0]

    # A one-element transform binds the split once; the lambda variable is then reused.
    return F.transform(F.array(lines), run)[0]


def _repeated(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, first, n): hashes of enough documents, their least document and their lines.

    Aggregated before the exchange, so a frequent line is one row for each task.
    """
    if min_docs == 2:
        seen = lines.groupBy("h1", "h2").agg(
            F.min("__doc").alias("first"), F.max("__doc").alias("last"), F.count("*").alias("n")
        )
        return seen.filter("first <> last").drop("last")
    by_doc = lines.groupBy("h1", "h2", "__doc").agg(F.count("*").alias("n"))
    seen = by_doc.groupBy("h1", "h2").agg(
        F.min("__doc").alias("first"), F.count("*").alias("docs"), F.sum("n").alias("n")
    )
    return seen.filter(F.col("docs") >= min_docs).drop("docs")


def _hits(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose hash is in ``repeated`` and whose document is not its first.

    Lines with more than ``HOT_LINES`` rows, and more than one in ``HOT_KEYS`` of all, meet
    their document in a broadcast table (so of less than ``HOT_KEYS`` rows, whatever the
    input); in the exchange for the others they take a key of their own each.
    """
    seen = repeated.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    bound = max(HOT_LINES, (seen.rows or 0) // HOT_KEYS)
    if (seen.most or 0) <= bound:
        return lines.join(repeated.drop("n"), ["h1", "h2"]).filter("__doc <> first")
    hot = repeated.filter(F.col("n") > bound).select("h1", "h2", F.col("first").alias("hot_first"))
    cold = repeated.filter(F.col("n") <= bound).select("h1", "h2", "first")
    marked = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    known = F.col("hot_first").isNotNull()
    own = hash128(F.col("__doc"), F.col("__row"), F.col("pos"))
    keyed = marked.select(
        "__doc", "__row", "pos", "hot_first",
        F.when(known, own[0]).otherwise(F.col("h1")).alias("h1"),
        F.when(known, own[1]).otherwise(F.col("h2")).alias("h2"),
    )
    met = keyed.join(cold, ["h1", "h2"], "left")
    return met.filter(F.col("__doc") != F.coalesce("hot_first", "first"))


def dedup_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
) -> DataFrame:
    """All rows of ``df`` with ``text_col`` rewritten, plus ``n_lines`` and ``n_dropped``.

    A line is dropped if its key has ``min_chars`` code points or more and occurs in
    ``min_docs`` distinct documents or more, unless it stands in the smallest of them.
    Only hashes, ids and positions are shuffled by line, and no line's rows meet in one
    task: see ``_repeated`` and ``_hits``. Only texts that lose lines are split again.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.withColumns(
        {"__doc": id_or_least(F.col(id_col)), "__row": F.xxhash64(text)}
    )
    h1, h2 = hash128(F.col("key"))
    lines = (
        base.select(
            "__doc", "__row", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")
        )
        .select("__doc", "__row", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("__doc", "__row", "pos", h1.alias("h1"), h2.alias("h2"))
    )
    drops = (
        _hits(lines, cut(_repeated(lines, min_docs)))
        .groupBy("__doc", "__row")
        .agg(F.collect_set("pos").alias("__drops"))
    )
    kept = F.when(F.col("__drops").isNull(), text).otherwise(
        F.array_join(_without(F.split(text, "\n", -1), F.col("__drops")), "\n")
    )
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return base.join(drops, ["__doc", "__row"], "left").withColumns(
        {
            "n_lines": (feeds + 1).cast("long"),
            "n_dropped": F.coalesce(F.size("__drops"), F.lit(0)).cast("long"),
            text_col: kept,
        }
    ).drop("__doc", "__row", "__drops")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d
), k AS (
  SELECT *, translate(
      trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.doc_id, k.line, k.pos,
         r.key IS NOT NULL AND k.doc_id <> r.first_doc AS dropped
  FROM k LEFT JOIN r ON k.key = r.key AND length(k.key) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), ''))
         AS kept_sha256
FROM m GROUP BY doc_id
"""

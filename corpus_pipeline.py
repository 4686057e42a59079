"""The corpus pipeline: five stages over ``documents``, each one of the operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
All but the last return the columns of ``documents``; the last returns the token ids of
each document of the mix, so a document that the mix repeats comes repeatedly.

Defined cases: a null text has no words, so the first stage drops it; a null id or source is a value
like any other; of rows alike in all columns, or in id and text alone, the third stage keeps one, the least; an
empty table gives an empty result; columns beyond ``COLUMNS`` play no part and are dropped by
the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscan.llm import bpe, line_dedup, mixing, near_dedup, quality
from tillscan.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.label_documents(docs, model).filter("kept").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; ``n_chars`` follows the text."""
    lines = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return lines.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.keep_one_of_each(docs.select(*COLUMNS), weight="count")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of the text decoded from them."""
    return bpe.bpe_columns(
        docs.select("doc_id", "source", "text"),
        bpe.public_path(),
        outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"),
        keep_text=False,
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Trained labels, signatures and sampling have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

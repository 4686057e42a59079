"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word definition ``[^\x20\x09-\x0D]+``.
WHITE = " \t\n\x0b\x0c\r"
#: The word definition as a Java and Python pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, by a path that only Spark has to be able to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes, used together as a 128-bit key.

    At 10^12 keys a collision of both has a chance of about 10^-15.
    """
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5BD1E995), *cols)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names. A local one serves only a single process (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tillscan-checkpoint-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that nobody has used, below the one that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        ensure_checkpoint_dir(spark)
        named = spark.sparkContext.getCheckpointDir()
    return f"{named}/{name}-{uuid.uuid4().hex}"


#: Rows of a narrow table that one checkpoint file should hold at least.
FILE_ROWS = 100_000


def cut(df: DataFrame, at_most: int | None = None) -> DataFrame:
    """Materialise in the shared checkpoint folder; survives lost executors.

    ``at_most`` is a known upper bound of the rows. A table that small is written by as many
    tasks as it needs, not by one for each shuffle partition, which spares the shared
    folder thousands of tiny files.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if at_most is not None:
        df = df.coalesce(1 + at_most // FILE_ROWS)
    return df.checkpoint(eager=True)


def id_or_least(col: Column) -> Column:
    """A long id in which null sorts before every other value."""
    return F.coalesce(col.cast("long"), F.lit(-(2**63)))


#: DuckDB SQL: the table of the CRC-32 of zlib, one list of 256 entries, from the polynomial.
CRC_SQL = """
crc_steps AS (
  SELECT range AS i, range::UBIGINT AS v, 0 AS k FROM range(256) UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM crc_steps WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY i) AS crc_t FROM crc_steps WHERE k = 8)
"""


def crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes, beside ``crc_table``."""
    code = f"hex(encode({text}))"
    values = f"list_transform(range(length({code}) // 2), lambda j: ('0x' || substr({code}, 2 * j + 1, 2))::UBIGINT)"
    step = "xor(c >> 8, crc_t[((xor(c, b) & 255) + 1)::BIGINT])"
    whole = f"list_reduce(list_prepend(4294967295::UBIGINT, {values}), lambda c, b: {step})"
    return f"xor(4294967295::UBIGINT, {whole})::BIGINT"

"""Whole files: empty ones are read, and a failed write leaves nothing."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tillscan import dictionaries as D
from tillscan.sinks.writers import write_catalog, write_export_files
from tillscan.sources.dictionaries import read_brands
from tillscan.sources.files import read_files, write_files
from tillscan.sources.receipts import LARGE_UPLOAD_MESSAGE, uploads


def names(path):
    return sorted(os.path.join(d, f)[len(str(path)) :] for d, _, fs in os.walk(path) for f in fs)


def test_all_files_in_partitions_by_size(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "_hidden").mkdir()
    for name, data in (("a.txt", b""), ("deep/b.png", b"\x00\xff"), ("deep/er/ñ c.PDF", b"x" * 50), ("_hidden/no", b"n"), (".no", b"n")):
        (tmp_path / name).write_bytes(data)
    df = read_files(spark, str(tmp_path), partitionBytes=1, maxBytes=40)
    assert df.rdd.getNumPartitions() == 3
    got = {r.path.rsplit("/")[-1]: (r.length, r.content, r.message) for r in df.join(uploads(df).select("path", "message"), "path").collect()}
    assert got == {
        "a.txt": (0, b"", D.EMPTY_UPLOAD_MESSAGE), "b.png": (2, b"\x00\xff", None), "ñ c.PDF": (50, None, LARGE_UPLOAD_MESSAGE),
    }
    assert [r.length for r in read_files(spark, f"file://{tmp_path}", suffixes=".pdf,.txt").collect()] == [0, 50]


def test_empty_folder(spark, tmp_path):
    assert read_files(spark, str(tmp_path)).collect() == []


def test_round_trip_of_awkward_names_and_texts(spark, tmp_path):
    rows = [("a/b", 'q"|\n\r\t'), ("..", "ñ"), ("same", "1"), ("same", "2"), (None, None), ("", "e")]
    df = spark.createDataFrame(rows, "receipt_id string, csv string").coalesce(1)
    write_export_files(df, str(tmp_path))
    got = sorted((r.path.rsplit("/")[-1], r.content.decode()) for r in read_files(spark, str(tmp_path)).collect())
    named = ("a%2Fb", rows[0][1]), ("%2E.", "ñ"), ("same", "1"), ("same~2", "2"), ("None", ""), ("%", "e")
    assert got == sorted((f"{n}.csv", c) for n, c in named)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    write_files(spark.createDataFrame([("old", "1")], "n string, c string"), str(tmp_path), "n", "c")
    before = names(tmp_path)
    bad = spark.range(0, 40, 1, 4).select(
        F.col("id").cast("string").alias("n"), F.when(F.col("id") == 33, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("c")
    )
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="no"):
            write_files(bad, str(tmp_path), "n", "c", mode)
        assert names(tmp_path) == before and len(os.listdir(tmp_path)) == 1


def test_overwriting_keeps_one_run(spark, tmp_path):
    for k in (1, 2):
        df = spark.createDataFrame([(f"Marca {k}",), ("añil",)], "brand string")
        write_catalog(df, str(tmp_path))
        assert [r.brand for r in read_brands(spark, str(tmp_path)).orderBy("pos").collect()] == ["añil", f"Marca {k}"]
    assert len(os.listdir(tmp_path)) == 1

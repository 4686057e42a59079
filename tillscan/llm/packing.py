"""Operator 11, packing by concatenating and cutting.

All documents' ids stand in one long row, each document's closed by an end id; the row is cut
every ``size`` ids. Two passes of prefix sums give each document its place in that row.
The first is made by the tasks that tokenise: a running sum within the task's partition,
stored beside the ids. The second runs over the partitions' totals: within blocks of
``BLOCK`` partitions, and over the blocks. Windows are fixed then: window w holds the places from
w * size on, a document that crosses an edge is cut there, and each piece records its document,
its start in it, its sequence and its offset. Only the last sequence can be short.

Texts are tokenised once. Ids are written below ``spark.checkpoint.dir`` (two bytes each if the
vocabulary allows), with the number of the partition that wrote them, so what follows
does not depend on how a retry would deal rows. No text and no id is shuffled. The order
is that of the table's partitions; a caller who wants another sorts or shuffles before.

Tokenising: with ``apart`` (for vocabularies that drop white space, as the query's) a text is taken
apart at ASCII white space and before the stops of words, and a piece between is handed to the tokenizer once for each
Python worker, as long as its table has room; a very long text is taken in parts of
``PART_BYTES``. Without it the library gets whole texts.

Defined cases: null text is empty and has the end id alone; every row is a document of its own, rows
alike and null ids too; columns that carry the name of a result column are replaced, others
pass through when named in ``keep``; an empty table gives no pieces.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import batch_slices
from .common import new_folder, table

SIZE = 4096
#: Partitions in one block of the second pass.
BLOCK = 1024
#: Totals of so many partitions (24 bytes each) may be broadcast; beyond, they are joined.
BROADCAST_PARTS = 100_000
#: Pieces of texts whose ids a Python worker remembers, and their greatest length in bytes.
CACHE_WORDS, CACHE_BYTES = 800_000, 64
PART_BYTES = 1_000_000
#: Pieces in one call of the tokenizer, and what stands between them.
JOINED_PIECES, _SEPARATOR = 5000, b"\x01"
#: Stops between a letter or digit and white space: a token of their own, so a word with and without them is one piece.
_STOPS = r"([0-9A-Za-z])([.,!?;:]+)([ \t\n\x0b\x0c\r]|$)"
_WHITE = re.compile(rb"[ \t\n\x0b\x0c\r]")


class Encoder:
    """Ids of texts as bytes, two or four an id, as this machine orders them."""

    def __init__(self, raw: bytes, apart: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(raw)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.apart = apart
        most = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.kind = np.dtype(np.uint16 if most < 2**16 else np.uint32)
        self.known: dict[bytes, bytes] = {}

    def _library(self, texts: Sequence[bytes]) -> list[bytes]:
        strings = [t.decode("utf-8", "replace") for t in texts]
        found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return [array(self.kind.char, e.ids).tobytes() for e in found]

    def _pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces without white space, many in one text with a separator that none of them has."""
        plain = [p for p in pieces if _SEPARATOR not in p]
        odd = [p for p in pieces if _SEPARATOR in p]
        mark = self._library([_SEPARATOR])[0]
        size = self.kind.itemsize
        if len(mark) != size:  # the separator is no id of its own here
            plain, odd = [], pieces
        out = dict(zip(odd, self._library(odd), strict=True))
        for at in range(0, len(plain), JOINED_PIECES):
            part = plain[at : at + JOINED_PIECES]
            whole = self._library([(b" " + _SEPARATOR + b" ").join(part)])[0]
            cuts = size * np.flatnonzero(np.frombuffer(whole, self.kind) == np.frombuffer(mark, self.kind))
            begins, ends = [0, *(cuts + size).tolist()], [*cuts.tolist(), len(whole)]
            out.update((p, whole[b:e]) for p, b, e in zip(part, begins, ends, strict=True))
        return out

    def encode(self, texts: Sequence[bytes]) -> list[bytes]:
        """Ids of each text; of a few megabytes of texts at a time."""
        if not self.apart:
            return self._library(texts)
        out = [b""] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= PART_BYTES]
        for i, ids in zip(short, self._parts([texts[i] for i in short]), strict=True):
            out[i] = ids
        for i, t in enumerate(texts):
            if len(t) > PART_BYTES:
                out[i] = b"".join(self._parts([t[a:b]])[0] for a, b in spans(t, PART_BYTES))
        return out

    def _parts(self, texts: Sequence[bytes]) -> list[bytes]:
        """Each different piece between white space is tokenised once; its ids are put in its places."""
        spaced = pa.compute.replace_substring_regex(pa.array(texts, pa.binary()).cast(pa.string()), _STOPS, r"\1 \2\3")
        lists = pa.compute.ascii_split_whitespace(spaced)
        pieces = lists.flatten().dictionary_encode()
        different = pieces.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        known = self.known
        found = list(map(known.get, different))
        new = [i for i, f in enumerate(found) if f is None]
        made = self._pieces([different[i] for i in new])
        for i in new:
            found[i] = made[different[i]]
        if len(known) + len(made) > CACHE_WORDS:
            known.clear()
        known.update((p, f) for p, f in made.items() if len(p) <= CACHE_BYTES)
        ids = pa.array(found, pa.binary()).take(pieces.indices)
        _, offsets, data = ids.buffers()
        if data is None:
            return [b""] * len(texts)
        at = np.frombuffer(offsets, np.int32)[ids.offset :]
        edges, whole = at[lists.offsets.to_numpy()].tolist(), memoryview(data)
        return [bytes(whole[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def spans(text: bytes, size: int, breaks: re.Pattern[bytes] = _WHITE) -> Iterator[tuple[int, int]]:
    """Parts of about ``size`` bytes, each cut behind a byte that ``breaks`` finds."""
    begin = 0
    while len(text) - begin > size:
        found = breaks.search(text, begin + size)
        if not found:
            break
        yield begin, found.end()
        begin = found.end()
    yield begin, len(text)


#: Encoders of this Python worker, built once and kept between tasks.
_BUILT: dict[tuple[str, bool], Encoder] = {}


def _encoder(key: str, raw: bytes, apart: bool) -> Encoder:
    if (key, apart) not in _BUILT:
        _BUILT[key, apart] = Encoder(raw, apart)
    return _BUILT[key, apart]


_OWN = [T.StructField("__part", T.LongType()), T.StructField("__start", T.LongType()), T.StructField("__n", T.LongType()),
        T.StructField("__ids", T.BinaryType())]


def tokenise(df: DataFrame, tokenizer_path: str, end_id: int, text_col: str, keep: Sequence[str], apart: bool) -> DataFrame:
    """First pass: the ``keep`` columns, the row's partition, the ids before it in that partition, its ids."""
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    key = hashlib.sha256(raw).hexdigest()
    spec = df.sparkSession.sparkContext.broadcast(raw)
    schema = T.StructType([df.schema[c] for c in keep] + _OWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, spec.value, apart)
        end = np.array([end_id], encoder.kind).tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in batch_slices(whole, text_col):
                texts = [t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
                ids = [i + end for i in encoder.encode(texts)]
                n = np.array([len(i) // encoder.kind.itemsize for i in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                own = [pa.array(np.full(len(n), part)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep] + own, names=[*keep, *(f.name for f in _OWN)]
                )

    return df.select(*keep, *([text_col] if text_col not in keep else [])).mapInArrow(run, schema)


def bases(tokens: DataFrame) -> DataFrame:
    """Second pass: the ids before each partition, as (__part, __base)."""
    totals = tokens.groupBy("__part").agg(F.sum("__n").alias("n"))
    totals = totals.withColumn("block", F.floor(F.col("__part") / BLOCK))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("of_block"))
    # One row for each BLOCK partitions: 1,000 for a million.
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("of_block").over(before), F.lit(0)).alias("to_block"))
    within = Window.partitionBy("block").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("to_block") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return totals.join(blocks, "block").select("__part", base.alias("__base"))


PIECES = {
    "start": T.LongType(), "length": T.LongType(), "ids_crc32": T.LongType(), "doc_tokens": T.LongType(),
    "sequence_id": T.LongType(), "offset": T.LongType(), "ids": T.ArrayType(T.IntegerType()),
}


def cut_pieces(tokens: DataFrame, size: int, wide: bool, with_ids: bool) -> DataFrame:
    """Pieces of rows whose place in the long row is ``__base + __start``."""
    added = [c for c in PIECES if with_ids or c != "ids"]
    keep = [c for c in tokens.columns if not c.startswith("__")]
    schema = T.StructType([tokens.schema[c] for c in keep] + [T.StructField(c, PIECES[c]) for c in added])
    kind = np.dtype(np.uint32 if wide else np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batch_slices(whole, "__ids"):
                place = (batch.column("__base").to_numpy() + batch.column("__start").to_numpy()).astype(np.int64)
                n = batch.column("__n").to_numpy()
                first = place // size
                pieces = (place + n - 1) // size - first + 1
                row = np.repeat(np.arange(len(n)), pieces)
                sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = np.maximum(sequence * size, place[row])
                stop = np.minimum((sequence + 1) * size, (place + n)[row])
                # All ids of these rows in a row, four bytes each, as the digest reads them.
                ids = np.concatenate([np.empty(0, kind), *(np.frombuffer(i.as_py(), kind) for i in batch.column("__ids"))]).astype("<u4")
                head = (np.cumsum(n) - n)[row] + begin - place[row]
                data, length = memoryview(ids.tobytes()), stop - begin
                sums = [crc32(data[4 * h : 4 * (h + k)]) for h, k in zip(head.tolist(), length.tolist(), strict=True)]
                made = {
                    "start": begin - place[row], "length": length, "ids_crc32": np.array(sums, np.int64),
                    "doc_tokens": n[row], "sequence_id": sequence, "offset": begin - sequence * size,
                }
                columns = [batch.column(c).take(pa.array(row)) for c in keep] + [pa.array(v) for v in made.values()]
                if with_ids:
                    edges = np.append(head, head[-1] + length[-1] if len(head) else 0).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *added])

    return tokens.mapInArrow(run, schema)


def pack_documents(
    df: DataFrame,
    tokenizer_path: str,
    end_id: int,
    size: int = SIZE,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    apart: bool = False,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: the ``keep`` columns and ``PIECES`` (``ids`` only if asked for).

    Tokenising runs at once; pieces are made when the result is read.
    """
    spark = df.sparkSession
    keep = [c for c in keep if c not in PIECES]
    stored = f"{new_folder(spark, 'packing')}/tokens"
    tokenise(df, tokenizer_path, end_id, text_col, keep, apart).write.parquet(stored)
    tokens = spark.read.parquet(stored)
    places = bases(tokens)
    few = tokens.agg(F.max("__part")).first()[0] or 0
    tokens = tokens.join(F.broadcast(places) if few < BROADCAST_PARTS else places, "__part")
    # The width of an id follows from the vocabulary, and so from what is stored.
    wide = bool(tokens.filter(F.octet_length("__ids") > 2 * F.col("__n")).limit(1).count())
    return cut_pieces(tokens, size, wide, with_ids)


def sequences(pieces: DataFrame, size: int = SIZE, pad_id: int = 0, id_col: str = "doc_id") -> DataFrame:
    """The sequences themselves: (sequence_id, n_tokens, ids, boundaries), from pieces with ids.

    A sequence shorter than ``size`` is padded to it, unless its length is a power of two.
    ``boundaries`` has each piece's document, its start there, its offset and length here. A
    group is one sequence, so of ``size`` ids at most.
    """
    piece = F.struct("offset", "length", "start", F.col(id_col).alias(id_col), "ids")
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    ids = F.flatten(F.transform("p", lambda p: p["ids"]))
    n = F.size("own")
    whole = (n.bitwiseAND(n - 1)) == 0
    padded = F.when(whole, F.col("own")).otherwise(F.concat("own", F.array_repeat(F.lit(pad_id), F.lit(size) - n)))
    edges = F.transform("p", lambda p: F.struct(p[id_col].alias(id_col), p["start"].alias("start"), p["offset"].alias("offset"), p["length"].alias("length")))
    return rows.withColumn("own", ids).select("sequence_id", n.alias("n_tokens"), padded.alias("ids"), edges.alias("boundaries"))


def public_path() -> str:
    """The vocabulary that the query's contract names; it drops white space."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_path(), end_id=2, apart=True)

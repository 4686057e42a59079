"""Operator 4, BPE encoding and decoding with the vocabulary of a public tokenizer.

A word is merged with a priority queue of merge ranks over a doubly linked list of
symbols: the lowest rank goes first, the leftmost of equals before the others, and an
entry whose symbols have changed since it was queued is stale and skipped. Decoding
concatenates the vocabulary strings of the ids and reads the bytes as UTF-8.

The vocabulary (a file of bounded size) is read once on the driver and broadcast. Words
already merged are remembered in a table of at most ``CACHE_WORDS`` entries for each
Python worker; that only saves time.

Defined cases: null and empty texts have no tokens and decode to the empty string; rows
are mapped one by one, so repeated rows get equal results; extra columns pass through, and
those that carry the name of a result column are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table

#: Pre-tokens of the byte-level vocabularies (a fixed value of the public format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 400_000

#: Result columns and their types.
OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "ids_sha256": T.StringType(),
    "decoded": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    own = set(plain)
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """Byte-level BPE as the ``tokenizers`` library does it, without its code."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        symbols = byte_symbols()
        self.byte_ids = [vocab[s] for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = {s: b for b, s in enumerate(symbols)}
        size = 1 + max(chain(vocab.values(), self.special.values()))
        self.strings = [b""] * size
        for token, i in vocab.items():
            known = all(ch in back for ch in token)
            self.strings[i] = bytes(back[ch] for ch in token) if known else token.encode()
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.numbers = [str(i) for i in range(size)]
        self.words = _Words(self)
        self.find = regex.compile(PATTERN).findall
        own = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, own)) + ")") if own else None

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        ids = [self.byte_ids[b] for b in word.encode()]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        merges = self.merges.get
        left = list(range(-1, n - 1))
        right = [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if m := merges((ids[i], ids[i + 1])):
                queue.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = right[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue  # stale: one of the symbols has been merged since
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if m := merges((new, ids[k])):
                    heapq.heappush(queue, (m[0], i, new, ids[k], m[1]))
            if (h := left[i]) >= 0 and (m := merges((ids[h], new))):
                heapq.heappush(queue, (m[0], h, ids[h], new, m[1]))
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        ids: list[int] = []
        for part in self.cut.split(text):
            ids += [self.special[part]] if part in self.special else self._plain(part)
        return ids

    def _plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.find(text))))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class _Words(dict):
    """Merged words; emptied when full, so that it stays bounded."""

    def __init__(self, bpe: Bpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.bpe.merge(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


#: The tables of this Python worker, by vocabulary: built once, kept between tasks.
_BUILT: dict[str, Bpe] = {}


def _tables(key: str, spec: bytes) -> Bpe:
    if key not in _BUILT:
        _BUILT[key] = Bpe(json.loads(spec))
    return _BUILT[key]


def _values(bpe: Bpe, text: str, outputs: Sequence[str]) -> tuple:
    ids = bpe.encode(text)
    got: dict[str, object] = {"n_tokens": len(ids), "ids": ids}
    if "ids_sha256" in outputs:
        joined = ",".join(map(bpe.numbers.__getitem__, ids))
        got["ids_sha256"] = hashlib.sha256(joined.encode()).hexdigest()
    if "decoded" in outputs or "decoded_sha256" in outputs:
        got["decoded"] = decoded = bpe.decode(ids)
        got["decoded_sha256"] = hashlib.sha256(decoded.encode()).hexdigest()
    return tuple(got[o] for o in outputs)


def batch_slices(batch: pa.RecordBatch, text_col: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``limit`` bytes of text, which bounds what lies in memory."""
    sizes = pa.compute.binary_length(batch.column(text_col)).fill_null(0).to_pylist()
    begin = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= limit or i + 1 == len(sizes):
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0


def bpe_columns(
    df: DataFrame,
    tokenizer_path: str,
    text_col: str = "text",
    outputs: Sequence[str] = ("n_tokens", "ids"),
    keep_text: bool = True,
) -> DataFrame:
    """``df`` with the named ``outputs`` added; a map without any shuffle.

    ``tokenizer_path`` is a byte-level BPE file of the ``tokenizers`` library, opened on
    the driver alone.
    """
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    key = hashlib.sha256(raw).hexdigest()
    spec = df.sparkSession.sparkContext.broadcast(raw)
    names = [
        c for c in df.columns if c not in outputs and (keep_text or c != text_col)
    ]
    schema = T.StructType(
        [f for f in df.schema.fields if f.name in names]
        + [T.StructField(o, OUTPUTS[o]) for o in outputs]
    )
    wanted = tuple(outputs)
    arrow = {
        "n_tokens": pa.int64(),
        "ids": pa.list_(pa.int32()),
        "ids_sha256": pa.string(),
        "decoded": pa.string(),
        "decoded_sha256": pa.string(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tables(key, spec.value)
        for whole in batches:
            for batch in batch_slices(whole, text_col):
                rows = [_values(bpe, t.as_py() or "", wanted) for t in batch.column(text_col)]
                made = list(zip(*rows, strict=True)) or [()] * len(wanted)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in names]
                    + [pa.array(m, arrow[o]) for o, m in zip(wanted, made, strict=True)],
                    names=[*names, *wanted],
                )

    return df.mapInArrow(run, schema)


def public_path() -> str:
    """The byte-level vocabulary that the query's contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_columns(
        docs, public_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep_text=False
    )

"""Operator 9, substring dedup by sliding sentence spans.

A text is cut into sentences (after ``.``, ``!`` or ``?`` with closing marks and white
space, and at line feeds), and these further, so that of any ``WINDOW`` words in a row one
ends a piece: the one whose hash is least, where no stop stands among them. So words alone
say where a text is cut, whatever stands before and behind a passage. Of the runs of ``span``
pieces or more with ``min_words`` words or more, the shortest from every piece on is hashed
to 128 bits over its words; with ``every`` (as the query has it) also the shortest up to every
piece, and both once more without the cuts at line feeds; with ``whole`` (the query has it too) the whole text is
one more run, even under ``min_words``, so copies of a short text go. Together they cover every piece of
any longer run, and any 51 words that two texts share hold a run that both hash: the first
cut comes within 11 words, the run from it ends within 20 + 10 more, and cuts up to the 41st
word depend on nothing outside. (For other ``min_words`` the share is as much longer.)

Hashes are counted over all documents; of a repeated run, the occurrence with the least
(doc_id, text hash, position) stays, and pieces that any other occurrence covers are removed.

Texts are dealt to parts of about ``PART_BYTES`` by their place in the table, once, for finding runs
and for removing them; rows alike lie in any parts and get one result. A part hands over each hash once, with its least document, so a passage of a third of
all documents is one row for each part, not for each document. What comes back to a part is
the list of its repeated hashes.

Defined cases: null text is empty and has no sentences; a null doc_id sorts first; a
document is its doc_id and text together, so rows that share an id (null too) but not the
text are documents of their own, and rows that repeat both are one document and get one
result each; removed sentences go with the white space after them (the first one with what
stands before it), everything else stays as it is; columns that carry the name of a result
column are replaced, others pass through; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_or_least, table
from .text_arrays import Words, mix, split_words

_U = np.uint64
#: Among so many words in a row there is a cut.
WINDOW = 11
#: Bytes of text in one part, and in one call of ``cut_texts``.
PART_BYTES, CALL_BYTES = 4_000_000, 1_000_000
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_CLOSING = np.isin(np.arange(256), [ord(c) for c in "\"')]"])


@dataclass
class Pieces:
    """Sentences (or pieces of long ones) of texts, and their runs."""

    words: Words
    text: np.ndarray  # of each piece: the number of its text
    at: np.ndarray  # its place in that text
    counts: np.ndarray  # pieces of each text
    first: np.ndarray  # of each run: number of its first piece
    last: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    _begins: np.ndarray
    _ends: np.ndarray

    def of(self, number: int) -> list[str]:
        """The pieces of one text, each with the white space after it."""
        mine = range(*np.searchsorted(self.text, [number, number + 1]))
        return [bytes(self.words.data[self._begins[i] : self._ends[i]]).decode("utf-8", "surrogatepass") for i in mine]

    def without(self, number: int, gone: np.ndarray) -> tuple[str, int]:
        """One text without some of its pieces, and the words that went."""
        begin, end = np.searchsorted(self.text, [number, number + 1])
        begins, ends = self._begins[begin:end], self._ends[begin:end]
        kept = b"".join(bytes(self.words.data[x:y]) for x, y in zip(begins[~gone], ends[~gone], strict=True))
        starts = self.words.starts
        words = np.searchsorted(starts, ends[gone]) - np.searchsorted(starts, begins[gone])
        return kept.decode("utf-8", "surrogatepass"), int(words.sum())


def _least_of_windows(rank: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Marks the words of least rank (by its low 32 bits) in any ``WINDOW`` words of one text, the last of equals."""
    n, marks = len(rank), np.zeros(len(rank), dtype=bool)
    if n < WINDOW:
        return marks
    # Rank and place in one word, so that one minimum gives the place too.
    least = rank << _U(32) | np.arange(n - 1, -1, -1, dtype=np.uint64)
    size = 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    left = np.repeat(np.cumsum(counts), counts)[: len(least)] - np.arange(len(least))  # words up to the text's end
    marks[n - 1 - (least[left >= WINDOW] & _U(0xFFFFFFFF)).astype(np.int64)] = True
    return marks


def _shortest(upto: np.ndarray, number: np.ndarray, span: int, min_words: int, every: bool) -> np.ndarray:
    """The shortest runs of the pieces that end before the words ``upto``, as the first word
    times (words + 1) plus the word behind the last; ``number`` has each word's text."""
    n = len(number)
    first_word = np.concatenate([[0], upto[:-1]])
    text, piece = number[first_word], np.arange(len(upto))
    last = np.maximum(np.searchsorted(upto, first_word + min_words), piece + span - 1)
    first = np.flatnonzero(last < np.searchsorted(text, text, "right"))
    runs = first_word[first] * (n + 1) + upto[last[first]]
    if not every:
        return runs
    start = np.minimum(np.searchsorted(first_word, upto - min_words, "right") - 1, piece - span + 1)
    end = np.flatnonzero(start >= np.searchsorted(text, text))
    return np.concatenate([runs, first_word[start[end]] * (n + 1) + upto[end]])


def cut_texts(texts: list[str], span: int = 2, min_words: int = 20, every: bool = False, whole: bool = False) -> Pieces:
    """Cut whole texts and hash their runs; all texts at once. ``every`` and ``whole``: see above."""
    w = split_words(texts)
    n = len(w.starts)
    none = np.empty(0, np.int64)
    if not n:
        return Pieces(w, none, none, np.zeros(len(texts), np.int64), none, none, none, none, none, none)
    index = np.arange(n)
    tail = w.stops - 1
    for _ in range(2):  # closing marks behind the stop
        tail = tail - (_CLOSING[w.data[tail]] & (tail > w.starts))
    feeds = np.cumsum(w.data == 10)
    following = np.append(w.starts[1:], len(w.data))
    stops = _STOP[w.data[tail]]
    ends = stops | (feeds[following - 1] > feeds[w.stops - 1])
    # Line feeds do not count here, so that words alone say where a text is cut.
    words_say = stops | _least_of_windows(np.where(stops, _U(0), w.hashes), w.counts)
    number = np.repeat(np.arange(len(texts)), w.counts)
    upto = np.flatnonzero(ends | words_say) + 1
    first_word = np.concatenate([[0], upto[:-1]])
    text = number[first_word]
    counts = np.bincount(text, minlength=len(texts))
    head = np.cumsum(counts) - counts
    at = np.arange(len(upto)) - head[text]
    byte_ends = np.where(at + 1 == counts[text], w.ends[text] - 1, np.append(w.starts[first_word[1:]], 0))
    byte_begins = np.where(at == 0, np.concatenate([[0], w.ends[:-1]])[text], w.starts[first_word])
    runs = _shortest(upto, number, span, min_words, every)
    words_say[np.cumsum(w.counts)[w.counts > 0] - 1] = True  # the last word of a text
    if every and not words_say[upto - 1].all():
        runs = np.concatenate([runs, _shortest(np.flatnonzero(words_say) + 1, number, span, min_words, True)])
    if whole:  # a text as one run, however few words it has
        head_word = np.cumsum(w.counts) - w.counts
        runs = np.concatenate([runs, (head_word * (n + 1) + head_word + w.counts)[counts >= span]])
    runs = np.unique(runs)
    begin, end = runs // (n + 1), runs % (n + 1)
    first, last = np.searchsorted(first_word, begin), np.searchsorted(upto, end)
    length = end - begin
    keys = [_run_keys(w.hashes, begin, length, odd) for odd in _ODD]
    return Pieces(w, text, at, counts, first, last, *keys, byte_begins, byte_ends)


def _run_keys(words: np.ndarray, begin: np.ndarray, length: np.ndarray, odd: int) -> np.ndarray:
    """Hashes of runs of words: prefix sums of a polynomial, shifted back to the first word."""
    power = np.full(len(words), odd, dtype=np.uint64)
    back = np.full(len(words), pow(odd, -1, 2**64), dtype=np.uint64)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words ^ _U(odd >> 1)) * power, dtype=np.uint64)])
    value = (total[begin + length] - total[begin]) * back[begin]
    return mix(value + length.astype(np.uint64)).view(np.int64)


def sentences(text: str) -> list[str]:
    """The pieces of one text; a text without words has none."""
    return cut_texts([text]).of(0)


@dataclass
class Part:
    """The documents of a part in order, and all their runs in order."""

    place: np.ndarray  # of each row: the number of its document
    docs: np.ndarray  # ids and text hashes of the documents
    hashes: np.ndarray
    cuts: list[tuple[int, Pieces]]  # first document of each call, and its pieces
    doc: np.ndarray  # of each run
    first: np.ndarray
    last: np.ndarray
    h1: np.ndarray
    h2: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, text_col: str, *rule) -> Part:
        ids, hashes = (rows.column(c).to_numpy() for c in ("__doc", "__row"))
        order = np.lexsort((hashes, ids))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(ids[order]) != 0) | (np.diff(hashes[order]) != 0)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        chosen = order[new]
        texts = [t or "" for t in rows.column(text_col).take(pa.array(chosen)).to_pylist()]
        cuts, begin, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CALL_BYTES or i + 1 == len(texts):
                cuts.append((begin, cut_texts(texts[begin : i + 1], *rule)))
                begin, size = i + 1, 0
        parts = [(c.text[c.first] + b, c.at[c.first], c.at[c.last], c.h1, c.h2) for b, c in cuts]
        return cls(place, ids[chosen], hashes[chosen], cuts, *(np.concatenate(x) for x in zip(*parts, strict=True)))


def _emit(text_col: str, *rule):
    """Each hash of a part once: its least document there, and whether the part has it again."""

    def run(rows: pa.Table) -> pa.Table:
        part = Part.of(rows, text_col, *rule)
        order = np.lexsort((part.h2, part.h1))  # stable: the least occurrence of a hash comes first
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(part.h1[order]) != 0) | (np.diff(part.h2[order]) != 0)
        at = np.flatnonzero(new)
        times, head = np.diff(np.append(at, len(order))), order[at]
        doc = part.doc[head]
        number = rows.column("__part")[0].as_py()
        columns = {
            "__part": np.full(len(head), number, dtype=np.int64), "h1": part.h1[head], "h2": part.h2[head],
            "__doc": part.docs[doc], "__row": part.hashes[doc].astype(np.int32), "__again": times > 1,
        }
        return pa.table(columns)

    return run


def _rewrite(text_col: str, names: list[str], *rule):
    """The rows of a part, without the pieces that its repeated runs cover."""

    def run(rows: pa.Table, drops: pa.Table) -> pa.Table:
        part = Part.of(rows, text_col, *rule)
        keys = zip(drops.column("h1").to_pylist(), drops.column("h2").to_pylist(), strict=True)
        stays = dict(zip(keys, drops.column("__stays").to_pylist(), strict=True))
        some = np.flatnonzero(np.isin(part.h1, drops.column("h1").to_numpy()))
        wanted = np.zeros(len(some), dtype=bool)
        for i, key in enumerate(zip(part.h1[some].tolist(), part.h2[some].tolist(), strict=True)):
            if key in stays:
                wanted[i] = not stays[key]
                stays[key] = False  # only the first one of the part stays
        some = some[wanted]
        doc, first, last = part.doc[some], part.first[some], part.last[some]
        new: dict[int, str] = {}
        made = []
        for begin, cut in part.cuts:
            n = len(cut.counts)
            head = np.cumsum(cut.counts) - cut.counts
            own = slice(*np.searchsorted(doc, [begin, begin + n]))
            edge = np.zeros(len(cut.text) + 1, dtype=np.int64)
            at = head[doc[own] - begin]
            np.add.at(edge, at + first[own], 1)
            np.add.at(edge, at + last[own] + 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            removed = np.bincount(cut.text[gone], minlength=n) if len(gone) else np.zeros(n, np.int64)
            words = np.zeros(n, dtype=np.int64)
            for i in np.flatnonzero(removed).tolist():
                new[begin + i], words[i] = cut.without(i, gone[head[i] : head[i] + cut.counts[i]])
            made.append((cut.counts, removed, words))
        columns = dict(zip(("n_sentences", "n_removed", "n_removed_words"), map(np.concatenate, zip(*made, strict=True)), strict=True))
        texts = [t or "" for t in rows.column(text_col).to_pylist()] if text_col in names else []
        out = {c: pa.array(v[part.place], pa.int64()) for c, v in columns.items()}
        out[text_col] = pa.array([new.get(p, t) for p, t in zip(part.place.tolist(), texts, strict=bool(texts))], pa.string())
        return pa.table([out[c] if c in out else rows.column(c) for c in names], names=names)

    return run


def dedup_spans(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    span: int = 2,
    min_words: int = 20,
    every: bool = False,
    whole: bool = False,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """All rows of ``df`` with ``text_col`` rewritten, plus ``n_sentences``, ``n_removed``
    and ``n_removed_words``. Without ``every`` only the shortest run from each
    piece on counts, and the last pieces of a repeated stretch can stay. One pass over the
    sizes of texts comes first, for the number of parts; results do not depend on it."""
    added, rule = ["n_sentences", "n_removed", "n_removed_words"], (span, min_words, every, whole)
    df = df.drop(*added)
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = F.lit(1 + size // part_bytes)
    own = df.withColumns({"__doc": id_or_least(F.col(id_col)), "__row": F.xxhash64(text)})
    # Dealt by place, as any number of rows can be alike; a document is known by id and text, not by its part.
    own = own.withColumn("__part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts).cast("long"))
    runs = own.groupBy("__part").applyInArrow(
        _emit(text_col, *rule), "__part long, h1 long, h2 long, __doc long, __row int, __again boolean"
    )
    same, document = Window.partitionBy("h1", "h2"), F.struct("__doc", "__row")
    drops = (
        runs.withColumns(
            {"__least": F.min(document).over(same), "__most": F.max(document).over(same), "__any": F.max("__again").over(same)}
        )
        .withColumn("__stays", document == F.col("__least"))
        .filter("(__least <> __most or __any) and (__again or not __stays)")
        .select("__part", "h1", "h2", "__stays")
    )
    schema = T.StructType(
        [T.StructField(c, T.StringType()) if c == text_col else df.schema[c] for c in df.columns]
        + [T.StructField(c, T.LongType()) for c in added]
    )
    # The exchange of the texts by part is the same as above, and so is made once.
    return (
        own.groupBy("__part").cogroup(drops.groupBy("__part"))
        .applyInArrow(_rewrite(text_col, [*df.columns, *added], *rule), schema)
    )


def op9_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: what was removed, and the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_spans(docs, every=True, whole=True).withColumn("removed", F.col("n_removed") > 0)

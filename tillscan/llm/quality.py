"""Operator 2, quality rules: a linear-chain CRF labels lines, Viterbi decodes them.

Each line of a text has features in [0, 1] (shares of symbols, capitals, digits and marks,
length, repetition). A linear-chain conditional random field over the labels *content* and
*boilerplate* is trained on the driver, on a bounded sample: of each quality label the
``sample`` rows whose ids hash lowest, among texts of at most ``SAMPLE_BYTES`` bytes and
``SAMPLE_LINES`` lines.
Rows that fail the base rules do not train.
Line labels start as the label of their document; documents of low quality are then
relabelled by Viterbi and the field is trained again. Every row is scored, whole.
A document is kept if the base rules hold and at least ``MIN_CONTENT`` of its words stand in
content lines.

Base counts (words are ``[^\\x20\\x09-\\x0D]+``): code points in words, characters of
``#*$%&|<>``, lines with a word that equal an earlier line, and words in five-word windows
found twice or more in the text. The base fails under 10 words, or when more than 20 % of
the words stand in repeated windows.

Defined cases: null text is empty (no words, base fails); without labelled rows of both
kinds, or with null labels only, every line is content, so the base rules decide alone;
repeated rows get equal results; columns that carry the name of a result column are
replaced, others pass through; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .text_arrays import mix, word_hashes

_U = np.uint64
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_LINES = 750, 50_000, 1000
MIN_CONTENT = 0.5
WINDOW = 5
SYMBOLS = "#*$%&|<>"

_BYTE = np.arange(256)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int32)
    out[[ord(c) for c in chars]] = 1
    return out


_IS = {
    "symbol": _table(SYMBOLS),
    "upper": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower": _table("abcdefghijklmnopqrstuvwxyz"),
    "digit": _table("0123456789"),
    "shout": _table("!"),
    "white": _table(" \t\n\x0b\x0c\r"),
    "tail": ((_BYTE >= 0x80) & (_BYTE < 0xC0)).astype(np.int32),
}
FEATURES = (
    "bias", "symbols", "marked_words", "shouts", "capitals", "digits", "long_words",
    "sentences", "repeated", "empty", "first", "stutters",
)


@dataclass
class Lines:
    """The lines of a batch of texts and the base counts of the texts."""

    features: np.ndarray  # line x feature
    words: np.ndarray  # words of each line
    counts: np.ndarray  # lines of each text
    base: dict[str, np.ndarray]  # by text


def _repeat_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text in windows that the text has twice or more."""
    n, docs = len(hashes), np.repeat(np.arange(len(counts)), counts)
    index = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.flatnonzero(index + WINDOW <= np.repeat(counts, counts))
    if not len(at):
        return np.zeros(len(counts), dtype=np.int64)
    key = mix(docs[at].astype(np.uint64) + _U(1))
    for j in range(WINDOW):
        key = mix(key * _U(0x9E3779B97F4A7C15) + hashes[at + j])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + WINDOW, dtype=np.int32)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    return np.bincount(docs[np.cumsum(edge)[:n] > 0], minlength=len(counts))


def measure(texts: list[str]) -> Lines:
    """Base counts and line features of whole texts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    newline = np.flatnonzero(data == 10)
    starts = np.r_[0, newline[:-1] + 1] if len(newline) else np.empty(0, np.int64)
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.empty(0, np.int64)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    n = {k: np.add.reduceat(t[data], starts) if len(starts) else np.empty(0, np.int32) for k, t in _IS.items()}
    size = newline - starts
    points = size - n["tail"]
    begins = ~_IS["white"].astype(bool)[data]
    begins[1:] &= _IS["white"].astype(bool)[data[:-1]]
    words = np.add.reduceat(begins.astype(np.int32), starts) if len(starts) else np.empty(0, np.int32)
    marked = _IS["symbol"].astype(bool)[data]
    marked[1:] &= ~_IS["symbol"].astype(bool)[data[:-1]]  # runs of symbols, about one a word
    runs = np.add.reduceat(marked.astype(np.int32), starts) if len(starts) else words
    white = n["white"] - 1  # without the line feed
    ink = np.maximum(points - white, 0)
    some, letters = np.maximum(ink, 1), np.maximum(n["upper"] + n["lower"], 1)
    per = np.maximum(words, 1)
    stop = (data == ord(".")) | (data == ord("?"))
    stop[:-1] &= _IS["white"].astype(bool)[data[1:]]
    stops = np.add.reduceat(stop.astype(np.int32), starts) if len(starts) else words
    repeated = np.zeros(len(starts), dtype=bool)
    at = 0
    for t in texts:
        seen: set[str] = set()
        for line in t.split("\n"):
            repeated[at] = line in seen
            seen.add(line)
            at += 1
    first = np.zeros(len(starts))  # the chain's start potential
    first[(np.cumsum(counts) - counts)[counts > 0]] = 1.0
    hashes, n_words = word_hashes(texts)
    line = np.repeat(np.arange(len(starts)), words)
    again = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    features = np.stack(
        [
            np.ones(len(starts)),
            np.minimum(1, 3 * n["symbol"] / some),
            np.minimum(1, runs / per),
            np.minimum(1, n["shout"] / per),
            np.maximum(n["upper"] - words, 0) / letters,  # beyond one a word
            n["digit"] / some,
            np.minimum(1, ink / per / 40),
            np.minimum(1, 8 * stops / per),
            repeated.astype(float),
            (words == 0).astype(float),
            first,
            np.bincount(line[1:][again], minlength=len(starts)) / per,
        ],
        axis=1,
    )
    doc = np.repeat(np.arange(len(texts)), counts)

    def by_text(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=x, minlength=len(texts)).astype(np.int64)

    base = {
        "n_words": n_words.astype(np.int64),
        "word_chars": by_text(ink),
        "n_symbols": by_text(n["symbol"]),
        "n_dup_lines": by_text(repeated & (words > 0)),
        "n_repeat_words": _repeat_words(hashes, n_words).astype(np.int64),
    }
    return Lines(features, words, counts, base)


def measure_all(texts: list[str]) -> Lines:
    """``measure`` in parts of about 2 MB, which bounds the arrays by byte."""
    parts, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= 2_000_000 or i + 1 == len(texts):
            parts.append(measure(texts[begin : i + 1]))
            begin, size = i + 1, 0
    base = {k: np.concatenate([p.base[k] for p in parts]) for k in parts[0].base}
    return Lines(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("features", "words", "counts")), base)


def base_fails(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])


@dataclass
class Crf:
    """Scores of boilerplate against content: a weight by feature, and transitions."""

    weights: np.ndarray
    moves: np.ndarray  # [from, to]

    @classmethod
    def silent(cls) -> Crf:
        """Without training every line is content."""
        weights = np.zeros(len(FEATURES))
        weights[0] = -1.0
        return cls(weights, np.zeros((2, 2)))

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best labels of one text, for its lines' scores of boilerplate; ties: content."""
        (aa, ab), (ba, bb) = self.moves.tolist()
        a = b = 0.0
        back: list[tuple[int, int]] = []
        for i, s in enumerate(scores.tolist()):
            if i == 0:
                a, b = 0.0, s
                continue
            to_a, to_b = (b + ba > a + aa), (b + bb > a + ab)
            a, b = max(a + aa, b + ba), max(a + ab, b + bb) + s
            back.append((to_a, to_b))
        state = int(b > a)
        out = [state] * (len(back) + 1)
        for i in range(len(back) - 1, -1, -1):
            state = int(back[i][state])
            out[i] = state
        return out if len(scores) else []


def _expected(model: Crf, scores: np.ndarray, at: list[np.ndarray], share: np.ndarray):
    """Forward-backward over texts, longest first: expected labels by line, and expected
    transitions weighted by ``share``. ``at[t]`` are the lines number ``t``, of the texts
    that have one; nothing is padded."""
    length = len(at)
    emit = [np.stack([np.zeros(len(i)), scores[i]], axis=1) for i in at]
    fwd = [emit[0]]
    for t in range(1, length):
        before = fwd[t - 1][: len(at[t])]
        fwd.append(np.logaddexp.reduce(before[:, :, None] + model.moves, axis=1) + emit[t])
    bwd = [np.zeros((len(i), 2)) for i in at]
    for t in range(length - 2, -1, -1):
        after = (bwd[t + 1] + emit[t + 1])[:, None, :] + model.moves
        bwd[t][: len(at[t + 1])] = np.logaddexp.reduce(after, axis=2)
    z = np.logaddexp.reduce(fwd[0] + bwd[0], axis=1)
    label = np.zeros(len(scores))
    moves = np.zeros((2, 2))
    for t, i in enumerate(at):
        a = len(i)
        label[i] = np.exp(fwd[t][:, 1] + bwd[t][:, 1] - z[:a])
        if t:
            pair = fwd[t - 1][:a, :, None] + model.moves + (bwd[t] + emit[t])[:, None, :]
            moves += np.einsum("n,nab->ab", share[:a], np.exp(pair - z[:a, None, None]))
    return label, moves


def train(texts: list[str], good: list[bool], rounds: int = 3, steps: int = 80) -> Crf:
    """Fit the field on whole documents labelled good or not."""
    model = Crf.silent()
    if not any(good) or all(good):
        return model
    order = sorted(range(len(texts)), key=lambda i: (-texts[i].count("\n"), texts[i], good[i]))
    texts, good = [texts[i] for i in order], [good[i] for i in order]
    lines = measure_all(texts)
    x, counts, n = lines.features, lines.counts, len(texts)
    start = np.cumsum(counts) - counts
    longer = [int((counts > t).sum()) for t in range(int(counts[0]))]
    at = [start[:a] + t for t, a in enumerate(longer)]
    y = np.repeat(np.where(good, 0.0, 1.0), counts)
    share = np.full(n, 1 / n)
    inner = np.ones(len(x), dtype=bool)
    inner[start] = False  # lines that follow another one
    model = Crf(np.zeros(x.shape[1]), np.zeros((2, 2)))
    for _ in range(rounds):
        m = [np.zeros(x.shape[1]), np.zeros((2, 2))]
        v = [np.zeros(x.shape[1]), np.zeros((2, 2))]
        seen_label = y @ x / n
        one = np.stack([1 - y, y], axis=1)
        seen_moves = one[:-1][inner[1:]].T @ one[1:][inner[1:]] / n
        for step in range(1, steps + 1):
            label, expected = _expected(model, x @ model.weights, at, share)
            grads = [
                seen_label - label @ x / n - 1e-4 * model.weights,
                seen_moves - expected - 1e-4 * model.moves,
            ]
            for p, g, a, b in zip((model.weights, model.moves), grads, m, v, strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                p += 0.3 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        for ok, b, c in zip(good, start.tolist(), counts.tolist(), strict=True):
            if not ok:
                got = model.viterbi(x[b : b + c] @ model.weights)
                y[b : b + c] = got if any(got) else 1.0
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> Crf:
    """Train on at most ``sample`` rows of each quality, chosen by hash.

    Ids are chosen among those that have a text that fits; at most ``2 * sample`` of them
    are broadcast. Rows are bounded again, as an id may stand in many.
    """
    known = labels.select("doc_id", "quality").dropna().distinct()
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    fits = docs.select("doc_id", "text").filter((F.octet_length("text") <= SAMPLE_BYTES) & (feeds < SAMPLE_LINES))
    known = known.join(fits.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.filter(F.col("quality") == q).orderBy(*order).limit(sample) for q in (0, 1)]
    rows = []
    for ids in chosen:
        own = fits.join(F.broadcast(ids), "doc_id").orderBy(*order, "text").limit(sample)
        rows += own.select("text", "quality").collect()
    # What the base rules reject needs no labels, and would teach that plain lines are bad.
    passed = ~base_fails(measure_all([r.text for r in rows]).base) if rows else []
    rows = [r for r, ok in zip(rows, passed, strict=True) if ok]
    return train([r.text for r in rows], [bool(r.quality) for r in rows])


ADDED = {
    "n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(),
    "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(), "base_failed": T.BooleanType(),
    "content_share": T.DoubleType(), "boilerplate_lines": T.ArrayType(T.IntegerType()),
    "kept": T.BooleanType(),
}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(texts: list[str], model: Crf) -> dict[str, list]:
    """The result columns for whole texts."""
    lines = measure(texts)
    out: dict[str, list] = {c: lines.base[c].tolist() for c in _COUNTS}
    scores = lines.features @ model.weights
    share, found = [], []
    at = 0
    for c in lines.counts.tolist():
        label = np.array(model.viterbi(scores[at : at + c]), dtype=bool)
        own = lines.words[at : at + c]
        share.append(float(own[~label].sum() / max(int(own.sum()), 1)))
        found.append(np.flatnonzero(label).tolist())
        at += c
    out["base_failed"] = base_fails(lines.base).tolist()
    out["content_share"], out["boilerplate_lines"] = share, found
    out["kept"] = [not f and s >= MIN_CONTENT for f, s in zip(out["base_failed"], share, strict=True)]
    return out


def label_documents(df: DataFrame, model: Crf, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with the columns of ``ADDED``; a map without any shuffle."""
    names = [c for c in df.columns if c not in ADDED and (keep_text or c != text_col)]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(c, t) for c, t in ADDED.items()])
    types = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            made: dict[str, list] = {c: [] for c in ADDED}
            begin, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= 2_000_000 or i + 1 == len(texts):  # bounds the arrays
                    for c, v in judge(texts[begin : i + 1], model).items():
                        made[c] += v
                    begin, size = i + 1, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(made[c], types.get(t, pa.list_(pa.int32()))) for c, t in ADDED.items()],
                names=[*names, *ADDED],
            )

    return df.mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return label_documents(docs, model, keep_text=False).drop("boilerplate_lines")

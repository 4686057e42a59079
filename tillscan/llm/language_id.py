"""Operator 10, language ID: nearest centroid over TF-IDF vectors of letter trigrams.

Texts are lower-cased, everything but letters becomes a word break, and trigrams around
each letter (with one break before and after a word) are hashed to ``BINS`` bins. Vectors
are square-rooted counts times inverse document frequency, normalised. For each language
several centroids are found by spherical k-means; a text gets the language of the centroid
of the highest cosine, which is its score. A text that is farther from its centroid than
nearly all training texts of it is *rejected*.

The model is fitted on the driver on a bounded sample: at most ``SAMPLE_DOCS`` labelled
rows in all, equally many for each language, those whose ids hash lowest among texts
of at most ``SAMPLE_BYTES`` bytes. So at most ``SAMPLE_DOCS`` languages are learned, the most frequent
ones. Every row is predicted from its whole text.

Defined cases: null text, or text without a letter, is ``und`` with score 0; rows without
a label or an id teach nothing; if nothing can be learned, every text is ``und``; a tie
goes to the language that sorts first; repeated rows get equal results; columns that carry
the name of a result column are replaced, others pass through; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .text_arrays import mix

_U = np.uint64
BINS = 4096
CENTROIDS = 3
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 50_000
MAX_LANGUAGES = SAMPLE_DOCS  # a row for each
#: Characters of a text whose trigrams are counted at once.
PIECE = 1_000_000
_BREAK = re.compile(r"[\W\d_]")
#: Share of a centroid's training texts that may lie beyond its rejection distance, and
#: the margin added to that distance.
REJECT_SHARE, REJECT_MARGIN = 0.01, 0.15
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter; built once for each Python worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``PIECE`` characters, each cut behind a break between words."""
    begin = 0
    while len(text) - begin > PIECE:
        found = _BREAK.search(text, begin + PIECE)
        if not found:
            break
        yield text[begin : found.end()]
        begin = found.end()
    yield text[begin:]


def trigram_counts(texts: list[str]) -> np.ndarray:
    """(text x bin) counts of hashed letter trigrams of whole texts; those of a long text are added up by piece."""
    lowered = [t.lower() for t in texts]
    out = np.zeros((len(texts), BINS), dtype=np.float32)
    short = [i for i, t in enumerate(lowered) if len(t) <= PIECE]
    out[short] = _counts([lowered[i] for i in short])
    for i in set(range(len(texts))) - set(short):
        total = np.zeros(BINS)
        for piece in _pieces(lowered[i]):
            total += _counts([piece])[0]
        out[i] = total
    return out


def _counts(texts: list[str]) -> np.ndarray:
    n = len(texts)
    joined = "\n".join([*texts, ""])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) if n else np.empty(0, np.int64)
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one break after each word
    at = np.flatnonzero(keep)
    if not len(at):
        return np.zeros((n, BINS), dtype=np.float32)
    value = np.where(letter[at], code[at], 0).astype(np.uint64)
    value = np.concatenate([np.zeros(1, np.uint64), value])
    middle = np.flatnonzero(value[:-1][1:]) + 1
    key = value[middle - 1] * _U(0x9E3779B97F4A7C15) + value[middle] * _U(0xC2B2AE3D27D4EB4F)
    key = mix(key + value[middle + 1] * _U(0x165667B19E3779F9)) & _U(BINS - 1)
    doc = np.searchsorted(ends, at[middle - 1], side="right")
    counts = np.bincount(doc * BINS + key.astype(np.int64), minlength=n * BINS)
    return counts.reshape(n, BINS).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # unit vectors
    languages: list[str]  # of each centroid
    nearest: np.ndarray  # least cosine that is not rejected, for each centroid

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and rejection of whole texts, regardless of rejection."""
        counts = trigram_counts(texts)
        some = counts.any(axis=1)
        if not len(self.languages):
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        like = _unit(np.sqrt(counts) * self.idf) @ self.centroids.T
        best = like.argmax(axis=1)
        score = np.clip(like[np.arange(len(texts)), best], 0.0, 1.0) * some
        language = [self.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        return language, score.astype(float).tolist(), ((score < self.nearest[best]) | ~some).tolist()


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts at the mean, then at the text farthest from all so far."""
    centers = _unit(x.mean(axis=0, keepdims=True))
    while len(centers) < min(k, len(x)):
        far = (x @ centers.T).max(axis=1).argmin()
        centers = np.concatenate([centers, x[far : far + 1]])
    for _ in range(rounds):
        own = (x @ centers.T).argmax(axis=1)
        sums = [x[own == c].sum(axis=0) if (own == c).any() else centers[c] for c in range(len(centers))]
        centers = _unit(np.stack(sums))
    return centers


def train(texts: list[str], languages: list[str]) -> Model:
    """Fit idf weights and centroids; the order of the texts does not matter."""
    pairs = sorted(zip(languages, texts, strict=True))
    counts = np.concatenate(
        [trigram_counts([t for _, t in pairs[i : i + 500]]) for i in range(0, len(pairs), 500)]
        or [np.zeros((0, BINS), np.float32)]
    )
    some = counts.any(axis=1)
    counts, names = counts[some], [p[0] for p, s in zip(pairs, some.tolist(), strict=True) if s]
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
    x = _unit(np.sqrt(counts) * idf.astype(np.float32))
    centers, owner, nearest = [], [], []
    for name in sorted(set(names)):
        own = x[[n == name for n in names]]
        found = _cluster(own, CENTROIDS)
        like = own @ found.T
        best = like.argmax(axis=1)
        for c in range(len(found)):
            members = like[best == c, c]
            low = np.quantile(members, REJECT_SHARE) if len(members) else like.max(axis=1).min()
            nearest.append(float(low) - REJECT_MARGIN)
            centers.append(found[c])
            owner.append(name)
    matrix = np.stack(centers) if centers else np.zeros((0, BINS), np.float32)
    return Model(idf.astype(np.float32), matrix.astype(np.float32), owner, np.array(nearest))


def fit(df: DataFrame, taught: Column, sample: int = SAMPLE_DOCS, languages: int = MAX_LANGUAGES) -> Model:
    """Train on rows where ``taught`` holds and ``lang`` is not null.

    The sample is cut in two steps, by salted language and then by language, so that no
    task gets all rows of a frequent one. It is of ``sample`` rows at most (or of one for
    each language), however often an id or a text repeats.
    """
    known = df.filter(taught & F.col("lang").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    names = [r.lang for r in counted.select("lang").collect()]
    if not names:
        return train([], [])
    each = max(1, sample // len(names))
    keys = known.select("doc_id", "lang", F.xxhash64("text").alias("t"), F.xxhash64("doc_id").alias("h"))
    keys = keys.filter(F.col("lang").isin(names))
    order = [F.col("h"), F.col("doc_id"), F.col("t")]
    salted = Window.partitionBy("lang", F.pmod("h", F.lit(16))).orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    chosen = (
        keys.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= each).drop("r")
        .withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= each)
        .groupBy("lang", "doc_id", "t").agg(F.count("*").alias("n"))
    )
    # At most ``sample`` keys: a bound that does not grow with the rows. Rows alike come once.
    rows = known.withColumn("t", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "doc_id", "t"])
    rows = rows.groupBy("lang", "doc_id", "t").agg(F.min("text").alias("text"), F.min("n").alias("n")).collect()
    taken = [(r.lang, r.text) for r in rows for _ in range(r.n)]
    return train([t for _, t in taken], [x for x, _ in taken])


ADDED = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}


def predict(
    df: DataFrame, model: Model, text_col: str = "text", reject: bool = True, keep_text: bool = True
) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``rejected``; a map without any shuffle.

    With ``reject``, rejected texts are ``und``; without it they keep the nearest language.
    """
    names = [c for c in df.columns if c not in ADDED and (keep_text or c != text_col)]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(c, t) for c, t in ADDED.items()])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            made: tuple[list, list, list] = ([], [], [])
            begin, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= 1_000_000 or i + 1 - begin == 500 or i + 1 == len(texts):
                    for total, part in zip(made, own.predict(texts[begin : i + 1]), strict=True):
                        total += part
                    begin, size = i + 1, 0
            languages, scores, far = made
            if reject:
                languages = [UNKNOWN if f else x for x, f in zip(languages, far, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())],
                names=[*names, *ADDED],
            )

    return df.mapInArrow(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = fit(docs.select("doc_id", "lang", "text"), part != 2)
    held = docs.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "text")
    return predict(held, model, reject=False, keep_text=False)

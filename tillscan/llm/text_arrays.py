"""Whole batches of texts as numpy arrays: words and word shingles, hashed to 64 bits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

_U = np.uint64
#: Bits of a shingle's hash; the rest of a word numbers the texts of one call.
HASH_BITS = 46


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_STEP = 0x100000001B3 * 2 + 1
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers, one for each word of a shingle.
_PLACES = mix(np.arange(100, 164, dtype=np.uint64)) | _U(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEP, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of texts, in order; texts are joined by line feeds."""

    data: np.ndarray  # UTF-8 of all texts, a line feed behind each
    ends: np.ndarray  # behind each text and its line feed
    starts: np.ndarray  # of words in ``data``
    stops: np.ndarray
    counts: np.ndarray  # words of each text
    hashes: np.ndarray


def split_words(texts: Sequence[str]) -> Words:
    """Find and hash all words."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    inside = ~_WHITE[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, stops = edge[0::2], edge[1::2]  # the last byte is white
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return Words(data, ends, starts, stops, counts, np.empty(0, np.uint64))
    lengths = stops - starts
    at = np.flatnonzero(inside)
    offsets = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(offsets, lengths)
    terms = _BYTES[data[at]] * _powers(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(terms, offsets) + lengths.astype(np.uint64))
    return Words(data, ends, starts, stops, counts, hashes)


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the count for each text."""
    w = split_words(texts)
    return w.hashes, w.counts


def shingles(
    texts: Sequence[str], width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text number, hash, times), sorted by both.

    Hashes have ``HASH_BITS`` bits: two texts of 500 shingles each share a false one with a
    chance of 4e-9. A text of fewer than ``width`` words has one shingle, made of all its words; a text
    without words has none.
    """
    if len(texts) >= 1 << (64 - HASH_BITS):
        raise ValueError("too many texts for one call")
    words, counts = word_hashes(texts)
    n = len(words)
    doc = np.repeat(np.arange(len(counts)), counts)
    sums = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        if n > j:
            sums[: n - j] += words[j:] * _PLACES[j]
    begin = np.cumsum(counts) - counts
    index = np.arange(n) - np.repeat(begin, counts)
    full = index + width <= np.repeat(counts, counts)
    d, h = doc[full], mix(sums[full])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = [
            (words[b : b + c] * _PLACES[:c]).sum(dtype=np.uint64)
            for b, c in zip(begin[short], counts[short], strict=True)
        ]
        salt = counts[short].astype(np.uint64) * _U(0xD6E8FEB86659FD93)
        d = np.concatenate([d, short])
        h = np.concatenate([h, mix(np.array(own, dtype=np.uint64) + salt)])
    if not len(d):
        return d, h, np.empty(0, np.int64)
    # Text number and hash in one word, so that one plain sort does.
    both = np.sort(d.astype(np.uint64) << _U(HASH_BITS) | h >> _U(64 - HASH_BITS))
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    kept = both[first]
    times = np.diff(np.r_[first, len(both)])
    return (kept >> _U(HASH_BITS)).astype(np.int64), kept & _U((1 << HASH_BITS) - 1), times

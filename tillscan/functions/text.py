"""Scalar functions over text: folding, cleaning, casing, counting. All are JVM-side."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillscan import dictionaries as D

#: What becomes one space: a single space stays as it is, which spares a replacement.
BLANK_RUN = r"\s(?:\s+|(?<! ))"
#: Java's notion of a blank character beyond those that ``trim`` removes.
BLANK = r"^[\s\x1c-\x1f\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000]*$"


@cache
def accent_table() -> tuple[str, str]:
    """Letters whose canonical decomposition is one ASCII letter or digit and marks."""
    source, target = [], []
    for cp in range(0xC0, 0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if unicodedata.category(c)[0] != "M")
        if len(base) == 1 and base != chr(cp) and base.isascii():
            source.append(chr(cp))
            target.append(base)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without accents, composed or decomposed.

    Text of as many bytes as characters is ASCII and takes the short way.
    """
    source, target = accent_table()
    small = F.lower(text)
    bare = F.regexp_replace(F.translate(small, source, target), r"\p{M}+", "")
    return F.when(F.octet_length(text) == F.length(text), small).otherwise(bare)


def trim_controls(text: Column) -> Column:
    """Without characters up to U+0020 at both ends; ``text`` is computed several times.

    Mostly there are none, which two comparisons tell: strings are ordered by their bytes.
    """
    return F.when((text >= "!") & (F.right(text, F.lit(1)) >= "!"), text).otherwise(_trimmed(text))


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit("".join(map(chr, range(33)))))


def is_blank(text: Column) -> Column:
    """Whether all characters are blank; a text that begins with a visible ASCII character is not."""
    return ~text.between("!", "~") & text.rlike(BLANK)


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return _trimmed(F.regexp_replace(text, BLANK_RUN, " "))


def norm(text: Column) -> Column:
    """For detection: folded, only a-z, 0-9, slash and single spaces."""
    folded = fold(text)
    changed = F.trim(F.regexp_replace(folded, "[^a-z0-9/](?:[^a-z0-9/]+|(?<! ))", " "))
    # Mostly that changes nothing, which a look from the start tells sooner than a search at every character.
    return F.when(folded.rlike(r"\A[a-z0-9/]++(?: [a-z0-9/]++)*+\z"), folded).otherwise(changed)


def norm_lines(text: Column) -> Column:
    """The lines of a text, ended by line feeds, as ``norm`` has each of them."""
    out = F.regexp_replace(fold(text), "[^a-z0-9/\n](?:[^a-z0-9/\n]+|(?<! ))", " ")
    loose = out.contains(" \n") | out.contains("\n ")
    return F.trim(F.when(loose, F.regexp_replace(out, " ?\n ?", "\n")).otherwise(out))


def dict_norm(text: Column) -> Column:
    """For dictionaries: as ``norm``, without the slash; null is empty."""
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9](?:[^a-z0-9]+|(?<! ))", " "))


def compact(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def clean_noise(text: Column) -> Column:
    """Marks that OCR takes for letters or adds."""
    marked = is_noisy(text) | text.contains("\n")
    return F.when(marked, squeeze(F.translate(text, '|"`', "I  "))).otherwise(trim_controls(text))


def is_noisy(text: Column) -> Column:
    """Whether ``clean_noise`` changes more than the ends of some line of a text."""
    # Plain searches are far cheaper than a pattern over every character.
    return reduce(Column.__or__, [text.contains(mark) for mark in ("|", '"', "`", "  ", *"\t\x0b\x0c\r")])


def title_case(text: Column) -> Column:
    """First letters of the words large, the rest small, single spaces."""
    shown = F.initcap(F.lower(text))
    return F.trim(F.when(shown.contains("  "), F.regexp_replace(shown, "  +", " ")).otherwise(shown))


def beautify(text: Column) -> Column:
    """A raw description for people."""
    # ``translate`` looks up each character of a text, a search for marks mostly ends without it.
    out = clean_noise(text)
    out = F.when(out.rlike("[*_.]"), F.translate(out, "*_.", "   ")).otherwise(out)
    out = F.regexp_replace(out, D.GLUED_SIZE, "$1 X$2")
    out = F.when(F.octet_length(out) == F.length(out), out).otherwise(F.translate(out, "€§°", "CSo"))
    out = F.regexp_replace(out, D.TRAILING_TAX_RATE, "")
    return title_case(squeeze(out))


def clean_brand(text: Column) -> Column:
    """(N7)"""
    return squeeze(F.coalesce(text, F.lit("")))


def letters(text: Column) -> Column:
    """Number of letters."""
    return F.regexp_count(text, F.lit(r"\p{L}"))


def has_letters(text: Column, n: int) -> Column:
    """Whether there are ``n`` letters or more; reads no further than the last of them."""
    return text.rlike(rf"(?s)^(?:\P{{L}}*+\p{{L}}){{{n}}}")


def one_of(words: Iterable[str]) -> str:
    """A pattern for the words; those that begin alike share a branch, those that another begins are left out."""
    kept: list[str] = []
    for w in sorted(set(words)):
        if not kept or not w.startswith(kept[-1]):
            kept.append(w)

    def branch(rest: list[str]) -> str:
        if len(rest) == 1:
            return re.escape(rest[0])
        by_first: dict[str, list[str]] = {}
        for w in rest:
            by_first.setdefault(w[0], []).append(w[1:])
        found = [re.escape(c) + branch(ends) for c, ends in by_first.items()]
        return found[0] if len(found) == 1 else f"(?:{'|'.join(found)})"

    return branch(kept) if kept else "(?!)"


def any_of(text: Column, words: Iterable[str]) -> Column:
    """Whether one of the words is contained, as one pass of a pattern."""
    return text.rlike(one_of(words))


def specs(text: Column) -> Column:
    """Sizes and counts named in a description, in order."""
    return F.lower(F.array_join(F.regexp_extract_all(text, F.lit(D.SPECS), F.lit(0)), " "))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


# --- The same normal forms for driver-side dictionaries of bounded size ---------------------


def py_fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c)[0] != "M")


def py_dict_norm(text: str | None) -> str:
    return re.sub("[^a-z0-9]+", " ", py_fold(text or "")).strip()


def py_norm(text: str) -> str:
    return re.sub("[^a-z0-9/]+", " ", py_fold(text)).strip()

"""Brands: matching, falling back, removing from descriptions, learning.

Two ways of matching give the same rows. Small dictionaries are literals, tried longest
first (J1, J2 as expressions, no join). Large ones are joined: a description meets the alias
table by its beginnings, or by its substrings where an alias may stand anywhere. An alias
without letters or digits is in every description, and the last choice of both ways.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscan import dictionaries as D
from tillscan.functions.text import any_of, clean_brand, compact, dict_norm, fold, let, letters, norm, one_of, title_case
from tillscan.operators.containment import answered, contained, starting
from tillscan.sources.dictionaries import Alias


def known_brand(description: Column, aliases: Sequence[Alias], anywhere: bool = False) -> Column:
    """(brand, alias) of the longest alias that starts the description, or is in it; or null.

    ``aliases`` come longest first, so the first that matches is the one.
    """
    if not aliases:
        return F.lit(None).cast("struct<brand:string,alias:string>")
    table = F.array(
        *[
            F.struct(F.lit(a.compact).alias("c"), F.lit(a.brand).alias("brand"), F.lit(a.norm).alias("alias"))
            for a in aliases
        ]
    )

    def pick(c: Column) -> Column:
        hits = F.filter(table, lambda a: c.contains(a["c"]) if anywhere else c.startswith(a["c"]))
        # Named once: each mention in the body of ``let`` would search again.
        return F.get(F.transform(F.slice(hits, 1, 1), lambda a: F.struct(a["brand"].alias("brand"), a["alias"].alias("alias"))), 0)

    c = compact(dict_norm(description))
    some = one_of(a.compact for a in aliases)
    return F.when(c.rlike(some if anywhere else f"^{some}"), let(c, pick))


def fallback_brand(description: Column) -> Column:
    """(brand, alias) from the first word, or the first two after a short one."""
    first, two = _words(description, 1), _words(description, 2)
    words = F.when(F.length(first) <= 3, two).otherwise(first)
    return F.struct(title_case(words).alias("brand"), norm(words).alias("alias"))


def _words(text: Column, n: int) -> Column:
    """The first ``n`` words; fewer if there are no more."""
    return F.substring_index(text, " ", n)


def word_forms(description: Column) -> Column:
    """Normal forms of the words, with the spaces between them."""
    folded = fold(description)
    return F.when(folded.rlike(r"\A[a-z0-9/ ]*+\z"), folded).otherwise(F.regexp_replace(folded, "[^a-z0-9/ ]", ""))


def remove_brand(description: Column, brand: Column, alias: Column, forms: Column | None = None) -> Column:
    """The description without the brand it starts with.

    Words go up to the first that completes the alias; where none does (the alias ends
    inside a word) all go, and the description is restored. An alias glued to the front of
    the next word is cut off. If nothing is left, the description stays. ``forms`` is ``word_forms``
    of the description, if there is a column that has it.
    """
    forms = word_forms(description) if forms is None else forms
    c = compact(alias)
    known = F.struct(F.split(description, " ").alias("words"), F.split(forms, " ").alias("forms"), c.alias("c"))

    def strip(x: Column) -> Column:
        words, forms, c = x["words"], x["forms"], x["c"]
        whole = F.filter(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(forms, 1, k), "") == c)
        gone = F.when(F.array_join(forms, "").startswith(c), F.coalesce(F.get(whole, 0), F.size(words))).otherwise(0)
        return let(gone, lambda k: _unglued(F.slice(words, k + 1, F.size(words)), F.get(forms, k), c))

    # Mostly the alias is the first word or the first two or three, and nothing is glued to the next.
    cases = F.lit(None).cast("string")
    for n in (3, 2, 1):
        after = F.substr(forms, F.length(_words(forms, n)) + 2)
        glued = _words(after, 1).startswith(c) & (F.length(_words(after, 1)) > F.length(c))
        rest = F.trim(F.substr(description, F.length(_words(description, n)) + 2))
        cases = F.when((compact(_words(forms, n)) == c) & ~glued, rest).otherwise(cases)
    cases = F.when(~compact(forms).startswith(c), F.trim(description)).otherwise(cases)
    left = F.coalesce(cases, F.trim(F.array_join(let(known, strip), " ")))
    untouched = (F.trim(alias) == "") | (brand == D.NO_BRAND)
    return F.when(untouched, description).otherwise(F.coalesce(F.nullif(left, F.lit("")), description))


def _unglued(words: Column, form: Column, alias: Column) -> Column:
    """``words`` without an alias that the first one (of normal form ``form``) begins with."""
    first = F.get(words, 0)
    glued = form.startswith(alias) & (F.length(form) > F.length(alias))
    suffix = F.substr(first, F.length(alias) + 1)
    rest = F.slice(words, 2, F.size(words))
    return (
        F.when(F.coalesce(~glued, F.lit(True)), words)
        .when(F.trim(suffix) == "", rest)
        .otherwise(F.concat(F.array(suffix), rest))
    )


def match_brands(
    df: DataFrame, aliases: DataFrame, text_col: str, key_cols: Sequence[str], anywhere: bool = False
) -> DataFrame:
    """(keys, brand, alias) by join: J1, or J2 with ``anywhere``; rows without a match are left out.

    ``aliases`` is (pos, alias_pos, brand, norm, compact) of any size. Distinct texts meet
    distinct spellings: by their beginnings, or by substrings that begin as some spelling.
    """
    keyed = df.select(*key_cols, compact(dict_norm(F.col(text_col))).alias("text"))
    patterns = aliases.select(F.col("compact").alias("pattern")).distinct()
    pairs = (contained if anywhere else starting)(keyed.select("text").distinct(), patterns)
    best = F.struct(
        F.length("compact").alias("n"), (-F.col("pos")).alias("p"), (-F.col("alias_pos")).alias("q"), "brand", "norm"
    )
    # All tables grow with the data, so none is broadcast.
    named = aliases.withColumn("pattern", F.col("compact")).hint("merge")
    hits = pairs.join(named, "pattern").groupBy("text").agg(F.max(best).alias("b"))
    return keyed.join(hits.hint("merge"), "text").select(*key_cols, F.col("b.brand").alias("brand"), F.col("b.norm").alias("alias"))


def with_known_brands(df: DataFrame, aliases: DataFrame, text_col: str, anywhere: Column) -> DataFrame:
    """``df`` with ``known`` (brand, alias, or null) from a dictionary of any size.

    Distinct descriptions are matched, once from their start and once anywhere, as
    ``anywhere`` says of their rows; so a frequent description costs one match.
    """
    keyed = df.withColumns({"__t": F.coalesce(F.col(text_col), F.lit("")), "__any": anywhere})
    texts = keyed.select("__t", "__any").distinct()
    found = [
        match_brands(texts.filter(F.col("__any") == flag), aliases, "__t", ["__t"], anywhere=flag).withColumn("__any", F.lit(flag))
        for flag in (False, True)
    ]
    both = found[0].unionByName(found[1]).select("__t", "__any", F.struct("brand", "alias").alias("known"))
    return keyed.join(both.hint("merge"), ["__t", "__any"], "left").drop("__t", "__any")


def with_brands_of_texts(df: DataFrame, aliases: DataFrame, text_col: str, anywhere: Column) -> DataFrame:
    """As ``with_known_brands``, where texts may have any share of the rows (``answered``); ``df`` is read several times."""
    marked = F.concat(F.when(anywhere, "*").otherwise("^"), F.coalesce(F.col(text_col), F.lit("")))

    def known(texts: DataFrame) -> DataFrame:
        cut = texts.select(F.col("text").alias("__key"), F.substr("text", F.lit(2)).alias("__t"))
        found = [
            match_brands(cut.filter(F.col("__key").startswith(mark)), aliases, "__t", ["__key"], anywhere=flag)
            for mark, flag in (("^", False), ("*", True))
        ]
        return found[0].unionByName(found[1]).select(F.col("__key").alias("text"), F.struct("brand", "alias").alias("known"))

    return answered(df.withColumn("__text", marked), "__text", known, "known").drop("__text")


def can_learn(brand: Column) -> Column:
    """Whether a fallback brand is fit for the catalog."""
    cleaned, n = clean_brand(brand), dict_norm(brand)
    return (
        (cleaned != "")
        & ~n.isin(*D.IGNORED_BRANDS)
        & ~any_of(n, [D.IGNORED_BRAND_PART])
        & ~cleaned.rlike("[0-9]")
        & (letters(cleaned) >= 3)
    )


def learned_brands(candidates: DataFrame, known: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """(norm, brand): brands the catalog lacks, in their first spelling.

    Matching goes by a frozen catalog; what it lacks is returned here for an explicit
    merge, so results do not depend on the order in which receipts are read. A frequent
    brand is one aggregate row for each task.
    """
    rows = candidates.filter(can_learn(F.col("brand"))).select(
        dict_norm(F.col("brand")).alias("norm"), clean_brand(F.col("brand")).alias("brand"), *order_cols
    )
    first = rows.groupBy("norm").agg(F.min_by("brand", F.struct(*order_cols, "brand")).alias("brand"))
    have = known.select(dict_norm(F.col("brand")).alias("norm")).distinct()
    return first.join(have, "norm", "left_anti")


def merged_catalog(known: DataFrame, learned: DataFrame) -> DataFrame:
    """(pos, brand): the catalog with learned brands, sorted regardless of case (K7)."""
    names = known.select("brand").unionByName(learned.select("brand"))
    order = Window.orderBy(F.lower("brand"), "brand")
    return names.select((F.row_number().over(order) - 1).alias("pos"), "brand")

"""What a receipt says once: layout, date and store.

All are functions of the receipt's own array of lines, so nothing is
shuffled: "the first line that ..." is the first element of a filtered array. Bodies of lambdas are
interpreted for each line, so what can be told of the whole text at once, or of the line that mostly has the
answer, is asked first, by compiled columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscan import dictionaries as D
from tillscan.functions.dates import find_date, is_date_label, normalize_date, parse_date
from tillscan.functions.lines import has_metadata, is_app_line
from tillscan.functions.text import any_of, clean_noise, is_noisy, let, norm, norm_lines, title_case
from tillscan.sinks.shared import written
from tillscan.sources.dictionaries import StoreAlias, joined, store_aliases, store_table

from .containment import answered, contained
from .lines import is_tidy, split_lines


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), 0)


def layout(line_norms: Column, text: Column | None = None) -> Column:
    """``app`` if any line names the delivery app, else ``standard`` (P7, A2, B7); ``text`` as in ``date_text``."""
    return F.when(is_app_line(F.array_join(line_norms, "\n") if text is None else text), "app").otherwise("standard")


def date_text(lines: Column, line_norms: Column, as_of_year: int, text: Column | None = None) -> Column:
    """The date on the first labelled line that has one, or on the line after it.

    ``text`` has all ``line_norms``, each on a line, if there is such a column.
    """
    text = F.array_join(line_norms, "\n") if text is None else text
    before = F.substring_index(text, D.DATE_LABEL, 1)  # no line of it is labelled
    at = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    mostly = F.when(
        is_date_label(F.get(line_norms, at)),
        F.coalesce(find_date(F.get(lines, at), as_of_year), find_date(F.get(lines, at + 1), as_of_year)),
    )
    found = F.transform(
        lines,
        lambda line, i: F.when(
            is_date_label(F.get(line_norms, i)),
            F.coalesce(find_date(line, as_of_year), find_date(F.get(lines, i + 1), as_of_year)),
        ),
    )
    return F.when(text.contains(D.DATE_LABEL), F.coalesce(mostly, _first(found)))


def detected_store(cleans: Column, clean_norms: Column) -> Column:
    """The line after the store label, or the first that can be a name."""

    def candidate(line: Column, i: Column) -> Column:
        n, after = F.get(clean_norms, i), F.get(clean_norms, i + 1)
        labelled = n.contains(D.STORE_LABEL) & after.isNotNull() & ~has_metadata(after)
        named = (F.length(line) > 6) & ~line.rlike("[0-9]") & ~has_metadata(n)
        return F.when(labelled, F.get(cleans, i + 1)).when(named, line)

    # Mostly the first line names the store.
    found = F.coalesce(candidate(F.get(cleans, 0), F.lit(0)), _first(F.transform(F.slice(cleans, 1, D.STORE_LINES), candidate)))
    return F.coalesce(title_case(found), F.lit(D.DEFAULT_STORE))


def mapped_store(text: Column, stores: Sequence[StoreAlias]) -> Column:
    """The store of the first alias contained in the text, or null.

    ``text`` is a normal form. Containment without spaces covers containment with them.
    """
    if not stores:
        return F.lit(None).cast("string")

    def pick(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for s in reversed(stores):
            out = F.when(c.contains(s.compact), F.lit(s.store)).otherwise(out)
        return F.when((c != "") & any_of(c, [s.compact for s in stores]), out)

    return let(F.translate(text, " /", ""), pick)


def _candidates() -> Column:
    """What can name the store, in order: each line, then the detected name; as ``mapped_store`` sees them."""
    return F.transform(F.concat("__norms", F.array(norm(F.col("__store")))), lambda n: F.translate(n, " /", ""))


def with_mapped_store(df: DataFrame, stores: DataFrame) -> DataFrame:
    """``df`` with ``__mapped``: the store of the first line that holds an alias, of its aliases the
    first; else that of the detected name; else null (J3, J4), for (pos, compact, store) of any size.

    Different lines meet different aliases. The rows are parsed once, into a table with an id for each.
    """
    keyed = written(df.withColumns({"__id": F.monotonically_increasing_id(), "__candidates": _candidates()}), "headed")
    lines = keyed.select("__id", F.posexplode("__candidates").alias("at", "text")).filter("text <> ''")

    def named(texts: DataFrame) -> DataFrame:
        pairs = contained(texts, stores.select(F.col("compact").alias("pattern")).distinct())
        first = F.min(F.struct("pos", "store")).alias("s")
        return pairs.join(stores.withColumn("pattern", F.col("compact")), "pattern").groupBy("text").agg(first)

    met = answered(lines, "text", named, "s").filter("s IS NOT NULL")
    found = met.groupBy("__id").agg(F.min(F.struct("at", "s")).alias("f")).select("__id", F.col("f.s.store").alias("__mapped"))
    return keyed.join(found, "__id", "left").drop("__id", "__candidates")


def headed(receipts: DataFrame, as_of_year: int, stores: Sequence[StoreAlias] | DataFrame | None = None) -> DataFrame:
    """Every row of ``receipts`` with its lines and header; one narrow stage, but for a table of ``stores``.

    Adds ``lines``, ``cleans``, ``clean_norms``, ``layout``, ``date_raw``, ``store_name``,
    ``date_text`` and ``date``. ``as_of_year`` is the year of dates without one.
    """
    stores = store_aliases() if stores is None else stores
    out = receipts.withColumn("__tidy", is_tidy(F.col("raw_text")))
    out = out.withColumn("lines", split_lines(F.col("raw_text"), F.col("__tidy")))
    out = out.withColumn("__text", F.when(F.col("__tidy"), F.col("raw_text")).otherwise(F.array_join("lines", "\n")))
    out = out.withColumns({"__normed": norm_lines(F.col("__text")), "__noisy": is_noisy(F.col("__text"))})
    none = F.array().cast("array<string>")
    out = out.withColumns(
        {
            "__norms": F.when(F.size("lines") > 0, F.split("__normed", "\n", -1)).otherwise(none),
            "cleans": F.when(F.col("__noisy"), F.transform("lines", lambda x: clean_noise(x))).otherwise(F.col("lines")),
        }
    )
    # Cleaning changes the normal form of a line only where it turns a bar into a letter.
    norms = F.transform(
        "cleans", lambda x, i: F.when(F.get(F.col("lines"), i).contains("|"), norm(x)).otherwise(F.get(F.col("__norms"), i))
    )
    out = out.withColumn("clean_norms", F.when(F.col("__text").contains("|"), norms).otherwise(F.col("__norms")))
    normed = F.col("__normed")
    out = out.withColumns(
        {
            "layout": layout(F.col("__norms"), normed),
            "date_raw": date_text(F.col("lines"), F.col("__norms"), as_of_year, normed),
            "__store": detected_store(F.col("cleans"), F.col("clean_norms")),
        }
    )
    if joined(stores):
        out = with_mapped_store(out, store_table(out.sparkSession, stores))
        store = F.coalesce("__mapped", "__store")
    else:
        # All lines in one pass; most receipts name no store of the dictionary.
        some = any_of(F.translate(normed, " /", ""), [s.compact for s in stores])
        mapped = _first(F.transform("__norms", lambda x: mapped_store(x, stores)))
        out = out.withColumn("__mapped", F.when(some, mapped))
        store = F.coalesce("__mapped", mapped_store(norm(F.col("__store")), stores), F.col("__store"))
    raw = F.coalesce("date_raw", F.lit(""))
    return out.withColumns(
        {
            "store_name": store,
            "date_text": normalize_date(raw, as_of_year),
            "date": parse_date(F.col("date_raw"), as_of_year),
        }
    ).drop("__norms", "__mapped", "__store", "__tidy", "__text", "__normed", "__noisy")


def receipt_header(receipts: DataFrame, as_of_year: int, stores: Sequence[StoreAlias] | DataFrame | None = None) -> DataFrame:
    """(receipt_id, store_name, date_raw, date_text, date, layout)."""
    return headed(receipts, as_of_year, stores).select(
        "receipt_id", "store_name", "date_raw", "date_text", "date", "layout"
    )

"""Items of receipts, in both layouts, as one narrow plan.

Each line carries what it may look ahead to (the next cleaned line, the next four raw
ones), taken from the receipt's own array before lines are exploded. So there is no window,
no join and no shuffle between a receipt's text and its items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscan import dictionaries as D
from tillscan.functions import amounts as A
from tillscan.functions import lines as L
from tillscan.functions.text import BLANK_RUN, beautify, has_letters, let, norm
from tillscan.sinks.shared import written
from tillscan.sources.dictionaries import (
    Alias, Rule, StoreAlias, brand_aliases, joined, product_rules, rule_table,
)

from .brands import fallback_brand, known_brand, remove_brand, with_brands_of_texts, word_forms
from .header import headed
from .learning import with_learned_brands
from .products import rule_met, shown_product, with_products

AHEAD = 4
PRICE_AHEAD = 3


def _item(description: Column, price: Column, quantity: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        description.alias("description"), price.alias("price"), (none if quantity is None else quantity).alias("quantity")
    )


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK_RUN, " "))


def money_description(line: Column) -> Column:
    """A line without amounts, counts before or after, weights and unit labels."""
    out = A.without_amounts(line)
    out = F.regexp_replace(out, D.COUNT_BEFORE, "")
    out = F.regexp_replace(out, D.COUNT_AFTER, "")
    out = F.regexp_replace(out, D.LONG_DECIMALS, " ")
    return _squeezed(F.regexp_replace(out, D.UNIT_PRICE_LABEL, " "))


def _step(df: DataFrame, keep: Sequence[str], **values: Column) -> DataFrame:
    """``keep`` and ``values``, as code of many small methods.

    Whole-stage code puts all steps into one method, which is too large for the virtual machine to
    compile. A projection with a lambda, here that of ``line_no``, stays out of it and is split; no
    number is negative, so the lambda, which would be interpreted for each row, never runs.
    """
    number = F.col("line_no")
    out = [F.when(number < 0, let(number, lambda x: x)).otherwise(number).alias(c) if c == "line_no" else F.col(c) for c in keep]
    return df.select(*out, *[v.alias(k) for k, v in values.items()])


def with_standard_item(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``df`` with ``__item``: the item on a line of the standard layout, or null: the first case that holds.

    ``df`` has ``layout``, ``line``, ``norm`` (of the line, so a line that is not skipped has no
    word that disqualifies it) and ``following``. Each step is a column of its own, computed only where
    the cases before it leave the line open; columns are compiled, bodies of lambdas are not.
    """
    line, n, following = F.col("line"), F.col("norm"), F.col("following")
    priced_alone = A.is_price_only(line)
    open_ = (F.col("layout") != "app") & ~L.is_skipped(n) & ~priced_alone
    keep = [*keep, "line", "norm", "following"]
    out = _step(df, keep, __fit=F.when(open_, ~L.is_adjusted(n)))
    fit = F.col("__fit")
    two_lines = fit & A.is_price_only(following) & (F.length(line) >= 5) & has_letters(line, 4)
    out = _step(out, [*keep, "__fit"], __two=F.coalesce(two_lines, F.lit(False)))
    single = fit.isNotNull() & ~F.col("__two")
    # The special line has this word, whatever its case.
    special = F.when(single & n.contains("punta"), F.nullif(F.regexp_extract(line, D.SPECIAL_LINE, 1), F.lit("")))
    money = F.when(fit & ~F.col("__two") & line.rlike(D.AMOUNT) & has_letters(line, 3), money_description(line))
    out = _step(out, [*keep, "__fit", "__two"], __special=special, __money=money)
    money = F.col("__money")
    named = F.coalesce((F.length(money) >= 3) & L.is_name(money), F.lit(False))
    out = _step(out, [*keep, "__fit", "__two", "__special", "__money"], __named=named)
    left = fit & ~F.col("__two") & F.col("__special").isNull() & ~F.col("__named")
    # A cheap look at the end before the search for the price.
    at_end = left & line.rlike(r"[.,]\d{2}$") & line.rlike(D.PRICE_AT_END)
    rest = F.when(at_end, F.trim(F.regexp_extract(line, D.PRICE_AT_END, 1)))
    out = _step(out, [*keep, "__two", "__special", "__money", "__named"], __rest=rest)
    rest = F.col("__rest")
    item = (
        F.when(F.col("__two"), _item(line, following))
        .when(F.col("__special").isNotNull(), _item(F.col("__special"), F.regexp_extract(line, D.SPECIAL_LINE, 2)))
        .when(F.col("__named"), _item(money, F.try_element_at(A.amounts(line), F.lit(-1))))
        .when((F.length(rest) >= 3) & L.is_name(rest), _item(rest, F.trim(F.regexp_extract(line, D.PRICE_AT_END, 2))))
    )
    return _step(out, keep, __item=item)


def inline_description(line: Column) -> Column:
    """The name in an app line that holds a whole item."""
    out = _squeezed(F.regexp_replace(A.without_amounts(line), D.LEADING_NUMBER, ""))
    units = F.regexp_replace(out, D.UNITS, " ")
    weights = F.regexp_replace(out, D.GRAMS_AND_KILOGRAMS, " ")
    weights = F.regexp_replace(weights, D.ONLY_KILOGRAMS, " ")
    return _squeezed(F.when(line.rlike(D.TRAILING_UNITS), units).otherwise(weights))


def with_app_item(df: DataFrame, keep: Sequence[str], ahead: Sequence[str]) -> DataFrame:
    """``df`` with ``__app``: the item that starts on a line of the app layout, or null."""
    line, n = F.col("line"), F.col("norm")
    app = F.col("layout") == "app"
    keep = [*keep, "line", "norm", *ahead]
    out = _step(df, keep, __price=F.when(app & L.is_app_inline(line, n), A.first_amount(line)))
    out = _step(out, [*keep, "__price"], __name=F.when(F.col("__price").isNotNull(), inline_description(line)))
    name = F.col("__name")
    whole = F.coalesce(F.length(name) >= 4, F.lit(False))
    later = F.coalesce(*[A.first_amount(F.col(c)) for c in ahead[:PRICE_AHEAD]])
    out = _step(out, [*keep, "__price", "__name"], __later=F.when(app & ~whole & L.is_app_product(line, n), later))
    named = F.nullif(F.regexp_extract(line, D.NAMED_UNITS, 1), F.lit(""))
    shown = F.when(line.rlike(D.NAMED_UNITS), F.trim(F.regexp_replace(line, D.NAMED_UNITS, ""))).otherwise(line)
    counted = F.coalesce(named, *[A.app_quantity(F.col(c)) for c in ahead], F.lit("1"))
    item = F.when(whole, _item(name, F.col("__price"), F.coalesce(A.app_quantity(line), F.lit("1")))).when(
        F.col("__later").isNotNull(), _item(shown, F.col("__later"), counted)
    )
    return _step(out, keep, __app=item)


#: Columns that go with every line.
CARRIED = ("receipt_id", "layout", "store_name", "date_text", "date", "line_no")


def candidate_lines(
    receipts: DataFrame, as_of_year: int, stores: Sequence[StoreAlias] | DataFrame | None = None, with_text: bool = False
) -> DataFrame:
    """One row for each line (one without a line for an empty receipt) with what it needs.

    ``with_text`` adds the receipt's ``raw_text`` to the first of its rows. ``a1`` to ``a4``, the raw lines
    ahead, are null but in the app's layout.
    """
    ahead = [f"a{k}" for k in range(1, AHEAD + 1)]
    packed = F.transform(
        "cleans",
        lambda c, i: F.struct(
            c.alias("line"),
            F.get(F.col("clean_norms"), i).alias("norm"),
            F.get(F.col("cleans"), i + 1).alias("following"),
            # Only the app's layout looks further ahead; the other would carry these texts through every step.
            *[F.when(F.col("layout") == "app", F.get(F.col("lines"), i + k)).alias(f"a{k}") for k in range(1, AHEAD + 1)],
        ),
    )
    head, text = [c for c in CARRIED if c != "line_no"], ["raw_text"] if with_text else []
    rows = headed(receipts, as_of_year, stores).select(*head, *text, F.posexplode_outer(packed).alias("line_no", "l"))
    first = F.when(F.coalesce("line_no", F.lit(0)) == 0, F.col("raw_text"))
    return rows.select(
        *CARRIED, *[first.alias(c) for c in text], *[F.col(f"l.{c}").alias(c) for c in ("line", "norm", "following", *ahead)]
    )


def raw_items(
    receipts: DataFrame,
    as_of_year: int,
    stores: Sequence[StoreAlias] | DataFrame | None = None,
    all_lines: bool = False,
    with_text: bool = False,
) -> DataFrame:
    """Lines with an item: its ``raw_description``, ``raw_price`` and ``raw_quantity``.

    With ``all_lines``, lines without an item come too, with nulls; ``with_text`` as in ``candidate_lines``.
    """
    lines = candidate_lines(receipts, as_of_year, stores, with_text)
    ahead = [f"a{k}" for k in range(1, AHEAD + 1)]
    carried = [*CARRIED, "raw_text"] if with_text else list(CARRIED)
    lines = with_standard_item(lines, [*carried, *ahead])
    lines = with_app_item(lines, [*carried, "__item"], ahead)
    lines = lines.select(*carried, F.coalesce("__item", "__app").alias("__found"))
    found = F.filter(F.array("__found"), lambda i: i.isNotNull())
    inline = F.inline_outer(found) if all_lines else F.inline(found)
    out = lines.select(*carried, inline)
    return out.withColumnsRenamed(
        {"description": "raw_description", "price": "raw_price", "quantity": "raw_quantity"}
    )


def built_items(
    raw: DataFrame,
    aliases: Sequence[Alias] | DataFrame | None = None,
    rules: Sequence[Rule] | DataFrame | None = None,
    learn: bool = False,
) -> DataFrame:
    """The finished items of ``raw`` (B1, B2); nulls where a line has none.

    ``aliases`` and ``rules`` are literals, or tables of any size, which are joined. With ``learn``, lines
    know the brands that lines before them (by receipt_id and line_no) have taught; that, and tables, run
    jobs at once.
    """
    aliases = brand_aliases() if aliases is None else aliases
    app = F.col("layout") == "app"
    keep = raw.columns
    out = _step(
        raw, keep,
        shown=beautify(F.col("raw_description")),
        total_price=A.parse_amount(F.col("raw_price")),
        quantity=F.when(app, A.parse_quantity(F.col("raw_quantity"))).otherwise(
            A.quantity(F.col("raw_description")).cast("double")
        ),
    )
    keep += ["shown", "total_price", "quantity"]
    shown = F.col("shown")
    if joined(aliases):
        if not isinstance(aliases, DataFrame):
            aliases = out.sparkSession.createDataFrame(aliases, "pos int, alias_pos int, brand string, norm string, compact string")
        # Lines are read once, for the texts and for the rows that take their answers.
        out = with_brands_of_texts(written(out, "shown"), aliases, "shown", app).select(*keep, "known")
    else:
        known = F.when(app, known_brand(shown, aliases, anywhere=True)).otherwise(known_brand(shown, aliases))
        out = _step(out, keep, known=known)
    if learn:
        out = with_learned_brands(written(out, "items"), "shown", app, ["receipt_id", "line_no"])
    generic = F.struct(F.lit(D.GENERIC_BRAND).alias("brand"), F.lit("").alias("alias"))
    brand = F.coalesce("known", F.when(app, generic).otherwise(fallback_brand(shown)))
    fresh = ~app & F.col("known").isNull()
    out = _step(out, keep, brand=brand, brand_is_new=fresh, __forms=word_forms(shown))
    left = remove_brand(shown, F.col("brand.brand"), F.col("brand.alias"), F.col("__forms"))
    total, quantity = F.col("total_price"), F.col("quantity")
    unit = F.when(~app & (quantity <= 0), total).otherwise(A.unit_price(total, quantity))
    out = _step(out, [*keep, "brand", "brand_is_new"], left=left, unit_price=unit)
    rules = product_rules() if rules is None else rules
    if joined(rules):
        out = with_products(written(out, "built"), "left", F.col("brand.brand"), rule_table(out.sparkSession, rules), "descripcion")
    else:
        kept = out.columns
        out = _step(out, kept, __n=norm(F.col("left")))
        out = _step(out, [*kept, "__n"], __rule=rule_met(F.col("__n"), rules))
        out = _step(out, kept, descripcion=shown_product(F.col("left"), F.col("brand.brand"), F.col("__rule"), F.col("__n")))
    return out.withColumns(
        {
            "marca": F.col("brand.brand"),
            "lugar_de_compra": F.col("store_name"),
            "categoria": F.lit(D.CATEGORY),
            "cantidad": F.coalesce("raw_quantity", quantity.cast("int").cast("string")),
            "precio_unitario": F.coalesce(A.format_amount(F.col("unit_price")), F.lit("")),
            "fecha": F.col("date_text"),
            "precio_total": F.lit(""),
            "total_amount": total.cast("decimal(18,2)"),
        }
    ).drop("shown", "brand", "left")


ITEM_COLUMNS = (
    "receipt_id", "line_no", "layout", "raw_description", "raw_price", "descripcion", "marca",
    "lugar_de_compra", "categoria", "cantidad", "precio_unitario", "fecha", "precio_total",
    "quantity", "total_price", "total_amount", "unit_price", "date", "brand_is_new",
)


def receipt_items(
    receipts: DataFrame,
    as_of_year: int,
    stores: Sequence[StoreAlias] | DataFrame | None = None,
    aliases: Sequence[Alias] | DataFrame | None = None,
    rules: Sequence[Rule] | DataFrame | None = None,
    learn: bool = False,
) -> DataFrame:
    """All items of all receipts, one row each (``ITEM_COLUMNS``); ``learn`` as in ``built_items``."""
    return built_items(raw_items(receipts, as_of_year, stores), aliases, rules, learn).select(*ITEM_COLUMNS)

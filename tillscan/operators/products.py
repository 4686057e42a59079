"""Product names by rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscan import dictionaries as D
from tillscan.functions.text import any_of, let, norm, specs
from tillscan.sources.dictionaries import Rule, product_rules

from .containment import answered, contained


def shown_product(description: Column, brand: Column, rule: Column, n: Column) -> Column:
    """The name by ``rule`` and the sizes in the description; one product goes by its brand."""
    special_brand, part, special = D.SPECIAL_PRODUCT
    is_special = F.coalesce(n.contains(part) & (norm(brand) == special_brand), F.lit(False))
    name = F.when(is_special, F.lit(special)).otherwise(rule)
    full = F.concat_ws(" ", name, F.nullif(specs(description), F.lit("")))
    return F.when(rule.isNull() & ~is_special, description).otherwise(full)


def expand_product(description: Column, brand: Column, rules: Sequence[Rule] | None = None) -> Column:
    """The name of the first rule with a word in the description, and its sizes."""

    def named(n: Column) -> Column:
        return let(rule_met(n, rules), lambda found: shown_product(description, brand, found, n))

    return let(norm(description), named)


def rule_met(n: Column, rules: Sequence[Rule] | None = None) -> Column:
    """The product of the first rule with a word in ``n``, a normal form, or null."""
    rules = product_rules() if rules is None else rules
    rule = F.lit(None).cast("string")
    for r in reversed(rules):
        rule = F.when(any_of(n, r.words), F.lit(r.product)).otherwise(rule)
    return F.when(any_of(n, [w for r in rules for w in r.words]), rule)


def with_products(df: DataFrame, text_col: str, brand: Column, rules: DataFrame, into: str) -> DataFrame:
    """``df`` with ``into`` as ``expand_product`` has it, for rules (pos, product, word) of any size.

    Different descriptions meet different words; of the rules met the first counts.
    """

    def met(texts: DataFrame) -> DataFrame:
        pairs = contained(texts, rules.select(F.col("word").alias("pattern")).distinct())
        first = F.min(F.struct("pos", "product"))["product"].alias("__rule")
        return pairs.join(rules.withColumn("pattern", F.col("word")), "pattern").groupBy("text").agg(first)

    named = answered(df.withColumn("__n", norm(F.col(text_col))), "__n", met, "__rule")
    return named.withColumn(into, shown_product(F.col(text_col), brand, F.col("__rule"), F.col("__n"))).drop("__n", "__rule")

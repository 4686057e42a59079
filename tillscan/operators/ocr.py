"""From OCR boxes to lines of text, and the best of several renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscan import dictionaries as D
from tillscan.functions.lines import is_ocr_item, squeeze_ends
from tillscan.functions.text import let

KEYS = ("receipt_id", "page", "variant_pos")


def boxes(results: DataFrame, result_col: str = "result") -> DataFrame:
    """(keys, text, score, top, left, height) from raw OCR results in JSON.

    A result is a list of pages of entries [polygon, [text, score]] or [polygon, text];
    entries without both parts or without text are left out, a score that is no number
    is 0, and a height is 1 at least.
    """
    entries = F.flatten(F.filter(F.from_json(result_col, "array<array<array<string>>>"), lambda p: p.isNotNull()))
    entry = results.select(*KEYS, F.posexplode(entries).alias("box_no", "e")).filter(F.size("e") >= 2)
    pair = F.from_json(F.get("e", 1), "array<string>")
    has_pair = F.get("e", 1).startswith("[") & (F.size(pair) >= 2)
    points = F.from_json(F.get("e", 0), "array<array<double>>")
    xs, ys = F.transform(points, lambda p: F.get(p, 0)), F.transform(points, lambda p: F.get(p, 1))
    text = squeeze_ends(F.when(has_pair, F.get(pair, 0)).otherwise(F.get("e", 1)))
    found = entry.select(
        *KEYS, "box_no", text.alias("text"),
        F.coalesce(F.when(has_pair, F.get(pair, 1).try_cast("double")), F.lit(0.0)).alias("score"),
        F.array_min(ys).alias("top"), F.array_min(xs).alias("left"),
        F.greatest(F.array_max(ys) - F.array_min(ys), F.lit(1.0)).alias("height"),
    )
    return found.filter("text <> ''")


#: A printed line while boxes join it: sum of their centres, their number, the greatest height, the boxes.
_MEMBER = "struct<left:double,seq:int,text:string,score:double,top:double>"
_ROWS = f"array<struct<centers:double,n:int,height:double,members:array<{_MEMBER}>>>"


def _joined(rows: Column, box: Column) -> Column:
    """``rows`` with a box in the first row whose centre is near enough, or in a new one."""
    center = box["top"] + box["height"] / 2
    member = F.array(F.struct(*[box[c].alias(c) for c in ("left", "seq", "text", "score", "top")]))

    def takes(r: Column) -> Column:
        reach = F.greatest(F.lit(18.0), F.least(r["height"], box["height"]) * 0.8)
        return F.coalesce(F.abs(center - r["centers"] / r["n"]) <= reach, F.lit(False))

    def grown(r: Column) -> Column:
        return F.struct(
            (r["centers"] + center).alias("centers"), (r["n"] + 1).alias("n"),
            F.greatest(r["height"], box["height"]).alias("height"), F.concat(r["members"], member).alias("members"),
        )

    new = F.struct(center.alias("centers"), F.lit(1).alias("n"), box["height"].alias("height"), member.alias("members"))
    return let(
        F.array_position(F.transform(rows, takes), True),
        lambda at: F.when(at == 0, F.concat(rows, F.array(new))).otherwise(
            F.transform(rows, lambda r, i: F.when(i + 1 == at, grown(r)).otherwise(r))
        ),
    )


def _line(row: Column, i: Column) -> Column:
    text = F.trim(F.array_join(F.sort_array(row["members"])["text"], " "))  # by left, then in the order of joining
    top, left, score = (F.array_min(row["members"][c]).alias(c) for c in ("top", "left", "score"))
    return F.struct(top, left, i.alias("i"), text.alias("text"), score)


def box_rows(df: DataFrame) -> DataFrame:
    """(keys, line_no, text, score, top, left): boxes merged into lines (F1, A5).

    The one true fold: boxes come from top to bottom, and the centre of a row moves as they
    join. It runs over the page's array (bounded by what fits on a page) as one
    aggregate expression with the rows as its state.
    """
    box = F.struct("top", "left", "box_no", "height", "score", "text")
    pages = df.groupBy(*KEYS).agg(F.sort_array(F.collect_list(box)).alias("found"))
    numbered = F.transform("found", lambda b, i: F.struct(b["top"], b["left"], b["height"], b["score"], b["text"], i.alias("seq")))
    rows = F.aggregate(numbered, F.array().cast(_ROWS), _joined)
    lines = F.sort_array(F.transform(rows, _line))
    merged = pages.select(*KEYS, F.posexplode(lines).alias("line_no", "l"))
    return merged.select(*KEYS, "line_no", "l.text", "l.score", "l.top", "l.left")


def score_texts(lines: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, score): how much a text looks like a receipt (A6), -1 without lines.

    ``lines`` has one row for each line; a null text marks a rendering without lines.
    """
    return _scored(lines, keys)


def _scored(lines: DataFrame, keys: tuple[str, ...], **more: Column) -> DataFrame:
    """(keys, score) as in ``score_texts``, and ``more`` aggregates of the same groups."""
    low = F.lower("text")
    tokens = [(t, 8) for t in D.OCR_HEADER_TOKENS] + [(t, 10) for t in D.OCR_PRODUCT_TOKENS]
    digit = F.col("text").rlike(r"\p{Nd}")
    flags = [F.max(low.contains(t).cast("int")).alias(f"t{i}") for i, (t, _) in enumerate(tokens)]
    sums = lines.groupBy(*keys).agg(
        *[v.alias(k) for k, v in more.items()],
        F.count("text").alias("n"),
        F.sum(F.length("text")).alias("chars"),
        F.max(digit.cast("int")).alias("digit"),
        F.sum((digit & F.col("text").contains(",")).cast("int")).alias("prices"),
        F.sum(is_ocr_item(F.col("text")).cast("int")).alias("items"),
        *flags,
    )
    total = F.col("n") * 4 + F.col("chars") / 30 + F.col("digit") * 6 + F.col("prices") * 8 + F.col("items") * 14
    for i, (_, points) in enumerate(tokens):
        total = total + F.col(f"t{i}") * points
    return sums.select(*keys, F.when(F.col("n") == 0, F.lit(-1.0)).otherwise(total.cast("double")).alias("score"), *more)


def best_variant(scores: DataFrame, keys: tuple[str, ...] = ("receipt_id", "page")) -> DataFrame:
    """(keys, variant_pos, score): the first of the highest score (A7); -1 is never chosen."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "variant_pos")
    ranked = scores.filter("score >= 0").withColumn("__r", F.row_number().over(order))
    return ranked.filter("__r = 1").select(*keys, "variant_pos", "score")


def page_texts(lines: DataFrame, keys: tuple[str, ...] = ("receipt_id", "page")) -> DataFrame:
    """(keys, text): lines in order, one below the other (A3)."""
    return lines.groupBy(*keys).agg(_one_text().alias("text"))


def _one_text() -> Column:
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    return F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")


def best_texts(result_boxes: DataFrame) -> DataFrame:
    """(receipt_id, page, text) of the best rendering of each page: F1, A6, A7, A3.

    A rendering's score and text are one aggregate, so boxes are read and merged into lines once.
    """
    scored = _scored(box_rows(result_boxes), KEYS, __joined=_one_text()).filter("score >= 0")
    best = F.min_by("__joined", F.struct(-F.col("score"), F.col("variant_pos")))
    return scored.groupBy("receipt_id", "page").agg(best.alias("text"))

"""Operator 6, MinHash near-dedup with DartMinHash signatures.

1. Rows are grouped by exact text (a 128-bit hash), so copies cost one row each.
2. Each text is a weighted set of word shingles. For every shingle, the region below its
   weight is cut into dyadic cells; the darts of a cell arrive along the rank axis as a
   Poisson process whose rate is the width of the cell, seeded by shingle and cell, and a
   dart counts if it lands below the weight. Darts up to a rank that shrinks with the
   total weight are thrown, each is hashed to one of ``bands * rows`` coordinates, and the
   earliest of each coordinate is the signature. Two signatures agree in a coordinate with
   the chance of the weighted Jaccard similarity. Where a coordinate stays empty, the rank
   is doubled. The work grows with the shingles plus the darts, not with their product.
3. Texts that agree in all rows of a band are joined to the least text of the bucket, and
   connected components over these stars give candidate clusters, which hold every pair
   that shares a bucket. No pairs within a bucket are made.
4. Pairs of different texts within a candidate cluster are compared exactly, by postings:
   the sum of the lesser weights over the sum of the greater ones.
   A cluster beyond one block is thinned first without losing a link (``_large_links``),
   and the rest is compared with all in pairs of bounded blocks. Each block returns a
   spanning forest of its links only.
5. Connected components over the links are the classes: within the task that compared a small
   cluster, by joins for larger ones. A cluster of candidates holds whole classes.

With 32 bands of 6 rows a pair at similarity 0.8 shares no bucket with a chance of 6e-5
(0.85: 4e-7); step 4 then compares it anyway if a third text ties both.

Defined cases: null and empty texts are one group of exact copies (empty equals null); a
text of fewer than five words has one shingle, all its words; texts without words are
alike only if equal; a null ``doc_id`` sorts first and returns as null; repeated rows are
copies of each other; rows that share an id (null too) but not a text are told apart by
their text, and a class by the id and the text's hash of its least row; columns that carry the name of a result column are replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hash128, id_or_least, table
from .components import components
from .text_arrays import mix, shingles

_U = np.uint64
_LEAST = -(2**63)
_ALL = 2**64 - 1
#: Texts and bytes of text in one block of the exact comparison.
BLOCK_TEXTS, BLOCK_BYTES = 1500, 12_000_000
#: Bytes of text that are cut into shingles at a time, which bounds a worker's arrays.
CALL_BYTES = 1_000_000


def dart_signatures(
    doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int
) -> np.ndarray:
    """Signatures (n_docs x k, as 64-bit patterns of ranks) of weighted sets.

    ``doc`` numbers the sets, ``element`` holds 64-bit hashes, ``weight`` positive reals.
    The row of an empty set is all ones.
    """
    sig = np.full(n_docs * k, np.inf)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    todo = total > 0
    darts = k * (np.log(k) + 3.0)
    while todo.any():
        limit = np.where(todo, darts / np.maximum(total, 1e-300), 0.0)
        live = todo[doc]
        d, e, w = doc[live], element[live], weight[live]
        cell = 0
        while len(d):
            low, width = 2.0**cell - 1.0, 2.0**cell
            _throw(sig, d, mix(e + _U((cell + 1) * 0xA0761D6478BD642F & _ALL)), w, low, width, limit, k)
            more = w > low + width
            d, e, w = d[more], e[more], w[more]
            cell += 1
        empty = np.isinf(sig.reshape(n_docs, k)).any(axis=1) & todo
        todo, darts = empty, darts * 2
    return sig.view(np.uint64).reshape(n_docs, k)


def _throw(
    sig: np.ndarray, d: np.ndarray, seed: np.ndarray, w: np.ndarray,
    low: float, width: float, limit: np.ndarray, k: int,
) -> None:
    """Throw the darts of one weight cell of all elements, in order of their rank."""
    until = limit[d]
    rank = np.zeros(len(d))
    whole = bool((w >= low + width).all())
    turn = 0
    while len(d):
        turn += 1
        z = mix(seed + _U(turn * 0x9E3779B97F4A7C15 & _ALL))
        rank = rank - np.log1p(-((z >> _U(11)).astype(np.float64) * 2.0**-53)) / width
        near = rank < until
        if not near.all():
            d, seed, w, until, rank, z = (x[near] for x in (d, seed, w, until, rank, z))
            if not len(d):
                return
        place = mix(z ^ _U(0xE7037ED1A0B428DB))
        if whole:
            hit, r = d, rank
        else:
            height = mix(z ^ _U(0x8EBC6AF09C88C6E3))
            below = low + width * ((height >> _U(11)).astype(np.float64) * 2.0**-53) < w
            hit, place, r = d[below], place[below], rank[below]
        np.minimum.at(sig, hit * k + (place % _U(k)).astype(np.int64), r)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band."""
    parts = sig.reshape(len(sig), bands, rows)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(rows):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return keys.view(np.int64)


def _bands(text_col: str, width: int, bands: int, rows: int, weight: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_col).dictionary_encode()
            texts, codes = column.dictionary, column.indices.to_numpy(False)
            keys = np.empty((len(texts), bands), dtype=np.int64)
            some = np.zeros(len(texts), dtype=bool)
            size = pa.compute.binary_length(batch.column(text_col)).cast(pa.int64())
            parts = np.cumsum(pa.compute.binary_length(texts).to_numpy(False).astype(np.int64)) // CALL_BYTES
            for part in np.unique(parts):  # bounds strings and arrays
                at = np.flatnonzero(parts == part)
                doc, element, times = shingles(texts.take(pa.array(at)).to_pylist(), width)
                sig = dart_signatures(doc, element, _weights(times, weight), len(at), bands * rows)
                keys[at] = band_keys(sig, bands, rows)
                some[at[np.unique(doc)]] = True
            flat = pa.array(keys[codes].reshape(-1))
            has = some[codes]
            ends = np.arange(len(codes) + 1, dtype=np.int32) * bands
            lists = pa.ListArray.from_arrays(pa.array(ends), flat)
            lists = pa.compute.if_else(pa.array(has), lists, pa.scalar(None, lists.type))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("h1"), batch.column("h2"), size, lists],
                names=["doc", "h1", "h2", "size", "bands"],
            )

    return run


#: Set numbers, elements, number of sets and weights (all 1 where left out).
Sets = tuple[np.ndarray, np.ndarray, int] | tuple[np.ndarray, np.ndarray, int, np.ndarray]


def _with_weights(sets: Sets) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    return sets if len(sets) == 4 else (*sets, np.ones(len(sets[0])))


def similar_pairs(left: Sets, right: Sets, threshold: float, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``left``, the sets of ``right`` with that weighted Jaccard similarity."""
    d, e, n, w = _with_weights(right)
    order = np.argsort(e, kind="stable")
    e, d, w = e[order], d[order], w[order]
    sizes = np.bincount(d, weights=w, minlength=n)
    ld, le, ln, lw = _with_weights(left)
    lsizes = np.bincount(ld, weights=lw, minlength=ln)
    begin, end = np.searchsorted(e, le, "left"), np.searchsorted(e, le, "right")
    met = np.flatnonzero(end > begin + same)  # elements that another set has too
    edges = np.searchsorted(ld[met], np.arange(ln + 1))
    for i in range(ln):
        own = met[edges[i] : edges[i + 1]]
        if not len(own):
            continue
        size = end[own] - begin[own]
        at = np.repeat(begin[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        common = np.bincount(d[at], weights=np.minimum(w[at], np.repeat(lw[own], size)), minlength=n)
        hit = np.flatnonzero(common)
        if same:
            hit = hit[hit > i]
        union = lsizes[i] + sizes[hit] - common[hit]
        hit = hit[common[hit] >= threshold * union - 1e-9]
        if len(hit):
            yield i, hit


def _forest(pairs: Iterator[tuple[int, np.ndarray]], left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
    """The links among those pairs that tie nodes not tied before."""
    root = {x: x for x in (*left.tolist(), *right.tolist())}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for at, hits in pairs:
        a = int(left[at])
        for b in right[hits].tolist():
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append((a, b))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _weights(times: np.ndarray, weight: str) -> np.ndarray:
    return times.astype(np.float64) if weight == "count" else np.ones(len(times))


def _sets(texts: list[str], width: int, weight: str) -> Sets:
    """Weighted shingles of the texts, cut in parts of bounded size."""
    parts, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CALL_BYTES or i + 1 == len(texts):
            doc, element, times = shingles(texts[begin : i + 1], width)
            parts.append(((doc + begin).astype(np.int32), element, _weights(times, weight)))
            begin, size = i + 1, 0
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.uint64), 0, np.empty(0)
    doc, element, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    return doc, element, len(texts), w


def _roots_within(width: int, threshold: float, weight: str):
    """The least node that each tied text of a small cluster is tied to; links never leave a cluster."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["node", "text"]).sort_values("node", kind="stable")
        own, nodes = _sets(rows["text"].tolist(), width, weight), rows["node"].to_numpy()
        return _rooted(_forest(similar_pairs(own, own, threshold, True), nodes, nodes))

    return run


def _rooted(links: pd.DataFrame) -> pd.DataFrame:
    """(node, root) of the nodes of some links that one task holds."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(links["a"].tolist(), links["b"].tolist(), strict=True):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return pd.DataFrame([(x, find(x)) for x in list(root)], columns=["node", "root"]).astype("int64")


def _links_between(width: int, threshold: float, weight: str):
    """Links from the texts of one block that are left over to those of another block."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["left", "node", "text"]).sort_values("node", kind="stable")
        left, right = rows[rows["left"]], rows[~rows["left"]]
        own, others = (_sets(x["text"].tolist(), width, weight) for x in (left, right))
        pairs = similar_pairs(own, others, threshold, False)
        return _forest(pairs, left["node"].to_numpy(), right["node"].to_numpy())

    return run


def _explode_shingles(width: int, weight: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "node", "h")]
            for b in range(0, len(texts), 500):
                doc, element, n, w = _sets(texts[b : b + 500], width, weight)
                size = np.bincount(doc, weights=w, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[b + doc]) for x in ids), pa.array(element.astype(np.int64)), pa.array(w), pa.array(size[doc])],
                    names=["cluster", "node", "h", "shingle", "weight", "size"],
                )

    return run


def _near_pivot(width: int, threshold: float, weight: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Sets] = {}
        for batch in batches:
            near = []
            for text, pivot in zip(batch.column("text").to_pylist(), batch.column("pivot_text").to_pylist(), strict=True):
                if pivot not in known:
                    known.clear()  # pivots come in runs
                    known[pivot] = _sets([pivot], width, weight)
                _, own, _, w = _sets([text], width, weight)
                _, other, _, v = known[pivot]
                _, i, j = np.intersect1d(own, other, assume_unique=True, return_indices=True)
                common = np.minimum(w[i], v[j]).sum()
                near.append(bool(common >= threshold * (w.sum() + v.sum() - common) - 1e-9))
            names = ["cluster", "node", "h", "text", "pivot"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(near, pa.bool_())], names=[*names, "near"]
            )

    return run


def _large_links(big: DataFrame, width: int, threshold: float, weight: str) -> DataFrame:
    """Links of clusters beyond one block, from (cluster, node, text); none is lost.

    A text with less than ``threshold`` of its weight in shingles of any other text of its
    cluster ties to none of them, and is left out: what two texts share is at most the
    weight of such shingles, and what they have together at least the text's whole weight.
    That is most of a large group of noisy copies. Of the others, those near the cluster's most typical text (its pivot)
    are tied by it. Only the rest is compared with all, in blocks.
    """
    big = cut(big.withColumn("h", F.xxhash64("text")))
    kinds = "cluster long, node long, h long, shingle long, weight double, size double"
    alone = (
        big.mapInArrow(_explode_shingles(width, weight), kinds)
        .groupBy("cluster", "shingle")
        .agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("h").alias("h"), F.min("weight").alias("weight"), F.min("size").alias("size"))
        .filter("n = 1")
        .groupBy("cluster", "node", "h")
        .agg(F.sum("weight").alias("alone"), F.min("size").alias("size"))
    )
    able = (
        big.join(alone.hint("merge"), ["cluster", "node", "h"], "left")
        .withColumn("alone", F.coalesce("alone", F.lit(0.0)))
        .filter(F.col("size").isNull() | (F.col("size") - F.col("alone") >= threshold * F.col("size") - 1e-9))
    )
    able = cut(able.select("cluster", "node", "h", "text", "alone"))
    head = able.groupBy("cluster").agg(F.min_by(F.struct("node", "h"), F.struct("alone", "node", "h")).alias("p"))
    pivots = able.join(
        head.select("cluster", F.col("p.node").alias("node"), F.col("p.h").alias("h")), ["cluster", "node", "h"]
    ).select("cluster", F.col("node").alias("pivot"), F.col("text").alias("pivot_text"))
    starred = cut(
        able.join(pivots.dropDuplicates(["cluster"]), "cluster")
        .select("cluster", "node", "h", "text", "pivot", "pivot_text")
        .mapInArrow(_near_pivot(width, threshold, weight), "cluster long, node long, h long, text string, pivot long, near boolean")
    )
    blocks = [
        F.greatest(F.ceil(n / BLOCK_TEXTS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
        for n, size in (
            (F.count_if(~F.col("near")), F.coalesce(F.sum(F.when(~F.col("near"), F.octet_length("text"))), F.lit(0))),
            (F.count("*"), F.sum(F.octet_length("text"))),
        )
    ]
    sized = starred.groupBy("cluster").agg(blocks[0].alias("ni"), blocks[1].alias("nj"))
    placed = starred.join(sized, "cluster")
    columns = ["cluster", "i", "j", "left", "node", "text"]
    i, j = F.pmod("h", F.col("ni")).cast("int"), F.pmod("h", F.col("nj")).cast("int")
    rest = placed.filter("NOT near").select(
        "*", F.lit(True).alias("left"), i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j")
    )
    every = placed.select(
        "*", F.lit(False).alias("left"), j.alias("j"), F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i")
    )
    both = rest.select(*columns).unionByName(every.select(*columns))
    # Else the join's partitioning by cluster would do, and one task get all its blocks.
    both = both.repartition("cluster", "i", "j")
    far = both.groupBy("cluster", "i", "j").applyInPandas(_links_between(width, threshold, weight), "a long, b long")
    return starred.filter("near AND node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).unionByName(far)


def near_classes(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    bands: int = 32,
    rows: int = 6,
    weight: str = "set",
) -> DataFrame:
    """(doc, h1, h2, class, class_h1, class_h2): one row for each distinct text and id.

    ``doc`` is the id (null as the least long), ``h1, h2`` the hash of the text, and the
    others name the least (doc, h1, h2) of all texts tied to it: ``class`` alone names
    several classes where unrelated texts share an id. Tables that grow with the texts are never broadcast, so
    that the driver holds none of them. ``weight`` is ``set`` (similarity of
    shingle sets) or ``count`` (a shingle weighs as often as the text has it, in the darts
    and in the exact check).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2 = hash128(text)
    base = df.select(
        id_or_least(F.col(id_col)).alias("doc"), h1.alias("h1"), h2.alias("h2"), text.alias("text")
    )
    sketched = base.mapInArrow(
        _bands("text", width, bands, rows, weight), "doc long, h1 long, h2 long, size long, bands array<long>"
    )
    texts = cut(
        sketched.groupBy("h1", "h2")
        .agg(F.min("doc").alias("doc"), F.first("size").alias("size"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())  # a node is a text, whatever its id
    )
    keyed = texts.select("node", F.explode("bands").alias("key"))
    heads = (
        keyed.groupBy("key")
        .agg(F.min("node").alias("head"), F.max("node").alias("tail"))
        .filter("head <> tail")
        .select("key", "head")
    )
    stars = keyed.join(heads.hint("merge"), "key").filter("node <> head").select("node", "head").distinct()
    clusters = components(stars, "node", "head")
    placed = clusters.select("node", F.col("root").alias("cluster")).join(
        texts.select("node", "doc", "h1", "h2", "size").hint("merge"), "node"
    )
    # Which clusters are large is known from sizes alone, before any text is moved.
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_BYTES))
    large = cut(placed.groupBy("cluster").agg(blocks.alias("blocks")).filter("blocks > 1").select("cluster"))
    # Rows that repeat id and text become one before the exchange, by a hash aggregate (the text is among its
    # keys) that needs no sort of texts.
    keys = ["doc", "h1", "h2"]
    member = base.dropDuplicates().join(placed.hint("merge"), keys).select("cluster", "node", "text")
    some_large = large.limit(1).count() > 0
    if some_large:
        member = cut(member)  # candidates only, read more than once
    small = member.join(large, "cluster", "left_anti") if some_large else member
    roots = small.groupBy("cluster").applyInPandas(_roots_within(width, threshold, weight), "node long, root long")
    if some_large:
        # Only their links are spread over tasks; those of small clusters are tied where they are found.
        far = components(_large_links(member.join(large, "cluster", "left_semi"), width, threshold, weight))
        roots = roots.unionByName(far)
    roots = cut(roots)
    own = F.struct("doc", "h1", "h2")
    tied = texts.select("node", own.alias("own")).join(roots.hint("merge"), "node")
    heads = tied.groupBy("root").agg(F.min("own").alias("head"))
    near = texts.join(tied.select("node", "root").join(heads.hint("merge"), "root").hint("merge"), "node", "left")
    near = near.select("h1", "h2", F.coalesce("head", own).alias("head")).select(
        "h1", "h2", F.col("head.doc").alias("class"), F.col("head.h1").alias("class_h1"), F.col("head.h2").alias("class_h2")
    )
    return base.select("doc", "h1", "h2").distinct().join(near.hint("merge"), ["h1", "h2"])


#: Whether a row of ``near_classes`` is the least of its class.
_LEADS = "doc = class AND h1 = class_h1 AND h2 = class_h2"


def _shown(col: str):
    return F.when(F.col(col) != _LEAST, F.col(col))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` without near duplicates: the least document of each class stays.

    Of rows that share its id and text the one whose other columns are least (in their order, nulls
    first) stays, so the order of reading decides nothing. Columns have to be comparable.
    """
    kept = near_classes(df, id_col, text_col, **options).filter(_LEADS)
    kept = kept.select(F.col("doc").alias("__doc"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2"))
    h1, h2 = hash128(F.coalesce(F.col(text_col), F.lit("")))
    others = F.struct(F.col(text_col).isNull().alias("__null"), *[F.col(c) for c in df.columns if c != text_col])
    own = df.withColumns({"__doc": id_or_least(F.col(id_col)), "__h1": h1, "__h2": h2, "__others": others})
    keys = ["__doc", "__h1", "__h2"]
    least = own.groupBy(*keys).agg(F.min("__others").alias("__least")).join(kept.hint("merge"), keys)
    # Rows alike in all columns become one before the exchange, so that a hot one is a row for each task.
    rows = own.dropDuplicates().join(least.hint("merge"), keys).filter(F.col("__others").eqNullSafe(F.col("__least")))
    return rows.select(*df.columns)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class (the least doc_id of it), and whether it stays.

    Where unrelated texts share that id, their classes show the same ``class_id``, and each
    has its own row that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = near_classes(docs, weight="count")
    return classes.select(
        _shown("doc").alias("doc_id"),
        _shown("class").alias("class_id"),
        F.expr(_LEADS).alias("is_kept"),
    )

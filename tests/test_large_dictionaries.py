"""Dictionaries of any size, 3-gram containment, and brands learned in reading order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tillscan.operators import containment as C
from tillscan.operators.items import receipt_items
from tillscan.operators.learning import learned_in_order
from tillscan.operators.ocr import box_rows
from tillscan.plans.parse import parse
from tillscan.sources.dictionaries import product_rules, store_aliases


def frames(spark, texts, patterns):
    return (
        spark.createDataFrame([(t,) for t in texts], "text string"),
        spark.createDataFrame([(p,) for p in patterns], "pattern string"),
    )


def words(seed, n, longest, letters="ab"):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randrange(longest + 1))) for _ in range(n)})


@pytest.mark.parametrize("empty", [True, False])
def test_contained_equals_brute_force(spark, empty):
    texts = [*words(1, 80, 14), *words(2, 40, 9, "abcdé"), "aaaaaaaaaa"]
    texts = sorted(set(texts)) + [None]
    patterns = sorted({*words(3, 60, 5), *words(4, 40, 8, "abcdé"), "aaa", "zzz"} - (set() if empty else {""})) + [None]
    got = sorted(map(tuple, C.contained(*frames(spark, texts, patterns)).collect()))
    assert got == sorted((t, p) for t in texts for p in patterns if t is not None and p is not None and p in t)


def test_starting_equals_brute_force(spark):
    texts, patterns = words(1, 80, 14), words(3, 60, 6)
    got = sorted(map(tuple, C.starting(*frames(spark, texts, patterns)).collect()))
    assert got == sorted((t, p) for t in texts for p in patterns if t.startswith(p))
    assert C.starting(*frames(spark, texts, [])).count() == 0


def test_rows_grow_with_the_text_alone(spark):
    """Patterns of twenty lengths make no more rows of a text than patterns of one."""
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefghij") for _ in range(30)) for _ in range(50)]
    frame = frames(spark, texts, [])[0]
    assert C.text_grams(frame).count() <= 50 * 28
    patterns = frames(spark, [], [t[i % 7 : i % 7 + 4 + i % 20] for i, t in enumerate(texts)])[1]
    filed = C.filed(patterns, C.text_grams(frame))
    assert filed.count() == filed.select("pattern").distinct().count() == patterns.distinct().count()  # one row each
    met = C.text_grams(frame).join(filed, "gram").count()
    assert met <= 3 * C.contained(frame, patterns.distinct()).count()


def brute_learning(lines):
    """Reads lines one by one."""
    known: list[str] = []
    for text in lines:
        c = text.replace(" ", "")
        if any(c.startswith(k.replace(" ", "")) for k in known):
            continue
        w = text.split(" ")
        name = f"{w[0]} {w[1]}" if len(w) > 1 and len(w[0]) <= 3 else w[0]
        if len(name.replace(" ", "")) >= 3:
            known.append(name)
    return known


@pytest.mark.parametrize("seed", range(6))
def test_learning_equals_reading_one_by_one(spark, seed):
    r = random.Random(seed)
    pool = []
    for _ in range(60):  # names that begin one another, cut at different places
        s = "".join(r.choice("xy") for _ in range(r.randrange(3, 9)))
        at = r.randrange(1, len(s) + 1)
        pool.append((s[:at] + " " + s[at:]).strip())
    lines = [r.choice(pool) for _ in range(300)]
    rows = [(i // 7, i % 7, t.title()) for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "receipt_id long, line_no int, shown string").repartition(5)
    got = learned_in_order(df, "shown", ["receipt_id", "line_no"]).orderBy("at").collect()
    assert [g.norm for g in got] == brute_learning(lines)


def test_what_one_receipt_teaches_the_next_one_knows(spark):
    texts = [
        (1, "TIENDA UNO\nZafiro Te 10,00\nZafiro 20,00"),
        (2, "TIENDA UNO\nZafirote Verde 10,00"),
        (3, "PedidosYa Market\nPan con Zafiro\n$ 10,00"),
        (0, "PedidosYa Market\nPan con Zafiro\n$ 10,00"),
    ]
    df = spark.createDataFrame(texts, "receipt_id long, raw_text string")
    frozen, learned = (
        {(r.receipt_id, r.line_no): r.marca for r in receipt_items(df, 2026, learn=x).collect()} for x in (False, True)
    )
    assert frozen[2, 1] == "Zafirote" and learned[2, 1] == "Zafiro"
    assert frozen[3, 1] == "Generico" and learned[3, 1] == "Zafiro"
    assert frozen[0, 1] == learned[0, 1] == "Generico"  # read before anyone taught it
    rows = {r.receipt_id: r for r in parse(df, 2026, learn=True).collect()}
    assert len(rows) == 4 and "Zafiro" in rows[2].csv


def test_thousands_of_stores_and_rules(spark):
    """Lists beyond the literals are joined, with the same answers."""
    df = spark.createDataFrame(
        [(1, "KIOSCO 77\nArroz Integral 10,00"), (2, "kiosco 5000 y kiosco 12\nArroz ref4000q 1,00"), (None, None), (4, "")],
        "receipt_id long, raw_text string",
    )
    stores = store_aliases([(f"kiosco {k}", f"Casa {k}") for k in reversed(range(5200))])
    rules = product_rules([(f"Rubro {k}", [f"ref{k}q", f"zz{k}"]) for k in range(5200)] + [("Grano", ["integral"])])
    got = {r.receipt_id: (r.lugar_de_compra, r.descripcion) for r in receipt_items(df, 2026, stores, rules=rules).collect()}
    assert got == {1: ("Casa 77", "Grano"), 2: ("Casa 5000", "Rubro 4000")}


def test_boxes_are_folded_without_python(spark):
    schema = "receipt_id long, page int, variant_pos int, box_no int, text string, score double, top double, left double, height double"
    r = random.Random(1)
    rows = [
        (p, 0, 0, i, f"t{i}", r.random(), float(r.randrange(300)), float(r.randrange(400)), float(r.randrange(1, 60)))
        for p in range(20) for i in range(r.randrange(1, 30))
    ]
    df = box_rows(spark.createDataFrame(rows, schema))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    got: dict[int, list] = {}
    for x in df.orderBy("receipt_id", "line_no").collect():
        got.setdefault(x.receipt_id, []).append((x.text, x.score, x.top, x.left))
    for p in range(20):
        lines: list[dict] = []
        for b in sorted((x for x in rows if x[0] == p), key=lambda x: (x[6], x[7], x[3])):
            center = b[6] + b[8] / 2
            for line in lines:
                if abs(center - line["sum"] / len(line["of"])) <= max(18.0, 0.8 * min(line["height"], b[8])):
                    break
            else:
                line = {"sum": 0.0, "height": 0.0, "of": []}
                lines.append(line)
            line["sum"] += center
            line["height"] = max(line["height"], b[8])
            line["of"].append(b)
        made = [
            (" ".join(x[4] for x in sorted(line["of"], key=lambda x: x[7])), *(min(x[c] for x in line["of"]) for c in (5, 6, 7)))
            for line in lines
        ]
        assert got[p] == sorted(made, key=lambda x: (x[2], x[3]))

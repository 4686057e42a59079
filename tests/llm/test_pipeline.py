"""The pipeline at sf0.001 against the operators' own brute-force versions."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from tests.llm.test_lines_and_chats import brute_lines
from tests.llm.test_mixing import brute_targets
from tests.llm.test_near_dedup import brute_classes
from tests.llm.test_quality import WORD
from tests.llm.test_quality import brute as brute_counts
from tillscan.llm import quality
from tillscan.llm.common import cut, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in P.STAGES:
        after = cut(stage(spark, docs, SF))
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_shape(stages):
    assert [s[0] for s in stages] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "bpe"]
    assert all(s[3] == P.COLUMNS for s in stages[:-1])


def test_quality_keeps_clean_documents(spark, stages):
    _, before, after, _ = stages[0]
    quality = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in after}
    poor = [r.doc_id for r in before if quality.get(r.doc_id) == 0]
    assert set(map(str, after)) <= set(map(str, before))
    assert sum(d not in kept for d in poor) >= 0.7 * len(poor)


def best_labels(scores, moves):
    """The best labelling from the best ones that end in content and in boilerplate."""
    ends = None
    for s in scores:
        if ends is None:
            ends = [(0.0, [0]), (s, [1])]
            continue
        ends = [
            max(((v + moves[a][b] + b * s, [*path, b]) for a, (v, path) in enumerate(ends)), key=lambda x: x[0])
            for b in (0, 1)
        ]
    return max(ends, key=lambda x: x[0])[1]


def test_quality_equals_brute_force(spark, stages):
    _, before, after, _ = stages[0]
    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    good = {r.doc_id for r in table(spark, SF, "labels").collect() if r.quality == 1}
    want, clean = Counter(), []
    for r in before:
        text = r.text or ""
        n, _, _, _, again = brute_counts(text)
        if n < 10 or 100 * again > 20 * n:
            continue
        scores = (quality.measure([text]).features @ model.weights).tolist()
        labels = best_labels(scores, model.moves.tolist())
        own = [len(WORD.findall(line)) for line in text.split("\n")]
        keep = sum(w for w, b in zip(own, labels, strict=True) if not b) >= quality.MIN_CONTENT * n
        want[r.doc_id, r.text] += keep
        if r.doc_id in good:
            clean.append(keep)
    assert Counter((r.doc_id, r.text) for r in after) == +want
    assert clean and sum(clean) >= 0.98 * len(clean)


def test_line_dedup(stages):
    _, before, after, _ = stages[1]
    want = Counter((i, t) for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in before]))
    assert Counter((r.doc_id, r.text) for r in after) == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_dedup(stages):
    _, before, after, _ = stages[2]
    want = {c for _, c in brute_classes([(r.doc_id, r.text) for r in before])}
    assert sorted(r.doc_id for r in after) == sorted(want)


def test_mixing(stages):
    _, before, after, _ = stages[3]
    assert set(map(str, after)) <= set(map(str, before))
    assert max(Counter(r.doc_id for r in after).values()) <= 3
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        n = len(WORD.findall(r.text or ""))
        sizes[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    for r in after:
        taken[r.source] += len(WORD.findall(r.text or ""))
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= longest[source]


def test_bpe(stages):
    from tokenizers import Tokenizer

    from tillscan.llm.bpe import public_path

    _, before, after, _ = stages[4]
    other = Tokenizer.from_file(public_path())
    want = Counter((r.doc_id, tuple(other.encode(r.text, add_special_tokens=False).ids)) for r in before)
    assert Counter((r.doc_id, tuple(r.ids)) for r in after) == want


def test_run_agrees_with_the_stages(spark, stages):
    assert sorted(map(str, P.run(spark, SF).collect())) == sorted(map(str, stages[-1][2]))


def test_odd_documents(spark, tmp_path):
    """Nulls, rows alike, clashing columns and empty tables: as the docstring has it."""
    docs = table(spark, SF, "documents").limit(60).collect()
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs]
    odd = [(None, base[0][1], None, None, None), (None, None, None, None, None), (5, None, "en", "s", 0), (6, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, rank int"
    rows = [(*r, "k", "z", 1) for r in base + base[:20] + odd]
    results = []
    for name, some in (("odd", rows), ("empty", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        table(spark, SF, "labels").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = table(spark, f"{tmp_path}/{name}", "documents")
        for _, stage in P.STAGES[:3]:
            docs = cut(stage(spark, docs, f"{tmp_path}/{name}"))
            assert docs.columns == P.COLUMNS
        results.append([tuple(r) for r in docs.collect()])
        assert P.run(spark, f"{tmp_path}/{name}").count() >= 0
    assert results[1] == []
    kept = results[0]
    assert len(kept) == len({r[1] for r in kept}) and not any(r[1] is None for r in kept)

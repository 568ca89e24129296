"""Work that grew with rounds, words or shuffles: each test counts what the former code did more often."""

from __future__ import annotations

import numpy as np
import pytest

from hearthframe.llm import components, minmax, pieces, suffixes
from hearthframe.llm.queries import TOKENIZERS


def counted(monkeypatch, module, name):
    calls, run = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **b: calls.append(a) or run(*a, **b))
    return calls


@pytest.mark.parametrize("edges, writes", [([(2, 1), (3, 1), (9, 8)], 1), ([(k, k + 1) for k in range(12)] + [(40, 41), (41, 40), (5, 5)], None)])
def test_components_stop_at_stars(spark, monkeypatch, edges, writes):
    calls = counted(monkeypatch, components, "materialise")
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert writes is None or len(calls) == writes


def test_a_crowd_takes_few_rounds(spark, monkeypatch):
    """Chains of documents share one common passage, so its shingles have 150 holders in 30 components."""
    rng = np.random.default_rng(5)
    common, rows = [f"c{k}" for k in range(12)], []
    for group in range(30):
        own = [f"g{group}w{k}" for k in range(6)]
        for copy in range(5):
            rows.append((group * 5 + copy, " ".join([*common, *own, *(f"x{rng.integers(1 << 40)}" for _ in range(copy % 2))])))
    steps = counted(monkeypatch, minmax.Links, "test")
    got = {r.doc_id: r.component_id for r in minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1).collect()}
    sets = [set(t.split()) for _, t in rows]
    want = list(range(len(rows)))
    for _ in range(5):
        for a in range(len(rows)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    want[a] = want[b] = min(want[a], want[b])
    assert [got[k] for k in range(len(rows))] == want
    assert len(steps) <= 4      # 1 of the bands and 3 of the shingles


def test_rounds_leave_no_member_out():
    edges = [minmax.first_hub(k) for k in range(6)]
    assert edges[0] == 0 and edges == sorted(set(edges)) and edges[1] == 1


def test_words_in_use_outlive_a_full_memory(monkeypatch):
    model = pieces.load_pieces(f"{TOKENIZERS}/piece_bpe_32k.model")
    monkeypatch.setattr(pieces, "REMEMBERED", 4)
    calls = counted(monkeypatch, pieces.PieceModel, "segment")
    text = " ".join(f"again {w}" for w in ("alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"))
    ids = model.encode(text)
    assert model.decode(ids) == text
    assert sum(a[1] == "▁again" for a in calls) == 1
    assert len(model.words) <= 4 and len(model.older) <= 4


def test_short_search_equals_the_windowed_one(monkeypatch):
    model = pieces.load_pieces(f"{TOKENIZERS}/piece_bpe_32k.model")
    words = ["▁Anblewhere", "▁auxréoumentmentè", "日本語テキスト", "▁▁▁x", "🙂é́", "a", "▁unbelievablyantidisestablishment"]
    short = [model.segment_short(w) for w in words]
    monkeypatch.setattr(pieces, "OPEN", 0)
    monkeypatch.setattr(pieces.PieceModel, "commit", lambda self, last, came, base, at, committed: base)
    assert model.segment_short("") == []
    monkeypatch.setattr(pieces, "OPEN", 4)
    assert [model.segment(w) if len(w) > 4 else model.segment_short(w) for w in words] == short


def test_decoding_with_and_without_bytes():
    model = pieces.load_pieces(f"{TOKENIZERS}/piece_bpe_32k.model")
    for text in ("", " ", "plain words", "ሴ \U0010ffff end", " two  spaces"):
        ids = model.encode(text)
        assert model.decode(ids) == model.decode(ids.tolist()) == text


def test_matches_are_not_shuffled_to_be_made_distinct(spark, monkeypatch):
    plans, settle = {}, suffixes.settle
    monkeypatch.setattr(suffixes, "settle", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().analyzed().toString()) and settle(df, name))
    text = "a passage that comes back whole, of somewhat more than one hundred bytes, so that it makes a window; " * 2
    rows = [(1, text), (1, text), (2, "other " + text), (3, "short"), (4, None)]
    got = {(r.doc_id, r.n_removed > 0) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, True), (2, True), (3, False), (4, False)}
    assert "Deduplicate" not in plans["suffix-matches"] and "Distinct" not in plans["suffix-matches"]


def test_levels_merge_without_being_asked(spark, monkeypatch):
    """By itself the family gets several batches, more with more text, and its levels merge; results do not depend on that."""
    passage = "a passage of somewhat more than one hundred bytes that comes back in documents of one batch and of other ones, too"
    rows = [(k, " ".join([f"w{k * 7919 % 997}x{j}" for j in range(40)] + [passage] * (k % 3 == 0))) for k in range(60)] + [(3, "again " + passage), (70, None)]
    docs, ranks, matched = spark.createDataFrame(rows, "doc_id long, text string"), [], suffixes.SuffixFamily.matched
    monkeypatch.setattr(suffixes.SuffixFamily, "matched", lambda family: ranks.append([rank for rank, _ in family.levels]) or matched(family))
    want = sorted(map(str, suffixes.remove_repeats(docs, batches=1).collect()))
    assert sorted(map(str, suffixes.remove_repeats(docs).collect())) == want and sum("n_removed=0" in row for row in want) == 42
    assert ranks == [[1], [4]]
    monkeypatch.setattr(suffixes, "BATCH_BYTES", sum(len(text or "") for _, text in rows) // 6, raising=False)
    assert sorted(map(str, suffixes.remove_repeats(docs).collect())) == want
    assert len(ranks[2]) < sum(ranks[2]) and sum(ranks[2]) >= 6 and ranks[2][0] == 4


def test_neighbours_in_an_array_have_seeds_in_order(spark):
    docs = spark.createDataFrame([(k, f"{'passage ' * 14}{k % 5} {k} {'of words ' * 20}") for k in range(40)], "doc_id long, text string")
    pieces = suffixes.suffix_arrays(docs, 100, [9.0, 19.0])
    parts = pieces.rdd.glom().collect()
    assert sum(map(len, parts)) > 40 and {r.batch for part in parts for r in part} == {0, 1, 2}
    for part in parts:
        assert [(r.batch, r.seed) for r in part] == sorted((r.batch, r.seed) for r in part)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)   # seeds go on in the next batch
    try:
        whole = suffixes.merged(pieces, "batch").rdd.glom().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [r for part in whole for r in part]
    found = {}
    for r in rows:
        found.setdefault((r.batch, r.seed), []).append(r)
    assert len(rows) == sum(map(len, parts)) and any(len(v) > 7 for v in found.values())
    known = {(r.batch, r.seed) for part in parts for r in part if r.met}
    assert all(sum(r.head for r in v) == 1 and all(r.met == (len(v) > 1 or key in known) for r in v) for key, v in found.items())
    for part in whole:
        assert [(r.seed, r.batch) for r in part] == sorted((r.seed, r.batch) for r in part)

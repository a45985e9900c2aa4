import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import exact_dedup, ngram_join
from tracewell.llm.components import components

FOLD = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def test_exact_report(odd):
    rows = [(r.doc_id, (r.text or "").translate(FOLD)) for r in odd.collect()]
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text].append(doc_id)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact_dedup.dedup_report(odd).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    want = sorted((str(i), str(keep[t]), len(groups[t])) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_documents_keep_one_of_each_text(odd, none):
    out = exact_dedup.dedup(odd)
    assert out.columns == odd.columns
    rows = [(r.doc_id, (r.text or "").translate(FOLD)) for r in out.collect()]
    assert len({t for _, t in rows}) == len(rows) == odd.select(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).distinct().count()
    assert (11, "one two") in rows and (8, "three") in rows and (4, "") in rows
    assert exact_dedup.dedup(none).count() == 0 and exact_dedup.dedup_report(none).count() == 0


def test_index_persists_and_batches_repeat(spark):
    one = spark.createDataFrame([(5, "a"), (6, "A"), (7, "b")], "doc_id long, text string")
    two = spark.createDataFrame([(8, "B"), (9, "c"), (10, "c")], "doc_id long, text string")
    name = exact_dedup.index_name(spark)
    for _ in range(2):  # a batch that is sent again, its first result lost, decides as before
        got = exact_dedup.DigestIndex(spark, name).ingest(one, "one")
        assert sorted(r.doc_id for r in got.where("kept").collect()) == [6, 7]
    for _ in range(2):
        got = exact_dedup.DigestIndex(spark, name).ingest(two, "two")
        assert {(r.doc_id, r.keep_id, r.kept) for r in got.collect()} == {(8, 7, False), (9, 10, False), (10, 10, True)}
        assert exact_dedup.DigestIndex(spark, name).read().count() == 3
    assert exact_dedup.DigestIndex(spark, name).ingest(one, "three").where("kept").isEmpty()
    exact_dedup.DigestIndex(spark, name).drop()


def test_half_appended_batch_is_completed(spark):
    name = exact_dedup.index_name(spark)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, name)
    index.ingest(rows.where("doc_id = 1"), "x")  # as if the writer had died after the first digest
    assert sorted(r.doc_id for r in index.ingest(rows, "x").where("kept").collect()) == [1, 3]
    assert index.read().count() == 2
    index.drop()


def test_index_compacts_and_leaves_no_table(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BATCHES", 2)
    name = exact_dedup.index_name(spark)
    for k in range(5):
        got = exact_dedup.DigestIndex(spark, name).ingest(spark.createDataFrame([(k, f"t{k}"), (100 + k, "t0")], "doc_id long, text string"), f"b{k}")
        assert got.where("kept").count() == (1 if k else 1)
    index = exact_dedup.DigestIndex(spark, name)
    assert index.read().count() == 5 and index.table() != f"{name}_g0"
    index.drop()
    exact_dedup.dedup_report(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    assert not [t.name for t in spark.catalog.listTables(pattern="digest_index_*")]


def test_hot_groups_are_decided_alike(spark, monkeypatch, odd):
    want = sorted(map(repr, exact_dedup.dedup_report(odd).collect()))
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 1)
    assert sorted(map(repr, exact_dedup.dedup_report(odd).collect())) == want


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    edges = rng.integers(0, 60, (45, 2)).tolist() + [[100, k] for k in range(101, 130)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {v: find(v) for v in parent if any(v in e and e[0] != e[1] for e in edges)}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(map(tuple, got.collect())) == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """component of every id over all pairs of rows."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in parent}


def varied(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    passage = rng.choice(words, 60).tolist()
    rows = []
    for _ in range(12):  # chains of edits, so that components reach further than links
        text = rng.choice(words, int(rng.integers(3, 90))).tolist()
        for _ in range(int(rng.integers(1, 9))):
            text = list(text)
            for _ in range(int(rng.integers(0, 3))):
                text[int(rng.integers(len(text)))] = str(rng.choice(words))
            rows.append(" ".join(text))
    for _ in range(25):
        rows.append(" ".join(rng.choice(words, int(rng.integers(1, 40))).tolist() + passage))
    rows += ["Same Text here", "same text HERE", "", "  ", "one", "one", "two words"]
    return [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize("seed", range(4))
def test_ngram_components_match_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "FREQUENT_FROM", 6 if seed % 2 else 256)
    monkeypatch.setattr(ngram_join, "RECURS", 2)
    monkeypatch.setattr(ngram_join, "TILE", 4)
    if seed % 2:  # signatures and pairs of blocks in nearly all tiles, hot leaders
        monkeypatch.setattr(ngram_join, "LARGE", 3)
        monkeypatch.setattr(ngram_join, "BLOCK", 5)
        monkeypatch.setattr(ngram_join, "HOT_ROWS", 2)
    rows = varied(seed)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t)) for i, t in rows}


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: int(rng.integers(0, len(a) + 1))], rng.integers(0, 2**63, int(rng.integers(0, 60))).astype(np.uint64)]))
        if not len(b):
            continue
        common = len(np.intersect1d(a, b))
        truth = 100 * common >= 75 * (len(a) + len(b) - common)
        assert ngram_join.linked(a, b) == truth
        if truth:
            assert common >= ngram_join.needed(len(a), len(b))
            assert ngram_join.may_link(len(a), ngram_join.signature(a), len(b), ngram_join.signature(b))
        sides = [(len(x), ngram_join.signature(x)) for x in (a, b, a)]
        want = [ngram_join.may_link(*sides[k], *sides[k + 1]) for k in (0, 1)]
        got = ngram_join.may_link_all(np.array([len(a), len(b)]), [sides[0][1], sides[1][1]], np.array([len(b), len(a)]), [sides[1][1], sides[2][1]])
        assert got.tolist() == want


def test_folded_signatures_stay_bounded_and_sound():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 9000).astype(np.uint64))
    b = np.concatenate([a[:8500], rng.integers(0, 2**63, 300).astype(np.uint64)])
    x, y = (ngram_join.folded(ngram_join.signature(np.unique(s))) for s in (a, b))
    assert len(x) == len(y) == ngram_join.FOLDED
    assert ngram_join.may_link(len(a), x, len(np.unique(b)), y)


def test_runs_stay_whole():
    key = np.sort(np.random.default_rng(2).integers(0, 9, 200))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[k : k + 7])], ["k"]) for k in range(0, 200, 7)]
    got = [t.column("k").to_numpy() for t in ngram_join.runs_of(batches, ["k"], least=10)]
    assert np.concatenate(got).tolist() == key.tolist()
    assert all(x[-1] != y[0] for x, y in zip(got, got[1:]))


def test_odd_rows(odd, none):
    got = ngram_join.ngram_components(odd).collect()
    assert len(got) == odd.count()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id not in (None, 8)}
    assert found[1] == (6, 1) and found[2] == (6, 1) and found[3] == (0, 3) and found[5] == (0, 5)
    assert found[7][1] == 6 and found[11] == (1, 8)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert ngram_join.ngram_components(none).count() == 0
    kept = ngram_join.keep_representatives(odd)
    assert kept.columns == odd.columns
    assert sorted({r.doc_id for r in kept.collect() if r.doc_id}) == [1, 3, 4, 5, 6, 8, 9, 10]

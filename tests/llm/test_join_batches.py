"""op5's work done for many documents and tiles at a time gives what one at a time gives, and no pair is made twice."""

import re

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import ngram_join as N
from tracewell.llm.common import ASCII_LOWER


def odd_texts():
    rng = np.random.default_rng(4)
    letters = list("aBcd") + ["é", "日", "\x1c"]
    word = lambda: "".join(rng.choice(letters, int(rng.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 80, 200]))))
    texts = ["".join(word() + str(rng.choice([" ", "\t", "\n \v", "\f\r"])) for _ in range(int(rng.integers(40)))) for _ in range(80)]
    texts += ["", " ", "one", "", "A" * 65 + " " + "a" * 65 + " " + "a" * 64, *(" ".join(rng.choice(["a", "b"], k)) for k in range(60)), "x", ""]
    return texts


def true_sets(texts):
    out = []
    for t in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(ASCII_LOWER))
        out.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    return out


def test_shingles_of_all_texts_at_once():
    texts = odd_texts()
    sets, want = N.shingle_sets(texts), true_sets(texts)
    assert [len(s) for s in sets] == [len(w) for w in want]
    for i in range(len(texts)):
        assert (sets[i][1:] > sets[i][:-1]).all()
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])
    part = N.shingle_sets(pa.array(texts).slice(7, 60))  # arrays with an offset, as batches are cut
    assert all(np.array_equal(x, y) for x, y in zip(part, sets[7:67], strict=True))
    assert N.shingle_sets([]) == [] and [len(s) for s in N.shingle_sets(["", ""])] == [0, 0]


@pytest.mark.parametrize("at_once", [1000, 1 << 21])
def test_signatures_of_all_texts_at_once(monkeypatch, at_once):
    rng = np.random.default_rng(5)
    sets = [np.sort(rng.integers(0, 2**63, k * 37 % 5000).astype(np.uint64)) for k in range(150)]
    monkeypatch.setattr(N, "WORDS_AT_ONCE", at_once)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    whole, short = N.signatures_of(np.concatenate(sets), at)
    assert whole == [N.signature(s) for s in sets]
    assert short == [N.folded(b) for b in whole]


@pytest.mark.parametrize("forests", [False, True])
def test_small_tiles_together_give_the_pairs_of_each(spark, monkeypatch, forests):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    rows = []
    for shingle in range(60):
        for _ in range(m := int(rng.choice([2, 3, 5, 8, 20, 31, 32, 33]))):
            s = np.unique(np.concatenate([base[: int(rng.integers(90, 300))], rng.integers(0, 2**63, int(rng.integers(1, 30))).astype(np.uint64)]))
            bits = bytearray(N.folded(N.signature(s))) if m >= N.LARGE else None
            rows.append((shingle, 0, 0, 0, int(rng.integers(10**6)), len(s), int(rng.integers(0, 12)), int(rng.integers(40)), bits))
    tiles = spark.createDataFrame(rows, "shingle long, i int, j int, side int, doc_id long, n int, pos int, component long, bits binary")
    made = []
    for small in (0, 32):
        monkeypatch.setattr(N, "SMALL", small)
        made.append({(r.a, r.b) for r in N.tile_pairs(tiles, len(rows), forests=forests).collect()})
    assert made[0] == made[1] and len(made[0]) > 100


def test_verified_tiles_are_not_compared_again(spark, monkeypatch):
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for k in range(200):  # pairs that share half: a tile for each shared prefix shingle, no link
        half = rng.choice(words, 40).tolist()
        rows += [(2 * k + e, " ".join(half + rng.choice(words, 40).tolist())) for e in (0, 1)]
    plain, seen = N.tile_pairs, []

    def counted(tiles, *args, **kwargs):
        seen.append(tiles.count())
        return plain(tiles, *args, **kwargs)

    monkeypatch.setattr(N, "tile_pairs", counted)
    got = N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in got)
    assert seen[0] > 400 and seen[1] == 0  # before: as many rows again


def test_no_pair_is_verified_twice(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base, rows = [f"b{k}" for k in range(120)], []
    for k in range(60):  # near copies, many a little too different to link
        words = list(base)
        for _ in range(int(rng.integers(2, 5))):
            words[int(rng.integers(120))] = f"e{rng.integers(10**6)}"
        rows.append((k, " ".join(words)))
    plain, seen = N.verify, []

    def recorded(docs, signatures, pairs):
        pairs = N.cut(pairs, "recorded")
        seen.append({(min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect()})
        return plain(docs, signatures, pairs)

    monkeypatch.setattr(N, "verify", recorded)
    got = {r.doc_id: r.component_id for r in N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(seen) == 3 and len(seen[0]) > 0 and len(seen[1]) > 0
    assert not (seen[0] & seen[1] or seen[0] & seen[2] or seen[1] & seen[2])
    sets, up = N.shingle_sets([t for _, t in rows]), list(range(60))
    for i in range(60):
        for j in range(i):
            if N.linked(sets[i], sets[j]):
                low, high = sorted((up[i], up[j]))
                up = [low if u == high else u for u in up]
    assert got == dict(enumerate(up))

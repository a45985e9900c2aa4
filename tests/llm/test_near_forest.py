"""Groups of near copies without their original: few candidates a row, all links' components."""

import random

import numpy as np

from tracewell.llm import ngram_join as N


def copies(k, seed=1):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghij") + str(rng.randrange(3000)) for _ in range(120)]
    rows = []
    for i in range(k):
        words = list(base)
        for _ in range(rng.choice((2, 3, 4))):
            words[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


def test_candidates_do_not_grow_with_the_square(spark, monkeypatch):
    rows, made, plain = copies(300), [], N.tile_pairs

    def counted(*args, **kwargs):
        found = N.cut(plain(*args, **kwargs), "counted")
        made.append(found.count())
        return found

    monkeypatch.setattr(N, "tile_pairs", counted)
    got = {r.doc_id: r.component_id for r in N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, want = N.shingle_sets([t for _, t in rows]), list(range(300))
    for i in range(300):
        for j in range(i):
            if N.linked(sets[i], sets[j]) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    assert got == dict(enumerate(want))
    assert max(made) < 3 * 300  # thousands of pairs pass sizes, positions and narrow signatures


def test_forest_connects_what_its_edges_do_by_the_heaviest():
    rng = np.random.default_rng(2)
    for n, m in ((1, 0), (2, 1), (30, 20), (40, 300)):
        x, y, weight = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m) / 9.0
        kept = N.forest(x, y, weight, n)
        up, total = list(range(n)), 0.0

        def root(a):
            while up[a] != a:
                a = up[a]
            return a

        for k in np.argsort(-weight, kind="stable").tolist():  # Kruskal's
            a, b = root(x[k]), root(y[k])
            if a != b:
                up[a] = b
                total += weight[k]
        trees = len({root(a) for a in range(n)})
        assert len(kept) == n - trees and np.isclose(weight[kept].sum(), total)

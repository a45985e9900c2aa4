"""Learned and solved parts against plain loops and enumeration."""

from itertools import product

import numpy as np
import pytest

from tracewell.llm import language, mixing, packing, quality, queries
from tracewell.llm.oracles import ORACLES


@pytest.mark.parametrize("seed", range(3))
def test_first_split_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (200, len(quality.FEATURES))).astype(np.float32)
    y = ((x[:, seed + 3] > 6) ^ (rng.random(200) < 0.1)).astype(float)
    trees = quality.grow(x, y)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = y - p, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.SMOOTH)
    best = max(gain(x[:, f] <= c) + gain(x[:, f] > c) for f in range(x.shape[1]) for c in range(11) if min((x[:, f] <= c).sum(), (x[:, f] > c).sum()) * p * (1 - p) >= quality.LEAST_HESSIAN)
    left = x[:, trees.feature[0, 0]] <= trees.cut[0, 0]
    assert gain(left) + gain(~left) == pytest.approx(best)


def test_features_match_plain_counting():
    text = "The quick, QUICK fox!  the fox\nthe fox\n1234 jumps|over"
    row = dict(zip(quality.FEATURES, quality.features([text, ""])[0].tolist(), strict=True))
    words = text.split()
    assert row["letters"] == pytest.approx(sum(c.isalpha() for c in text) / len(text))
    assert row["upper"] == pytest.approx(sum(c.isupper() for c in text) / len(text))
    assert row["digits"] == pytest.approx(4 / len(text)) and row["lines"] == pytest.approx(2 / len(text))
    assert row["distinct"] == pytest.approx(len(set(words)) / len(words))
    assert row["top_word"] == pytest.approx(max(map(words.count, words)) / len(words))
    assert not quality.features([""]).any()


def test_language_hits_match_plain_lookups():
    rng = np.random.default_rng(0)
    sets = {name: rng.integers(0, 2**32, 400) for name in ("aa", "bb", "cc")}
    model = language.build(sets)
    asked = np.concatenate([rng.integers(0, 2**32, 300), sets["bb"][:120]]).astype(np.uint32)
    held = {n: [set(p.tolist()) for p in language.positions(s.astype(np.uint32))] for n, s in sets.items()}
    for k, name in enumerate(model.names):
        every = set().union(*held[name])  # both hashes mark one table
        found = sum(all(int(p) in every for p in at) for at in zip(*language.positions(asked)))
        rate = (len(every) / language.POSITIONS) ** language.HASHES
        assert model.hits(asked)[k] == pytest.approx(max(0.0, (found - len(asked) * rate) / (1 - rate)))
    assert int(model.hits(asked).argmax()) == 1


def test_language_ties_go_to_the_first():
    model = language.build({"bb": np.array([7]), "aa": np.array([7])})
    assert model.predict("zzzz qqqq")[0] == "aa" and model.predict(None) == ("und", 0.0) and model.predict("12 !")[0] == "und"


@pytest.mark.parametrize("seed", range(4))
def test_flow_is_optimal(seed):
    """All ways of giving two overlapping patterns' words to two sources, by enumeration."""
    rng = np.random.default_rng(seed)
    supply = {"p": int(rng.integers(1, 5)), "q": int(rng.integers(1, 5))}
    members, targets, repeats = {"p": ("a", "b"), "q": ("b",)}, {"a": int(rng.integers(0, 8)), "b": int(rng.integers(0, 8))}, 2
    cost = lambda taken, n: sum(min(n, max(0, taken - k * n)) * (k + 1) for k in range(repeats))
    best = None
    for pa, pb, qb in product(range(9), repeat=3):
        if pa + pb <= repeats * supply["p"] and qb <= repeats * supply["q"] and pa <= targets["a"] and pb + qb <= targets["b"]:
            one = (-(pa + pb + qb), cost(pa + pb, supply["p"]) + cost(qb, supply["q"]))
            best = one if best is None else min(best, one)
    flow = mixing.min_cost_flow(supply, members, targets, repeats)
    assert (-sum(flow.values()), sum(k * v for (_, k, _), v in flow.items())) == best
    assert all(sum(v for (p, k, _), v in flow.items() if (p, k) == (q, j)) <= supply[q] for q in supply for j in (1, 2))


def test_ranks_count_pieces_of_a_length():
    seen = np.zeros(5, np.int64)
    assert packing.ranks(np.array([3, 1, 3, 3]), seen).tolist() == [0, 0, 1, 2]
    assert packing.ranks(np.array([1, 3]), seen).tolist() == [1, 3]


@pytest.mark.parametrize("name", ["op1_sharding", "op8_exact_dedup"])
def test_registered_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    got, want = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(map(str, got[columns].astype(object).itertuples(index=False, name=None))) == sorted(map(str, want[columns].astype(object).itertuples(index=False, name=None)))

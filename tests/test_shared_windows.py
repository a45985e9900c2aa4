"""Series travel to kernels together, and a window that many spikes share is scored once."""

import numpy as np
from pyspark.sql import functions as F

from tracewell.operators import events as E
from tracewell.operators import segments as G
from tracewell.plans import batch, views

DATA = "/root/testdata/sf0.001"


def traces(spark, n=300):
    rng = np.random.default_rng(5)
    big = 1 << 60  # ids that a float would merge
    rows = [(None if s == 7 else big + s, k, float(v)) for s in range(n) for k, v in enumerate(rng.integers(0, 9, 40 + s % 7))]
    return spark.createDataFrame(rows, "series_id long, sample long, vm double").repartition(5), rows


def test_peaks_of_many_series_in_one_call(spark, monkeypatch):
    trace, rows = traces(spark)
    want = set()
    for s in {r[0] for r in rows}:
        v = [r[2] for r in rows if r[0] == s]
        tops = []
        for k in range(1, len(v) - 1):
            end = next((j for j in range(k, len(v)) if v[j] != v[k]), None)
            if v[k - 1] < v[k] and end is not None and v[end] < v[k]:
                tops.append(((k + end - 1) // 2, v[k]))
        kept = []
        for p, h in sorted(tops, key=lambda t: (-t[1], -t[0])):
            if all(abs(p - q) >= 4 for q, _ in kept):
                kept.append((p, h))
        for p, h in kept:
            lb = max((k for k in range(p) if v[k] > h), default=-1)
            rb = min((k for k in range(p + 1, len(v)) if v[k] > h), default=len(v))
            prominence = h - max(min(v[lb + 1 : p + 1]), min(v[p:rb]))
            if prominence >= 3:
                want.add((s, p, h, prominence))
    for limit in (E.BLOCK_TOPS, 20):  # one block, and many that end within series
        monkeypatch.setattr(E, "BLOCK_TOPS", limit)
        found = E.find_peaks(trace, 0.0, 4, 3.0)
        assert set(map(tuple, found.collect())) == want
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()


def shared(spark):
    """400 series with two spikes each, all at the same two frames of two stacks."""
    spikes = spark.createDataFrame([(s, k, f, 3, True) for s in range(400) for k, f in enumerate((5, 11))], "series_id long, spike_id long, frame long, interval long, picked boolean")
    recordings = spark.createDataFrame([(s, s % 2) for s in range(400)], "series_id long, stack_id int")
    rng = np.random.default_rng(1)
    px = spark.createDataFrame([(s, f, y, x, int(rng.integers(0, 100))) for s in range(2) for f in range(15) for y in range(3) for x in range(3)], "stack_id int, frame int, y int, x int, i int")
    return spikes, recordings, px


def test_windows_are_scored_once(spark):
    spikes, recordings, px = shared(spark)
    taken = G.windows_of(spikes, recordings)
    scores = G.window_scores(taken, px)
    assert scores.count() == 4 * 7 * 9  # not 800 spikes' rows
    plain = G.zscore(G.segment_pixels(spikes, recordings, px)).drop("i")
    got = G.spike_scores(taken, scores)
    order = ["series_id", "spike_id", "stack_id", "rel", "y", "x", "z"]
    rounded = lambda df: sorted(map(tuple, df.select(*order[:-1], F.round("z", 9)).collect()))
    assert rounded(got) == rounded(plain) and got.count() == 800 * 7 * 9
    weighted = G.weighted_scores(taken, scores)
    for f, name in ((G.aligned_median, "median_z"), (G.aligned_mean, "mean_z")):
        one = sorted(map(tuple, f(weighted, weight="spikes").withColumn(name, F.round(name, 9)).collect()))
        assert one == sorted(map(tuple, f(plain).withColumn(name, F.round(name, 9)).collect()))


def test_medians_of_series_match_percentiles(spark, monkeypatch):
    spikes, recordings, px = shared(spark)
    px = px.where("not (stack_id = 1 and frame = 4 and y = 2)").withColumn("i", F.when(~((F.col("frame") == 12) & (F.col("x") == 1)), F.col("i")))
    plain = G.zscore(G.segment_pixels(spikes, recordings, px)).groupBy("series_id", "rel", "y", "x").agg(F.round(F.percentile("z", 0.5), 9).alias("m"))
    want = sorted(map(tuple, plain.collect()), key=str)
    taken = G.windows_of(spikes, recordings)
    for tile, limit in ((64, 1 << 12), (2, 3)):
        monkeypatch.setattr(G, "TILE", tile)
        monkeypatch.setattr(G, "BLOCK_TILES", limit)
        got = G.series_medians(taken, G.window_scores(taken, px))
        assert sorted(map(tuple, got.withColumn("median_z", F.round("median_z", 9)).collect()), key=str) == want
    stacks = batch.median_stacks(spikes, recordings, px)
    assert stacks.where("frame = 3").count() == 400 * 9 and stacks.schema["y"].dataType.simpleString() == "int"


def test_segment_pages_find_the_spikes_once(spark):
    plan = views.segment_pages(spark, DATA)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan.split("== Physical Plan ==")[1] and "FlatMapGroupsInPandas" not in plan

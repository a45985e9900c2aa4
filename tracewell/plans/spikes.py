"""Queries over traces and the event-triggered pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import events as E
from tracewell.operators import segments as G
from tracewell.operators import threshold as H
from tracewell.sources import standins as S
from tracewell.sources.lineage import cut

from .parts import PEAKS, REC, SCORED, SPIKES, TR, otsu_double
from .registry import add

PEAK = "series_id:l pos:l h:4"


def gate(spark, sf_dir):
    return S.trace(spark, sf_dir).withColumn("gate", F.col("vm"))


GATE = TR + """, gb AS (SELECT series_id, min(CASE WHEN vm >= 2.0 THEN sample END) AS start, max(CASE WHEN vm >= 0.8 THEN sample END) + 1 AS stop FROM tr GROUP BY series_id)"""
add("gate_bounds", "series_id:l start:l stop:l", lambda s, d: E.gate_bounds(gate(s, d)), "SELECT * FROM gb", GATE)
add("gated_trace", "series_id:l sample:l vm:4", lambda s, d: E.within_gate(S.trace(s, d), E.gate_bounds(gate(s, d))),
    "SELECT series_id, sample - start AS sample, vm FROM tr JOIN gb USING (series_id) WHERE sample >= start AND sample < stop", GATE)
add("local_maxima", PEAK, lambda s, d: E.local_maxima(S.trace(s, d)), "SELECT * FROM mx", PEAKS)
add("peak_distance_nms", PEAK, lambda s, d: E.separate(E.local_maxima(S.trace(s, d)), S.PEAK_DISTANCE), "SELECT * FROM kept", PEAKS)
add("peak_prominence", f"{PEAK} prominence:6", lambda s, d: E.with_prominence(E.separate(E.local_maxima(S.trace(s, d)), S.PEAK_DISTANCE), S.trace(s, d)), "SELECT * FROM prom", PEAKS)


def peaks(spark, sf_dir):
    return E.find_peaks(S.trace(spark, sf_dir), 0.0, S.PEAK_DISTANCE, S.PEAK_PROMINENCE)


def spikes(spark, sf_dir):
    framed = E.spike_frames(peaks(spark, sf_dir), S.SAMPLES_PER_FRAME)
    return E.isolate(E.gaps(framed, S.recordings(spark, sf_dir)))


add("find_peaks", f"{PEAK} prominence:6", peaks, "SELECT * FROM pk", PEAKS)
add("spike_frames", f"{PEAK} frame:l", lambda s, d: E.spike_frames(peaks(s, d), S.SAMPLES_PER_FRAME), "SELECT *, pos // 2 AS frame FROM pk", PEAKS)
SPIKE = "series_id:l spike_id:l frame:l left_gap:l right_gap:l min_gap:l"
add("inter_spike_gaps", SPIKE, spikes, "SELECT * FROM sp", SPIKES)
add("picked_spikes", f"{SPIKE} intv:l", lambda s, d: spikes(s, d).where("picked").withColumnRenamed("interval", "intv"), "SELECT * FROM sp WHERE picked", SPIKES)
add("skipped_spikes", SPIKE, lambda s, d: spikes(s, d).where("not picked"), "SELECT * FROM sp WHERE NOT picked", SPIKES)
add("segment_frames", "series_id:l spike_id:l rel:l frame:l", lambda s, d: G.segment_frames(spikes(s, d)), "SELECT * FROM sg", SPIKES)
SAMPLES = "SELECT sg.series_id, sg.spike_id, sg.rel, tr.sample, tr.t, tr.vm FROM sg JOIN tr ON tr.series_id = sg.series_id AND tr.sample // 2 = sg.frame"


def samples(spark, sf_dir):
    return G.segment_samples(spikes(spark, sf_dir), S.trace(spark, sf_dir), S.SAMPLES_PER_FRAME)


add("segment_samples", "series_id:l spike_id:l rel:l sample:l vm:4", samples, SAMPLES, SPIKES)
add("centered_traces", "series_id:l spike_id:l sample:l t_ms:3 vm:4", lambda s, d: G.centred_traces(samples(s, d)),
    f"SELECT *, (t - first_value(t) OVER (PARTITION BY series_id, spike_id ORDER BY rel <> 0, sample)) * 1000 AS t_ms FROM ({SAMPLES})", SPIKES)
add("nearest_spike", "series_id:l frame:l", lambda s, d: spikes(s, d).groupBy("series_id").agg(F.min_by("frame", F.struct(F.abs(F.col("frame") - 15), "frame")).alias("frame")),
    "SELECT series_id, arg_min(frame, abs(frame - 15) * 100000 + frame) AS frame FROM sp GROUP BY series_id", SPIKES)


def windows(spark, sf_dir):
    """(windows of the picked spikes, scores of the distinct ones)."""
    taken = cut(G.windows_of(spikes(spark, sf_dir), S.recordings(spark, sf_dir)))
    return taken, G.window_scores(taken, S.pixels(spark, sf_dir))


def scored(spark, sf_dir):
    return G.spike_scores(*windows(spark, sf_dir))


def weighted(spark, sf_dir):
    return G.weighted_scores(*windows(spark, sf_dir))


CELL = "stack_id:l rel:l y:l x:l"
MEDIAN = "SELECT stack_id, rel, y, x, quantile_cont(z, 0.5) AS median_z, count(*) AS n FROM zz GROUP BY stack_id, rel, y, x"
add("zscore_segments", f"series_id:l spike_id:l {CELL} z:5", scored, "SELECT * FROM zz", SCORED)
add("spike_median", f"{CELL} median_z:5 n:l", lambda s, d: G.aligned_median(weighted(s, d), weight="spikes"), MEDIAN, SCORED)
add("spike_mean", f"{CELL} mean_z:5 n:l", lambda s, d: G.aligned_mean(weighted(s, d), weight="spikes"), "SELECT stack_id, rel, y, x, avg(z) AS mean_z, count(*) AS n FROM zz GROUP BY stack_id, rel, y, x", SCORED)
add("zscore_range", "stack_id:l p01:5 p99:5", lambda s, d: G.display_range(G.aligned_median(weighted(s, d), weight="spikes"), "median_z", "stack_id"),
    f"SELECT stack_id, quantile_cont(median_z, 0.01) AS p01, quantile_cont(median_z, 0.99) AS p99 FROM ({MEDIAN}) GROUP BY stack_id", SCORED)


def pipeline(spark, sf_dir):
    """Peaks to categories: the aligned median z-score of every stack, offset and pixel, and its
    category by two thresholds of the stack."""
    median = cut(G.aligned_median(weighted(spark, sf_dir), weight="spikes").select("stack_id", "rel", "y", "x", "n", F.round("median_z", 5).alias("median_z")))
    both = median.join(H.otsu_double(median, "median_z"), "stack_id")
    return both.withColumn("category", F.when(F.col("median_z") > F.col("bright"), 2).when(F.col("median_z") > F.col("dim"), 1).otherwise(0))


add("spike_triggered_pipeline", f"{CELL} median_z:5 n:l category:l", pipeline,
    "SELECT md.*, CASE WHEN median_z > bright THEN 2 WHEN median_z > dim THEN 1 ELSE 0 END AS category FROM md JOIN th USING (stack_id)",
    SCORED + f", md AS (SELECT * EXCLUDE (median_z), round(median_z, 5) AS median_z FROM ({MEDIAN})), " + otsu_double("md", "median_z"))

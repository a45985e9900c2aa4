"""Events in traces: gate bounds, peaks, frames, gaps and isolation.

Rows are (series_id, sample, t, vm). Everything runs on windows of a series or on the list of a
series' tops, which is short beside its samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import whole_runs

GATE_HIGH, GATE_LOW = 2.0, 0.8
LEAST_GAP, MOST_GAP = 3, 4
#: Tops handed to one call: series travel together up to it, a longer one alone.
BLOCK_TOPS = 1 << 16


def gate_bounds(trace: DataFrame, gate: str = "gate") -> DataFrame:
    """series_id, start (first sample at GATE_HIGH or more), stop (after the last at GATE_LOW or
    more). Series whose gate never rises have nulls."""
    return trace.groupBy("series_id").agg(
        F.min(F.when(F.col(gate) >= GATE_HIGH, F.col("sample"))).alias("start"),
        (F.max(F.when(F.col(gate) >= GATE_LOW, F.col("sample"))) + 1).alias("stop"),
    )


def within_gate(trace: DataFrame, bounds: DataFrame) -> DataFrame:
    """The gated samples, counted from 0 again."""
    inside = trace.join(bounds, "series_id").where("sample >= start and sample < stop")
    return inside.withColumn("sample", F.col("sample") - F.col("start")).drop("start", "stop")


def tops(trace: DataFrame) -> DataFrame:
    """series_id, seg, pos, h, peak, low: a series as its tops and the lowest value from each top
    to the next. A top is a run of equal samples above its neighbours (its middle sample, rounded
    down); those at an end of the trace are no peaks. seg 0, without a top, holds what rises to
    the first. One shuffle by series serves all steps."""
    order = Window.partitionBy("series_id").orderBy("sample")
    near = trace.withColumn("_new", F.when(F.lag("vm").over(order).eqNullSafe(F.col("vm")), 0).otherwise(1))
    runs = near.withColumn("_run", F.sum("_new").over(order)).groupBy("series_id", "_run").agg(
        F.min("sample").alias("_first"), F.max("sample").alias("_last"), F.first("vm").alias("h"))
    order = Window.partitionBy("series_id").orderBy("_run")
    near = runs.withColumns({"_l": F.lag("h").over(order), "_r": F.lead("h").over(order)})
    top = (F.col("_l").isNull() | (F.col("h") > F.col("_l"))) & (F.col("_r").isNull() | (F.col("h") > F.col("_r")))
    peak = top & F.col("_l").isNotNull() & F.col("_r").isNotNull()
    pos = F.floor((F.col("_first") + F.col("_last")) / 2)
    marked = near.withColumns({"_top": top.cast("int"), "_peak": peak, "_pos": pos}).withColumn("seg", F.sum("_top").over(order))
    first = lambda c: F.max(F.when(F.col("_top") == 1, c))
    return marked.groupBy("series_id", "seg").agg(
        first(F.col("_pos")).alias("pos"), first(F.col("h")).alias("h"), F.coalesce(first(F.col("_peak")), F.lit(False)).alias("peak"), F.min("h").alias("low"))


def local_maxima(trace: DataFrame, least: float = 0.0) -> DataFrame:
    """series_id, pos, h of samples above both sides; of a plateau its middle sample (rounded
    down). Plateaus that touch an end don't count; h is `least` or more."""
    return tops(trace).where(F.col("peak") & (F.col("h") >= least)).select("series_id", "pos", "h")


def apart(pos: np.ndarray, h: np.ndarray, distance: int) -> np.ndarray:
    """Which of the peaks (by ascending pos) survive greedy suppression from the highest down; of
    equal heights the later one goes first."""
    kept, gone = np.zeros(len(pos), bool), bytearray(len(pos))
    lo, hi = (np.searchsorted(pos, pos + d).tolist() for d in (1 - distance, distance))
    for k in np.lexsort((-pos, -h)).tolist():
        if not gone[k]:
            kept[k] = True
            gone[lo[k] : hi[k]] = b"\1" * (hi[k] - lo[k])
    return kept


def prominences(h: np.ndarray, low: np.ndarray, first_low: float) -> np.ndarray:
    """Of every top: its height over the higher of the lowest points on both sides, each side
    ending at the nearest strictly higher top or the trace's end. low[k] lies between tops k and
    k + 1; first_low before top 0. Every top is pushed and popped once."""

    def lowest(h: np.ndarray, before: np.ndarray) -> np.ndarray:
        out, stack = np.empty(len(h)), []  # (height, lowest since the entry below)
        for k, (x, v) in enumerate(zip(h.tolist(), before.tolist())):
            while stack and stack[-1][0] <= x:
                v = min(v, stack.pop()[1])
            out[k] = v
            stack.append((x, v))
        return out

    left = lowest(h, np.concatenate([[first_low], low[:-1]]))
    right = lowest(h[::-1], low[::-1])[::-1]
    return h - np.maximum(np.minimum(left, h), np.minimum(right, h))


def _by_series(rows: DataFrame, kernel: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """kernel(tops, first) on blocks of many whole series: their rows with seg > 0 by series and
    seg, `_s` numbering the series of the block, and the lowest value before each series' first
    top. A call costs more than most series' tops do, so series travel together."""
    series = rows.schema["series_id"].dataType.simpleString()
    names = [f.split()[0] for f in schema.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, new in whole_runs(batches, ["series_id"], BLOCK_TOPS):
            # ids stay in Arrow: among nulls, pandas would make floats of them
            pdf = block.drop_columns("series_id").to_pandas().assign(_s=new.cumsum() - 1, _at=np.arange(len(new)))
            first = np.full(int(new.sum()), np.inf)
            start = pdf[new & (pdf["seg"] == 0)]
            first[start["_s"]] = start["low"]
            found = kernel(pdf[pdf["seg"] > 0], first)
            ids = block.column("series_id").take(pa.array(found["_at"].to_numpy())).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[n].to_numpy()) for n in names)], ["series_id", *names])

    dealt = rows.where("seg is not null").repartition("series_id").sortWithinPartitions("series_id", "seg")
    return dealt.mapInArrow(stream, f"series_id {series}, {schema}")


def _prominence(tops: pd.DataFrame, first: np.ndarray) -> np.ndarray:
    """prominences of many series at once: an endless top before each keeps them apart."""
    at = np.arange(len(tops)) + tops["_s"].to_numpy() + 1
    before = np.ones(len(tops) + len(first), bool)
    before[at] = False
    h, low = np.full(len(before), np.inf), np.empty(len(before))
    h[at], low[at], low[before] = tops["h"], tops["low"], first
    return prominences(h[1:], low[1:], first[0])[at - 1] if len(tops) else np.empty(0)


def _apart(tops: pd.DataFrame, distance: int) -> pd.DataFrame:
    """The tops that `apart` keeps, of many series at once: each on its own stretch of positions."""
    if not len(tops):
        return tops
    pos = tops["pos"].to_numpy().astype(np.int64)
    pos -= pos.min()
    return tops[apart(pos + tops["_s"].to_numpy() * (pos.max() + 1 + max(0, distance)), tops["h"].to_numpy(), distance)]


def _longs(tops: pd.DataFrame) -> pd.DataFrame:
    return tops.assign(pos=tops["pos"].astype(np.int64))


def separate(peaks: DataFrame, distance: int) -> DataFrame:
    """Peaks that survive greedy suppression from the highest down: a peak falls to a kept one
    less than `distance` away; of equal heights the later one goes first."""

    def kernel(tops: pd.DataFrame, _: np.ndarray) -> pd.DataFrame:
        return _longs(_apart(tops, distance))

    return _by_series(peaks.select("*", (F.col("pos") + 1).alias("seg"), F.col("h").alias("low")), kernel, "pos long, h double")


def with_prominence(peaks: DataFrame, trace: DataFrame) -> DataFrame:
    """Add `prominence`: height over the higher of the lowest points on both sides, each side
    ending at the nearest strictly higher sample or the trace's end."""
    rows = tops(trace).join(peaks.select("series_id", "pos", F.lit(True).alias("_kept")), ["series_id", "pos"], "left")

    def kernel(tops: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        found = tops.assign(prominence=_prominence(tops, first))
        return _longs(found[found["_kept"].notna()])

    return _by_series(rows, kernel, "pos long, h double, prominence double")


def find_peaks(trace: DataFrame, least: float, distance: int, prominence: float) -> DataFrame:
    """series_id, pos, h, prominence: maxima, separated, then those prominent enough. The trace is
    read once; all steps run on its tops."""

    def kernel(tops: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        found = tops.assign(prominence=_prominence(tops, first))
        found = _apart(found[found["peak"] & (found["h"] >= least)], distance)
        return _longs(found[found["prominence"].round(6) >= prominence])

    return _by_series(tops(trace), kernel, "pos long, h double, prominence double")


def spike_frames(peaks: DataFrame, samples_per_frame: int, first_dropped: Column | int = 0) -> DataFrame:
    frame = F.floor(F.col("pos") / samples_per_frame) - first_dropped
    return peaks.withColumn("frame", frame)


def gaps(spikes: DataFrame, recordings: DataFrame) -> DataFrame:
    """Add spike_id, left_gap, right_gap and min_gap. The first left gap is the frame less one,
    as the original counts it."""
    order = Window.partitionBy("series_id").orderBy("pos")
    rows = spikes.join(recordings.select("series_id", "n_frames"), "series_id")
    left = F.coalesce(F.col("frame") - F.lag("frame").over(order) - 1, F.col("frame") - 1)
    right = F.coalesce(F.lead("frame").over(order) - F.col("frame") - 1, F.col("n_frames") - F.col("frame") - 1)
    rows = rows.withColumns({"spike_id": F.row_number().over(order) - 1, "left_gap": left, "right_gap": right})
    return rows.withColumn("min_gap", F.least("left_gap", "right_gap")).drop("n_frames")


def isolate(gapped: DataFrame, least: int = LEAST_GAP, most: int = MOST_GAP) -> DataFrame:
    """Add picked (enough frames on both sides) and interval (frames taken on each side)."""
    picked = F.col("min_gap") >= least
    return gapped.withColumns({"picked": picked, "interval": F.when(picked, F.least(F.col("min_gap"), F.lit(most)))})


def dropped_frames(recorded: Column, triggered: Column) -> Column:
    """Frames lost at the start: 1 as soon as the counts differ in either direction."""
    return F.when(recorded == triggered, 0).otherwise(1)

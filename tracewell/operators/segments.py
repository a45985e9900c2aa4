"""Event-centred windows: range joins as equi-joins, baselines, z-scores and aligned statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import whole_runs

#: What a spike's scores depend on.
WINDOW = ("stack_id", "spike_frame", "interval")
#: Side of the tiles of a frame that travel as one row, and rows of them handed to one call.
TILE, BLOCK_TILES = 64, 1 << 12


def segment_frames(spikes: DataFrame) -> DataFrame:
    """A row for each frame of each picked spike's window, with rel = frame - spike frame.
    Windows may overlap: a frame then serves both."""
    around = F.explode(F.sequence(-F.col("interval"), F.col("interval"))).alias("rel")
    return spikes.where("picked").select("series_id", "spike_id", F.col("frame").alias("spike_frame"), "interval", around).withColumn("frame", F.col("spike_frame") + F.col("rel"))


def segment_samples(spikes: DataFrame, trace: DataFrame, samples_per_frame: int, first_dropped: int = 0) -> DataFrame:
    """The trace's samples under each window's frames."""
    frames = segment_frames(spikes).withColumn("_f", F.col("frame") + first_dropped)
    framed = trace.withColumn("_f", F.floor(F.col("sample") / samples_per_frame))
    return framed.join(frames, ["series_id", "_f"]).drop("_f")


def centred_traces(segments: DataFrame) -> DataFrame:
    """Add t_ms: milliseconds from the first sample of the spike's frame."""
    whole = Window.partitionBy("series_id", "spike_id")
    zero = F.min(F.when(F.col("rel") == 0, F.struct("sample", "t"))).over(whole)["t"]
    return segments.withColumn("t_ms", (F.col("t") - zero) * 1000)


def segment_pixels(spikes: DataFrame, recordings: DataFrame, px: DataFrame) -> DataFrame:
    """series_id, spike_id, rel, stack_id, y, x, i: each window's frames of the paired stack."""
    frames = segment_frames(spikes).join(recordings.select("series_id", "stack_id"), "series_id")
    return frames.join(px, ["stack_id", "frame"]).select("series_id", "spike_id", "stack_id", "rel", "y", "x", "i")


def zscore(segments: DataFrame, value: str = "i", keys: tuple[str, ...] = ("stack_id", "series_id", "spike_id")) -> DataFrame:
    """Add z: value against the mean and population deviation of its pixel before the spike; a
    deviation of 0 counts as 1. `keys` tell windows apart."""
    pixel = Window.partitionBy(*keys, "y", "x")
    before = F.when(F.col("rel") < 0, F.col(value))
    mean, spread = F.avg(before).over(pixel), F.stddev_pop(before).over(pixel)
    return segments.withColumns({"_m": mean, "_s": spread}).withColumn("z", (F.col(value) - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")


def windows_of(spikes: DataFrame, recordings: DataFrame) -> DataFrame:
    """Picked spikes with the window that they take from their stack: series_id, spike_id and WINDOW."""
    frames = F.col("frame").alias("spike_frame")
    return spikes.where("picked").select("series_id", "spike_id", frames, "interval").join(recordings.select("series_id", "stack_id"), "series_id")


def window_scores(windows: DataFrame, px: DataFrame) -> DataFrame:
    """WINDOW, rel, y, x, z of the distinct windows. A window's scores depend on the stack, the
    spike's frame and the interval alone, so however many spikes share a window, it is scored once."""
    each = windows.select(*WINDOW).distinct()
    around = F.explode(F.sequence(-F.col("interval"), F.col("interval"))).alias("rel")
    frames = each.select("*", around).withColumn("frame", F.col("spike_frame") + F.col("rel"))
    return zscore(frames.join(px, ["stack_id", "frame"]).select(*WINDOW, "rel", "y", "x", "i"), keys=WINDOW).drop("i")


def spike_scores(windows: DataFrame, scores: DataFrame) -> DataFrame:
    """series_id, spike_id, stack_id, rel, y, x, z: every spike with its window's scores."""
    return windows.join(scores, list(WINDOW)).select("series_id", "spike_id", "stack_id", "rel", "y", "x", "z")


def weighted_scores(windows: DataFrame, scores: DataFrame) -> DataFrame:
    """scores with `spikes`, the number of spikes that share the window: what the statistics over
    spikes need, without a row for each spike."""
    return scores.join(windows.groupBy(*WINDOW).agg(F.count("*").alias("spikes")), list(WINDOW))


def series_medians(windows: DataFrame, scores: DataFrame) -> DataFrame:
    """series_id, rel, y, x, median_z: each series' median over its spikes at each offset and pixel.

    Scores travel as tiles of TILE x TILE pixels of a frame, so what a spike takes from its window
    is some rows, not a row for each pixel.
    """
    series = windows.schema["series_id"].dataType.simpleString()
    tile = {"_ty": F.floor(F.col("y") / TILE), "_tx": F.floor(F.col("x") / TILE)}
    one = F.collect_list(F.struct("y", "x", F.coalesce("z", F.lit(float("nan"))).alias("z")))
    tiles = scores.withColumns(tile).groupBy(*WINDOW, "rel", "_ty", "_tx").agg(one.alias("_t")).select(
        *WINDOW, "rel", "_ty", "_tx", *(F.col(f"_t.{c}").cast(f"array<{k}>").alias(c) for c, k in (("y", "int"), ("x", "int"), ("z", "double"))))
    keys = ["series_id", "rel", "_ty", "_tx"]
    rows = windows.join(tiles, list(WINDOW)).select(*keys, "y", "x", "z").repartition("series_id").sortWithinPartitions(*keys)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, new in whole_runs(batches, keys, limit=BLOCK_TILES):
            starts = np.flatnonzero(new)
            n = np.diff([*starts, block.num_rows])
            lengths = pc.list_value_length(block.column("z")).to_numpy()
            group = np.repeat(np.repeat(np.arange(len(starts)), n), lengths)
            y, x, z = (block.column(c).combine_chunks().flatten().to_numpy() for c in ("y", "x", "z"))
            key = (group * TILE + y % TILE) * TILE + x % TILE
            order = np.lexsort((z, key))  # NaN, which stands for null, comes last
            key, z = key[order], z[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            if not len(first):
                continue
            known = np.add.reduceat((~np.isnan(z)).astype(np.int64), first)
            low, high = z[first + np.maximum(known - 1, 0) // 2], z[first + known // 2]
            of = pa.array(starts[group[order][first]])
            yield pa.RecordBatch.from_arrays(
                [block.column("series_id").take(of).combine_chunks(), block.column("rel").take(of).combine_chunks(),
                 pa.array(y[order][first]), pa.array(x[order][first]), pa.array(0.5 * low + 0.5 * high, mask=known == 0)], ["series_id", "rel", "y", "x", "median_z"])

    return rows.mapInArrow(stream, f"series_id {series}, rel {rows.schema['rel'].dataType.simpleString()}, y int, x int, median_z double")


def aligned_median(scored: DataFrame, value: str = "z", weight: str | None = None) -> DataFrame:
    """Median over spikes at each offset and pixel; windows too short to reach an offset are
    simply absent from it. A row stands for as many spikes as its weight says."""
    n = F.count("*") if weight is None else F.sum(weight)
    return scored.groupBy("stack_id", "rel", "y", "x").agg(F.percentile(value, 0.5, *([F.col(weight)] if weight else [])).alias("median_z"), n.alias("n"))


def aligned_mean(scored: DataFrame, value: str = "z", weight: str | None = None) -> DataFrame:
    mean, n = F.avg(value), F.count("*")
    if weight is not None:
        mean, n = F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight))), F.sum(weight)
    return scored.groupBy("stack_id", "rel", "y", "x").agg(mean.alias("mean_z"), n.alias("n"))


def display_range(scored: DataFrame, value: str, *keys: str) -> DataFrame:
    """1st and 99th percentiles, with linear interpolation."""
    return scored.groupBy(*keys).agg(F.percentile(value, 0.01).alias("p01"), F.percentile(value, 0.99).alias("p99"))


def zip_strict(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("series_id", "spike_id")) -> DataFrame:
    """left and right side by side by keys; a row without a partner on either side is an error, as
    lists of unequal length are."""
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), list(keys), "full")
    named = F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
    checked = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.concat(F.lit("no partner for "), named))).otherwise(True)
    return both.withColumn("_ok", checked).where("_ok").drop("_l", "_r", "_ok")


def paired(pairs: DataFrame, traces: DataFrame, stacks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recordings, trace, pixels) of pairs by their keys: traces carry (exp_date, abf_serial),
    stacks (exp_date, img_serial). series_id and stack_id number pairs and images, by a 64-bit
    hash of the keys; a pair without a trace or a stack has n_samples or n_frames null."""
    numbered = pairs.withColumns({"series_id": F.xxhash64("exp_date", "abf_serial", "img_serial"), "stack_id": F.xxhash64("exp_date", "img_serial")})
    images = stacks.withColumn("stack_id", F.xxhash64("exp_date", "img_serial"))
    px = images.join(numbered.select("stack_id").distinct(), "stack_id", "left_semi").select("stack_id", "frame", "y", "x", "i")
    trace = traces.join(numbered.select("exp_date", "abf_serial", "series_id"), ["exp_date", "abf_serial"]).select("series_id", "sample", "t", "vm")
    frames = px.groupBy("stack_id").agg((F.max("frame") + 1).cast("long").alias("n_frames"))
    samples = trace.groupBy("series_id").agg(F.count("*").alias("n_samples"))
    return numbered.join(frames, "stack_id", "left").join(samples, "series_id", "left"), trace, px

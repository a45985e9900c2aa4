"""Stored frames (a row each, pixels in raster order) through Arrow kernels.

The form for full-size recordings: a frame of 1024 x 1024 is one row, never a million. Spatial
kernels take a frame at a time; the steps along time take bands of some rows of all frames, cut so
that a task holds about BAND_VALUES values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regions import label_array
from .spatial import blur_array, gaussian_kernel, morph_array

#: Values of a band over all its frames, about: what a task along time holds.
BAND_VALUES = 1 << 22


def on_frames(frames: DataFrame, kernel: Callable[..., np.ndarray], of: str = "pixels", given: tuple[str, ...] = (), kind: str = "double") -> DataFrame:
    """frames with `of` replaced by kernel(array (h, w), *given values of the row)."""
    schema = ", ".join(f"`{f.name}` {'array<' + kind + '>' if f.name == of else f.dataType.simpleString()}" for f in frames.schema)
    arrow = {"double": pa.float64(), "int": pa.int32()}[kind]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a frame at a time: its result goes out before the next
                one = batch.slice(k, 1)
                h, w, *more = (one.column(c)[0].as_py() for c in ("h", "w", *given))
                values = one.column(of).flatten().to_numpy(zero_copy_only=False).reshape(h, w)
                out = np.ascontiguousarray(kernel(values, *more)).ravel()
                column = pa.ListArray.from_arrays(pa.array([0, out.size], pa.int32()), pa.array(out, arrow))
                yield one.set_column(one.schema.get_field_index(of), of, column)

    return frames.mapInArrow(work, schema)


def blur(frames: DataFrame, sigma: float, border: str = "renorm", of: str = "pixels") -> DataFrame:
    taps = gaussian_kernel(sigma)

    def kernel(a: np.ndarray) -> np.ndarray:
        a = a[None].astype(float)
        known = np.ones(a.shape, bool)
        for axis in (2, 1):
            a = blur_array(a, known, taps, border, axis)
        return a[0]

    return on_frames(frames, kernel, of)


def categorize(frames: DataFrame, k: int = 3) -> DataFrame:
    """Morphological categories of frames that carry dim and bright."""

    def kernel(a: np.ndarray, dim: float, bright: float) -> np.ndarray:
        out = np.zeros(a.shape, np.int32)
        for c, mask in ((1, (a > dim) & (a <= bright)), (2, a > bright)):
            mask = mask[None]
            for shrink in (True, False, False, True):
                mask = morph_array(mask, k, shrink)
            out[mask[0]] = c
        return out

    return on_frames(frames, kernel, given=("dim", "bright"), kind="int")


def label(categories: DataFrame, category: int, connectivity: int = 8) -> DataFrame:
    """Region numbers of one category's pixels, 0 elsewhere."""
    return on_frames(categories, lambda a: label_array((a == category)[None], connectivity)[0], kind="int")


def preprocess(frames: DataFrame, window: int, sigma: float) -> DataFrame:
    """stack_id, frame, h, w, calibrated, smoothed (arrays of 0 to 65535): detrended by a moving
    average and brought to the stack's smallest mean; and that, blurred.

    Frames are cut into bands of rows; a band of all frames is one group. Its rows come back less
    their mean over time, with the band's smallest mean, so the stack's smallest mean is all that
    is left to add.
    """
    sizes = frames.groupBy("stack_id").agg(F.count("*").alias("_n"))
    each = F.greatest(F.lit(1), F.floor(F.lit(BAND_VALUES) / (F.col("_n") * F.col("w"))).cast("int"))
    cut_rows = frames.join(sizes, "stack_id").withColumn("_each", each)
    starts = F.sequence(F.lit(0), F.floor((F.col("h") - 1) / F.col("_each")).cast("int"))
    bands = cut_rows.select("stack_id", "frame", "h", "w", "_each", "pixels", F.explode(starts).alias("band"))
    bands = bands.withColumn("v", F.slice("pixels", F.col("band") * F.col("_each") * F.col("w") + 1, F.col("_each") * F.col("w"))).drop("pixels", "_each")

    def along_time(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame", ignore_index=True)
        a, half = np.stack(pdf["v"].to_numpy()).astype(float), window // 2
        sums = np.concatenate([np.zeros((1, a.shape[1])), a.cumsum(0)])
        lo, hi = np.clip(np.arange(len(a)) - half, 0, None), np.clip(np.arange(len(a)) + half, None, len(a))
        average = (sums[hi] - sums[lo]) / (hi - lo)[:, None]
        a -= average - np.minimum(average[0], average[-1])
        mean = a.mean(0)
        return pdf.drop(columns="v").assign(v=list(a - mean), low=mean.min())

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bands.schema if f.name != "v")
    centred = bands.groupBy("stack_id", "band").applyInPandas(along_time, f"{kept}, v array<double>, low double")
    whole = centred.groupBy("stack_id", "frame", "h", "w").agg(F.array_sort(F.collect_list(F.struct("band", "v"))).alias("b"), F.min("low").alias("low"))
    whole = whole.withColumn("pixels", F.flatten(F.transform("b", lambda b: b.v))).drop("b")
    low = whole.groupBy("stack_id").agg(F.min("low").alias("_low"))  # every frame holds all bands' lows
    raised = whole.drop("low").join(low, "stack_id").withColumn("pixels", F.transform("pixels", lambda v: F.round(v + F.col("_low"), 6))).drop("_low")
    both = blur(raised.withColumn("calibrated", F.col("pixels")), sigma)
    stored = lambda c: F.transform(c, lambda v: F.least(F.greatest(F.round(v, 3), F.lit(0.0)), F.lit(65535.0)).cast("int"))
    return both.select("stack_id", "frame", "h", "w", stored("calibrated").alias("calibrated"), stored("pixels").alias("smoothed"))

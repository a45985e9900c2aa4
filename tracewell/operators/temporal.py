"""Per-pixel operators along time. Rows are (stack_id, frame, y, x, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import gaussian_blur

PIXEL = ("stack_id", "y", "x")


def moving_average(value: str, window: int, keys: tuple[str, ...] = PIXEL) -> Column:
    """Mean over the half-open range [f - window // 2, f + window // 2), cut at the ends."""
    half = window // 2
    return F.avg(value).over(Window.partitionBy(*keys).orderBy("frame").rowsBetween(-half, half - 1))


def detrend(px: DataFrame, window: int, value: str = "i", keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Add `detrended`: value less its moving average, the average shifted so that the lower of
    its first and last values becomes 0. One shuffle by pixel serves all windows."""
    whole = Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    averaged = px.withColumn("_m", moving_average(value, window, keys))
    base = F.least(F.first("_m").over(whole), F.last("_m").over(whole))
    return averaged.withColumn("detrended", F.col(value) - (F.col("_m") - base)).drop("_m")


def mean_to_min(px: DataFrame, value: str = "i") -> DataFrame:
    """Add `aligned`: value less what its pixel's mean over time exceeds the stack's smallest
    mean. The mean is a window of the pixel, so it shares detrend's partitions; only the stacks'
    smallest means (one row a stack, broadcast by its size) are joined."""
    held = px.withColumn("_mean", F.avg(value).over(Window.partitionBy(*PIXEL)))
    low = held.groupBy("stack_id").agg(F.min("_mean").alias("_low"))
    return held.join(low, "stack_id").withColumn("aligned", F.col(value) - (F.col("_mean") - F.col("_low"))).drop("_mean", "_low")


def clip_uint16(value: Column) -> Column:
    """0 to 65535, cut towards zero, as stored in image files."""
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(65535.0)).cast("int")


def preprocess(px: DataFrame, window: int, sigma: float, value: str = "i") -> DataFrame:
    """stack_id, frame, y, x, calibrated, smoothed: the two stored forms of a recording.

    calibrated is detrended and then brought to the stack's smallest mean; smoothed is that,
    blurred. Both are cut to 0 to 65535. The steps along time share one partitioning by pixel,
    the blur takes another by frame.
    """
    calibrated = mean_to_min(detrend(px, window, value), "detrended").withColumn("_c", F.round("aligned", 6))
    blurred = gaussian_blur(calibrated.select("stack_id", "frame", "y", "x", "_c"), sigma, "_c")
    return blurred.select("stack_id", "frame", "y", "x", clip_uint16(F.round("_c", 3)).alias("calibrated"), clip_uint16(F.round("blurred", 3)).alias("smoothed"))

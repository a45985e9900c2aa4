"""Neighbourhood operators within frames: numpy kernels over whole frames, an axis at a time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import FRAME, cube, with_columns


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights of ceil(6 sigma) taps, made odd, that sum to 1."""
    size = math.ceil(6 * sigma)
    size += 1 - size % 2
    half = size // 2
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    return [w / sum(raw) for w in raw]


def blur_array(a: np.ndarray, known: np.ndarray, kernel: list[float], border: str, axis: int) -> np.ndarray:
    """One axis of a separable blur of (frames, height, width); absent pixels don't count."""
    half, n = len(kernel) // 2, a.shape[axis]
    total, weight = np.zeros(a.shape), np.zeros(a.shape)
    here = [slice(None)] * 3
    for k, w in enumerate(kernel):
        d = k - half
        if border == "clamp":
            at = np.clip(np.arange(n) + d, 0, n - 1)
            total += w * np.take(a, at, axis)
            continue
        if abs(d) >= n:
            continue
        to, of = list(here), list(here)
        to[axis], of[axis] = slice(max(0, -d), n - max(0, d)), slice(max(0, d), n - max(0, -d))
        total[tuple(to)] += w * np.where(known[tuple(of)], a[tuple(of)], 0.0)
        weight[tuple(to)] += w * known[tuple(of)]
    return total if border == "clamp" else total / np.where(weight > 0, weight, 1.0)


def gaussian_blur(px: DataFrame, sigma: float, value: str = "i", border: str = "renorm", keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Add `blurred`. border: "renorm" leaves taps outside the frame out and rescales; "clamp"
    repeats the edge pixels. Both axes run in one kernel on whole frames, with one shuffle."""
    if border not in ("renorm", "clamp"):
        raise ValueError("border must be 'renorm' or 'clamp'")
    taps = gaussian_kernel(sigma)

    def kernel(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        a, at = cube(pdf.assign(_v=pdf[value].astype(float)), "_v", np.nan)
        known = ~np.isnan(a)
        for axis in (2, 1):
            a = blur_array(a, known, taps, border, axis)
        return {"blurred": a[at]}

    return with_columns(px, kernel, "blurred double", keys)


def morph_array(a: np.ndarray, k: int, shrink: bool) -> np.ndarray:
    """Minimum or maximum over the (2k+1)-square of boolean (frames, height, width), x first;
    outside the frame is 0."""
    for axis in (2, 1):
        pad = [(0, 0)] * 3
        pad[axis] = (k, k)
        wide = np.pad(a, pad)
        parts = [np.take(wide, np.arange(d, d + a.shape[axis]), axis) for d in range(2 * k + 1)]
        a = (np.logical_and if shrink else np.logical_or).reduce(parts)
    return a


def _morph(px: DataFrame, flag: str, k: int, keys: tuple[str, ...], shrink: bool, name: str) -> DataFrame:
    def kernel(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        a, at = cube(pdf.assign(_v=pdf[flag].fillna(0).astype(bool)), "_v", False)
        return {name: morph_array(a, k, shrink)[at].astype(np.int32)}

    return with_columns(px, kernel, f"`{name}` int", keys)


def erode(px: DataFrame, flag: str, k: int, name: str = "eroded", keys: tuple[str, ...] = FRAME) -> DataFrame:
    return _morph(px, flag, k, keys, True, name)


def dilate(px: DataFrame, flag: str, k: int, name: str = "dilated", keys: tuple[str, ...] = FRAME) -> DataFrame:
    return _morph(px, flag, k, keys, False, name)


def roi_binning(px: DataFrame, roi: int, value: str = "i", keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Add `binned`: the mean of the pixel's roi x roi block; 0 in rows and columns left over."""
    by, bx = F.floor(F.col("y") / roi), F.floor(F.col("x") / roi)
    frame = Window.partitionBy(*keys)
    rows = px.withColumns({"_by": by, "_bx": bx})
    rows = rows.withColumns({"_h": F.max("y").over(frame) + 1, "_w": F.max("x").over(frame) + 1})
    block = F.avg(value).over(Window.partitionBy(*keys, "_by", "_bx"))
    inside = ((F.col("_by") + 1) * roi <= F.col("_h")) & ((F.col("_bx") + 1) * roi <= F.col("_w"))
    return rows.withColumn("binned", F.when(inside, block).otherwise(F.lit(0.0))).drop("_by", "_bx", "_h", "_w")


def categorize_morphological(px: DataFrame, dim: Column, bright: Column, k: int, value: str = "i", keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Add `category` 0, 1 or 2: each class is eroded, dilated, dilated and eroded; bright wins.
    All eight passes run in one kernel on whole frames, with one shuffle."""
    kind = F.when(F.col(value) > bright, 2).when(F.col(value) > dim, 1).otherwise(0)

    def kernel(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        kinds, at = cube(pdf, "_kind")
        out = np.zeros(kinds.shape, np.int32)
        for c in (1, 2):
            a = kinds == c
            for shrink in (True, False, False, True):
                a = morph_array(a, k, shrink)
            out[a] = c
        return {"category": out[at]}

    return with_columns(px.withColumn("_kind", kind), kernel, "category int", keys, drop=("_kind",))

"""Clustering of pixels: 1-D k-means, watershed, density clusters and region growing."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import FRAME, by_frames, cube
from .regions import PIXELS_PER_UM, label_array

ROUNDS = 12


def lloyd(v: np.ndarray, n: np.ndarray, k: int, rounds: int) -> list[float]:
    """Centres of sorted values v with counts n. Prefix sums are made once; a round looks up the
    borders in them."""
    total, up = int(n.sum()), np.cumsum(n)
    sums, counts = np.concatenate([[0.0], np.cumsum(v * n)]), np.concatenate([[0.0], np.cumsum(n.astype(float))])
    centres = []
    for j in range(k):  # exact quantiles, interpolated between neighbours
        place = (2 * j + 1) / (2 * k) * (total - 1)
        low, high = (v[np.searchsorted(up, q, "right")] for q in (int(np.floor(place)), min(total - 1, int(np.floor(place)) + 1)))
        centres.append(low + (high - low) * (place - np.floor(place)))
    for _ in range(rounds):
        at = np.searchsorted(v, [(a + b) / 2 for a, b in zip(centres, centres[1:])], "right")
        at = np.concatenate([[0], np.maximum.accumulate(at), [len(v)]]).astype(int)
        mass, size = np.diff(sums[at]), np.diff(counts[at])
        centres = [float(m / c) if c else old for m, c, old in zip(mass, size, centres)]
    return centres


def kmeans_centres(px: DataFrame, keys: tuple[str, ...], k: int = 3, value: str = "i", rounds: int = ROUNDS) -> DataFrame:
    """keys, centres: `rounds` rounds of Lloyd's steps on the value counts, from the middles of
    k equal quantile ranges, centres ascending. A value halfway belongs to the lower centre; an
    empty cluster keeps its centre. Only the counts of a group's distinct values meet in a task."""
    counts = px.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        return pdf.iloc[:1][list(keys)].assign(centres=[lloyd(pdf["v"].to_numpy(), pdf["n"].to_numpy(), k, rounds)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in px.select(*keys).schema)
    return counts.groupBy(*keys).applyInPandas(work, f"{schema}, centres array<double>")


def kmeans_labels(px: DataFrame, keys: tuple[str, ...], k: int = 3, value: str = "i", rounds: int = ROUNDS) -> DataFrame:
    """Add cluster, 0 to k - 1 by ascending centre. keys decide what is pooled: (stack, frame)
    for each frame apart, (stack,) for all frames together."""
    rows = px.join(kmeans_centres(px, keys, k, value, rounds), list(keys))
    above = sum((F.col(value) > (F.col("centres")[j] + F.col("centres")[j + 1]) / 2).cast("int") for j in range(k - 1))
    return rows.withColumn("cluster", above).drop("centres")


def cluster_areas(clustered: DataFrame, k: int, objective: str) -> DataFrame:
    """Pixels and square micrometres of every cluster of every frame, empty ones too."""
    if objective not in PIXELS_PER_UM:
        raise ValueError(f"unknown objective: {objective}")
    counts = clustered.groupBy(*FRAME).agg(*(F.count_if(F.col("cluster") == j).alias(f"_{j}") for j in range(k)))
    listed = counts.select(*FRAME, F.posexplode(F.array(*(F.col(f"_{j}") for j in range(k)))).alias("cluster", "n"))
    return listed.withColumn("area_um2", F.col("n") / PIXELS_PER_UM[objective] ** 2)


def concatenate_frames(px: DataFrame, width: int) -> DataFrame:
    """Frames side by side: x runs over all frames."""
    return px.withColumn("x", F.col("x") + F.col("frame") * width).drop("frame")


def split_frames(px: DataFrame, width: int) -> DataFrame:
    return px.withColumns({"frame": F.floor(F.col("x") / width).cast("int"), "x": (F.col("x") % width).cast("int")})


# ---- kernels for one frame ---------------------------------------------------------------


def _smooth(a: np.ndarray, sigma: float) -> np.ndarray:
    radius = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(radius, radius) if d == axis else (0, 0) for d in (0, 1)]
        wide = np.pad(a, pad, "symmetric")
        a = sum(w * np.take(wide, np.arange(d, d + a.shape[axis]), axis) for d, w in enumerate(k))
    return a


def _distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of every set pixel to the nearest unset one."""
    h, w = mask.shape
    far = float(h + w)
    up = np.where(mask, far, 0.0)
    for y in range(1, h):
        up[y] = np.minimum(up[y], up[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        up[y] = np.minimum(up[y], up[y + 1] + 1)
    gap = (np.arange(w)[:, None] - np.arange(w)[None]) ** 2
    return np.sqrt(np.stack([(gap + row[None] ** 2).min(1) for row in up])) * mask


def _local_peaks(a: np.ndarray, mask: np.ndarray, apart: int) -> list[tuple[int, int]]:
    wide = np.pad(a, apart, constant_values=-np.inf)
    top = np.max([wide[dy : dy + a.shape[0], dx : dx + a.shape[1]] for dy in range(2 * apart + 1) for dx in range(2 * apart + 1)], axis=0)
    at = np.argwhere((a == top) & mask)
    kept: list[tuple[int, int]] = []
    taken = np.zeros(a.shape, bool)
    for y, x in at[np.argsort(-a[tuple(at.T)], kind="stable")]:
        if not taken[y, x]:
            kept.append((int(y), int(x)))
            taken[max(0, y - apart) : y + apart + 1, max(0, x - apart) : x + apart + 1] = True
    return kept


def watershed_frame(a: np.ndarray, dim: float, bright: float, apart: int, min_size: int) -> np.ndarray:
    smooth = _smooth(a.astype(float), 1.5)
    mask = smooth > dim
    labels = np.zeros(a.shape, int)
    heap: list[tuple[float, int, int, int]] = []
    for k, (y, x) in enumerate(_local_peaks(_distance(mask), mask, apart), 1):
        labels[y, x] = k
        heap.append((-smooth[y, x], k, y, x))
    heapq.heapify(heap)
    age = len(heap)
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for ny, nx in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= ny < a.shape[0] and 0 <= nx < a.shape[1] and mask[ny, nx] and not labels[ny, nx]:
                labels[ny, nx] = labels[y, x]
                heapq.heappush(heap, (-smooth[ny, nx], age := age + 1, ny, nx))
    return _by_mean(a, labels, dim, bright, min_size)


def _by_mean(a: np.ndarray, labels: np.ndarray, dim: float, bright: float, min_size: int) -> np.ndarray:
    """Category of each label's pixels by the label's mean, 0 for small ones."""
    n = np.bincount(labels.ravel())
    mean = np.bincount(labels.ravel(), a.ravel().astype(float)) / np.maximum(n, 1)
    kind = np.where(mean > bright, 2, np.where(mean > dim, 1, 0))
    kind[n < min_size] = 0
    kind[0] = 0
    return kind[labels]


def dbscan_frame(a: np.ndarray, dim: float, eps: float, least: int, scale: float) -> np.ndarray:
    """Labels from 1 by raster order of a cluster's first core pixel; 0 for noise and outside.
    A border pixel joins the lowest cluster whose core it touches."""
    h, w = a.shape
    mask, v, r = a > dim, a.astype(float) * scale, int(eps)
    reach = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= eps * eps]

    def near(dy: int, dx: int) -> tuple[tuple[slice, slice], tuple[slice, slice], np.ndarray]:
        here = slice(max(0, -dy), h - max(0, dy)), slice(max(0, -dx), w - max(0, dx))
        there = slice(max(0, dy), h - max(0, -dy)), slice(max(0, dx), w - max(0, -dx))
        return here, there, mask[here] & mask[there] & (dy * dy + dx * dx + (v[here] - v[there]) ** 2 <= eps * eps)

    count = np.zeros(a.shape, int)
    for dy, dx in reach:
        here, _, close = near(dy, dx)
        count[here] += close
    core = mask & (count >= least)
    none = a.size
    lab = np.where(core, np.arange(a.size).reshape(a.shape), none)
    while True:
        before = lab.copy()
        for dy, dx in reach:
            here, there, close = near(dy, dx)
            lab[here] = np.where(close & core[here] & core[there], np.minimum(lab[here], lab[there]), lab[here])
        if np.array_equal(lab, before):
            break
    joined = lab.copy()
    for dy, dx in reach:
        here, there, close = near(dy, dx)
        joined[here] = np.where(close & ~core[here] & core[there], np.minimum(joined[here], lab[there]), joined[here])
    out = np.zeros(a.shape, int)
    if (joined < none).any():
        out[joined < none] = np.unique(joined[joined < none], return_inverse=True)[1] + 1
    return out


def grow_frame(a: np.ndarray, seed: float, growth: float, max_diff: float) -> np.ndarray:
    """Regions grown in seed order: from the first pixel of each 4-connected patch above `seed`
    to 8-neighbours above `growth` that differ from the seed pixel by less than max_diff. A later
    seed pixel takes its own place even inside an earlier region."""
    patches = label_array((a > seed)[None], 4)[0]
    regions, done = np.zeros(a.shape, int), np.zeros(a.shape, bool)
    values, first = np.unique(patches, return_index=True)
    for number, at in zip(values.tolist(), first.tolist(), strict=True):
        if not number:
            continue
        start = divmod(at, a.shape[1])
        queue = deque([start])
        regions[start], done[start] = number, True
        while queue:
            y, x = queue.popleft()
            box = slice(max(0, y - 1), y + 2), slice(max(0, x - 1), x + 2)
            fits = ~done[box] & (a[box] > growth) & (np.abs(a[box] - a[start]) < max_diff)
            for ny, nx in np.argwhere(fits) + (box[0].start, box[1].start):
                regions[ny, nx], done[ny, nx] = number, True
                queue.append((int(ny), int(nx)))
    return regions


def _framewise(px: DataFrame, value: str, kernel, name: str) -> DataFrame:
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, one in pdf.groupby("_f"):
            frame, (_, y, x) = cube(one.assign(_f=0), value)
            out.append(one[["stack_id", "frame", "y", "x"]].assign(**{name: kernel(frame[0], one)[y, x]}))
        return pd.concat(out)

    kept = ", ".join(f"{c} {px.schema[c].dataType.simpleString()}" for c in ("stack_id", "frame", "y", "x"))
    return by_frames(px, work, f"{kept}, {name} int")


def dbscan_labels(px: DataFrame, eps: float = 3.0, least: int = 10, scale: float = 10.0, value: str = "i") -> DataFrame:
    """Density clusters of the pixels above dim: stack_id, frame, y, x, cluster (0: none)."""
    return _framewise(px, value, lambda a, one: dbscan_frame(a, one["dim"].iloc[0], eps, least, scale), "cluster")


def dbscan_noise(px: DataFrame, labels: DataFrame, value: str = "i") -> DataFrame:
    """Per frame the clusters, and the pixels above dim that belong to none."""
    both = px.select("stack_id", "frame", "y", "x", (F.col(value) > F.col("dim")).alias("above")).join(labels, ["stack_id", "frame", "y", "x"])
    noise = F.count_if(F.col("above") & (F.col("cluster") <= 0))
    return both.groupBy("stack_id", "frame").agg(F.count_distinct(F.when(F.col("cluster") > 0, F.col("cluster"))).alias("n_clusters"), noise.alias("n_noise"))


def categorize_watershed(px: DataFrame, apart: int = 5, min_size: int = 20, value: str = "i") -> DataFrame:
    """px carries dim and bright, equal throughout a frame."""
    return _framewise(px, value, lambda a, one: watershed_frame(a, one["dim"].iloc[0], one["bright"].iloc[0], apart, min_size), "category")


def categorize_dbscan(px: DataFrame, eps: float = 3.0, least: int = 10, scale: float = 10.0, min_size: int = 20, value: str = "i") -> DataFrame:
    def kernel(a: np.ndarray, one: pd.DataFrame) -> np.ndarray:
        labels = dbscan_frame(a, one["dim"].iloc[0], eps, least, scale)
        return _by_mean(a, labels, -np.inf, one["bright"].iloc[0], min_size)

    return _framewise(px, value, kernel, "category")


def categorize_growing(px: DataFrame, seed: float = 2.0, growth: float = 0.5, max_diff: float = 0.5, min_size: int = 20, value: str = "i") -> DataFrame:
    return _framewise(px, value, lambda a, one: _by_mean(a, grow_frame(a, seed, growth, max_diff), -np.inf, one["bright"].iloc[0], min_size), "category")

"""The categorisers by name, with their thresholds, checks and statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster, regions, spatial, threshold

#: Methods, each (pixels with dim and bright, options) -> pixels with category.
METHODS: dict[str, Callable[..., DataFrame]] = {
    "morphological": lambda px, value, k=3: spatial.categorize_morphological(px, F.col("dim"), F.col("bright"), k, value),
    "connected": lambda px, value, min_size=20: regions.categorize_connected(px, F.col("dim"), F.col("bright"), min_size, value),
    "watershed": lambda px, value, apart=5, min_size=20: cluster.categorize_watershed(px, apart, min_size, value),
    "dbscan": lambda px, value, eps=3.0, least=10, scale=10.0, min_size=20: cluster.categorize_dbscan(px, eps, least, scale, min_size, value),
    "growing": lambda px, value, seed=2.0, growth=0.5, max_diff=0.5, min_size=20: cluster.categorize_growing(px, seed, growth, max_diff, min_size, value),
}


def categorize(px: DataFrame, method: str = "morphological", threshold_method: str = "otsu_double", value: str = "i", dim: float | None = None, bright: float | None = None, **options) -> DataFrame:
    """stack_id, frame, y, x, category (0 background, 1 dim, 2 bright). Thresholds are found once
    for a stack, categories for each frame. Unknown names and options, and manual thresholds
    without both values, are errors before anything runs."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    known = METHODS[method].__code__.co_varnames[2 : METHODS[method].__code__.co_argcount]
    if wrong := set(options) - set(known):
        raise ValueError(f"{method} has no option {', '.join(sorted(wrong))}; known: {', '.join(known)}")
    if any(isinstance(v, (int, float)) and v < 0 for v in options.values()):
        raise ValueError("options must not be negative")
    found = threshold.thresholds(px, threshold_method, value, dim=dim, bright=bright)
    return METHODS[method](px.join(found, "stack_id"), value, **options).select("stack_id", "frame", "y", "x", "category")


def category_statistics(categorized: DataFrame) -> DataFrame:
    """Pixels of every category and their share, for each frame."""
    n = F.count("*").alias("n")
    counts = categorized.groupBy("stack_id", "frame").agg(n, *(F.count_if(F.col("category") == c).alias(k) for c, k in enumerate(("background", "dim", "bright"))))
    return counts.select("stack_id", "frame", "n", "background", "dim", "bright", *((F.col(k) / F.col("n")).alias(f"{k}_share") for k in ("dim", "bright")))

"""Automatic thresholds from histograms. Only bins, never pixels, meet in one group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 256


def histogram(px: DataFrame, value: str, bins: int = BINS, key: str = "stack_id") -> DataFrame:
    """key, lo, hi, bin, n: equal bins from the smallest to the largest value, the last closed."""
    ends = px.groupBy(key).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = F.col("hi") - F.col("lo")
    place = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) * bins / width))).cast("long")
    return px.join(ends, key).groupBy(key, "lo", "hi", place.alias("bin")).agg(F.count("*").alias("n"))


def centre(bin_: Column, bins: int = BINS) -> Column:
    return F.when(F.col("hi") == F.col("lo"), F.col("lo")).otherwise(F.col("lo") + (bin_ + 0.5) * (F.col("hi") - F.col("lo")) / bins)


def otsu(px: DataFrame, value: str, name: str = "threshold", bins: int = BINS, key: str = "stack_id") -> DataFrame:
    """key, name: the centre of the bin after which splitting separates best (the first, on a
    tie); the value itself where all are equal."""
    up = Window.partitionBy(key).orderBy("bin")
    all_ = Window.partitionBy(key)
    mass = (F.col("bin") * F.col("n")).cast("double")
    h = histogram(px, value, bins, key).withColumns({
        "n0": F.sum(F.col("n").cast("double")).over(up), "s0": F.sum(mass).over(up),
        "nt": F.sum(F.col("n").cast("double")).over(all_), "st": F.sum(mass).over(all_)})
    n1 = F.col("nt") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("st") - F.col("s0")) / n1
    spread = F.when(n1 > 0, F.col("n0") * n1 * gap * gap).otherwise(F.lit(-1.0))
    return h.withColumn("_v", spread).groupBy(key).agg(F.max_by(centre(F.col("bin"), bins), F.struct("_v", -F.col("bin"))).alias(name))


def otsu_double(px: DataFrame, value: str, key: str = "stack_id") -> DataFrame:
    """key, dim, bright: a second threshold over the values above the first, or the first again."""
    first = otsu(px, value, "dim", key=key)
    above = px.join(first, key).where(F.col(value) > F.col("dim"))
    return first.join(otsu(above, value, "bright", key=key), key, "left").withColumn("bright", F.coalesce("bright", "dim"))


def multi_otsu(px: DataFrame, value: str, bins: int = BINS, key: str = "stack_id") -> DataFrame:
    """key, dim, bright: the two thresholds that together separate three classes best."""
    up = Window.partitionBy(key).orderBy("bin")
    all_ = Window.partitionBy(key)
    mass = (F.col("bin") * F.col("n")).cast("double")
    h = histogram(px, value, bins, key).withColumns({
        "n0": F.sum(F.col("n").cast("double")).over(up), "s0": F.sum(mass).over(up),
        "nt": F.sum(F.col("n").cast("double")).over(all_), "st": F.sum(mass).over(all_)}).select(key, "lo", "hi", "bin", "n0", "s0", "nt", "st")
    a, b = h.alias("a"), h.select(key, F.col("bin").alias("bin2"), F.col("n0").alias("n2"), F.col("s0").alias("s2"))
    two = a.join(b, key).where("bin < bin2 and n2 < nt")  # at most bins * bins / 2 rows a stack
    part = lambda s, n: s * s / n
    score = part(F.col("s0"), F.col("n0")) + part(F.col("s2") - F.col("s0"), F.col("n2") - F.col("n0")) + part(F.col("st") - F.col("s2"), F.col("nt") - F.col("n2"))
    best = two.groupBy(key).agg(F.max_by(F.struct("lo", "hi", "bin", "bin2"), F.struct(F.round(score, 3), -F.col("bin"), -F.col("bin2"))).alias("k")).select(key, "k.*")
    return best.select(key, centre(F.col("bin"), bins).alias("dim"), centre(F.col("bin2"), bins).alias("bright"))


def li_value(v: np.ndarray, n: np.ndarray, rounds: int = 30) -> float:
    """The threshold of sorted values v with counts n. Prefix sums are made once; a round is a
    lookup. Sides without a mean, or with a mean of the smallest value, leave it as it is."""
    low = v - v[0]
    mass, count = np.cumsum(low * n), np.cumsum(n)
    t = float((v * n).sum() / count[-1])
    for _ in range(rounds):
        k = int(np.searchsorted(v, t, "right"))
        if k == 0 or k == len(v):
            break
        below, above = mass[k - 1] / count[k - 1], (mass[-1] - mass[k - 1]) / (count[-1] - count[k - 1])
        if below <= 0 or above <= 0 or below == above:
            break
        t = float(v[0] + (below - above) / (np.log(below) - np.log(above)))
    return t


def li(px: DataFrame, value: str, name: str = "threshold", rounds: int = 30, key: str = "stack_id") -> DataFrame:
    """key, name: minimum cross-entropy, iterated `rounds` times from the mean over the distinct
    values' counts; only these counts meet in a task (at most 65,536 for stored images)."""
    counts = px.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count("*").cast("double").alias("n"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        return pdf.iloc[:1][[key]].assign(**{name: li_value(pdf["v"].to_numpy(), pdf["n"].to_numpy(), rounds)})

    return counts.groupBy(key).applyInPandas(work, f"`{key}` {px.schema[key].dataType.simpleString()}, `{name}` double")


def li_double(px: DataFrame, value: str, key: str = "stack_id") -> DataFrame:
    first = li(px, value, "dim", key=key)
    above = px.join(first, key).where(F.col(value) > F.col("dim"))
    return first.join(li(above, value, "bright", key=key), key, "left").withColumn("bright", F.coalesce("bright", "dim"))


def manual(px: DataFrame, dim: float | None, bright: float | None, key: str = "stack_id") -> DataFrame:
    if dim is None or bright is None:
        raise ValueError("manual thresholds need both dim and bright")
    return px.select(key).distinct().select(key, F.lit(float(dim)).alias("dim"), F.lit(float(bright)).alias("bright"))


def sweep(values: DataFrame, criterion: str, value: str = "v", low: int = 1, high: int = 9) -> DataFrame:
    """t, score of every integer threshold that leaves two classes. criterion: "otsu" (between-
    class variance), "li" (cross-entropy of class means, less is better) or "yen" (-log of the
    classes' squared shares). The values' counts, not the values, meet the thresholds."""
    counts = values.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").cast("double").alias("n"))
    each = counts.withColumn("t", F.explode(F.sequence(F.lit(low), F.lit(high))))
    lower, upper = F.col("v") <= F.col("t"), F.col("v") > F.col("t")
    s = each.groupBy("t").agg(*(F.sum(F.when(c, x).otherwise(0.0)).alias(k) for k, c, x in (
        ("n0", lower, F.col("n")), ("n1", upper, F.col("n")), ("s0", lower, F.col("v") * F.col("n")), ("s1", upper, F.col("v") * F.col("n"))))).where("n0 > 0 and n1 > 0")
    n, m0, m1 = F.col("n0") + F.col("n1"), F.col("s0") / F.col("n0"), F.col("s1") / F.col("n1")
    score = {
        "otsu": F.col("n0") / n * (F.col("n1") / n) * (m0 - m1) * (m0 - m1),
        "li": -F.col("s0") * F.log(m0 + 0.01) - F.col("s1") * F.log(m1 + 0.01),
        "yen": -F.log(F.pow(F.col("n0") / n, 2) + F.pow(F.col("n1") / n, 2) + 1e-10),
    }[criterion]
    return s.select("t", score.alias("score"))


METHODS = {"otsu_double": otsu_double, "li_double": li_double, "multi_otsu": multi_otsu}
SINGLE = {"otsu": otsu, "li": li}


def thresholds(px: DataFrame, method: str, value: str = "i", key: str = "stack_id", dim: float | None = None, bright: float | None = None) -> DataFrame:
    """key, dim, bright by the method's name. "manual" takes dim and bright as given; a single
    threshold ("otsu", "li") stands for both, so no value lies between."""
    if method == "manual":
        return manual(px, dim, bright, key)
    if method in SINGLE:
        return SINGLE[method](px, value, "dim", key=key).withColumn("bright", F.col("dim"))
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join([*METHODS, *SINGLE, 'manual'])}")
    return METHODS[method](px, value, key=key)

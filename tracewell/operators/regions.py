"""Connected regions and their measures.

Labelling runs per block of frames in numpy; frames are independent, so blocks can be as small
as one frame. Everything after the labels is plain aggregation.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import FRAME, by_frames, cube, with_columns

#: Pixels per micrometre by objective.
PIXELS_PER_UM = {"10X": 0.75, "40X": 3.0, "60X": 4.5}


def label_array(mask: np.ndarray, connectivity: int) -> np.ndarray:
    """Labels from 1 in raster order for each frame of mask (frames, height, width)."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    n, h, w = mask.shape
    none = mask.size
    lab = np.where(mask, np.arange(mask.size).reshape(mask.shape), none)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    while True:
        before = lab.copy()
        for dy, dx in steps:
            a = lab[:, : h - dy, max(0, -dx) : w - max(0, dx)]
            b = lab[:, dy:, max(0, dx) : w - max(0, -dx)]
            both = (a < none) & (b < none)
            np.minimum(a, b, out=a, where=both)
            np.minimum(a, b, out=b, where=both)
        flat = np.append(lab.ravel(), none)
        while not np.array_equal(flat, hop := flat[flat]):
            flat = hop
        lab = flat[:-1].reshape(mask.shape)
        if np.array_equal(lab, before):
            break
    out = np.zeros(mask.shape, np.int32)
    for k in range(n):
        out[k][mask[k]] = np.unique(lab[k][mask[k]], return_inverse=True)[1] + 1
    return out


def label_components(px: DataFrame, flag: Column, connectivity: int, name: str = "label") -> DataFrame:
    """Add the pixel's region number within its frame, 0 outside the flagged pixels."""
    rows = px.withColumn("_flag", F.coalesce(flag, F.lit(False)))

    def kernel(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        mask, at = cube(pdf, "_flag", False)
        return {name: label_array(mask, connectivity)[at]}

    return with_columns(rows, kernel, f"`{name}` int", drop=("_flag",))


def label_categories(px: DataFrame, category: Column, connectivity: int = 8, n: int = 2) -> DataFrame:
    """The pixels of categories 1 to n with their region number within frame and category; all
    categories are labelled in one pass. Pixels of other categories are left out."""
    rows = px.withColumn("category", category.cast("int"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds, at = cube(pdf, "category")
        label = np.zeros(len(pdf), np.int32)
        for c in range(1, n + 1):
            label += label_array(kinds == c, connectivity)[at]
        return pdf.drop(columns="_f").assign(label=label)[label > 0]

    return by_frames(rows.where("category is not null"), work, f"{kept}, label int")


def categorize_connected(px: DataFrame, dim: Column, bright: Column, min_size: int, value: str = "i") -> DataFrame:
    """Add category: a 4-connected region above dim is wholly bright if its mean exceeds bright,
    else dim; regions under min_size pixels are background."""
    labelled = label_components(px, F.col(value) > dim, 4, "_label")
    region = Window.partitionBy(*FRAME, "_label")
    size, mean = F.count(F.lit(1)).over(region), F.avg(value).over(region)
    category = F.when((F.col("_label") == 0) | (size < min_size), 0).when(mean > bright, 2).otherwise(1)
    return labelled.withColumn("category", category).drop("_label")


def region_props(labelled: DataFrame, min_area: int = 0, keys: tuple[str, ...] = (*FRAME, "category")) -> DataFrame:
    """area, centroid, half-open bounding box and spans of every region (label > 0)."""
    return labelled.where("label > 0").groupBy(*keys, "label").agg(
        F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"),
        F.min("y").alias("min_row"), F.min("x").alias("min_col"), (F.max("y") + 1).alias("max_row"), (F.max("x") + 1).alias("max_col"),
        (F.max("x") - F.min("x")).alias("x_span"), (F.max("y") - F.min("y")).alias("y_span"),
    ).where(F.col("area") >= min_area)


def largest_region(props: DataFrame, frames: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """The largest region of every frame in frames (the lowest label on a tie), or nulls."""
    fields = ("label", "area", "cy", "cx", "x_span", "y_span")
    best = props.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(F.col("area"), -F.col("label"))).alias("r"))
    return frames.select(*keys).distinct().join(best, list(keys), "left").select(*keys, *(F.col(f"r.{f}").alias(f) for f in fields))


def category_centroid(categorized: DataFrame, category: int) -> DataFrame:
    """Mean position over all pixels of a category in every frame, null where there are none."""
    hit = F.col("category") == category
    return categorized.groupBy(*FRAME).agg(F.avg(F.when(hit, F.col("y"))).alias("cy"), F.avg(F.when(hit, F.col("x"))).alias("cx"), F.count_if(hit).alias("n"))


def region_summary(props: DataFrame, frames: DataFrame) -> DataFrame:
    n = frames.select(*FRAME).distinct().groupBy("stack_id").agg(F.count("*").alias("n_frames"))
    sums = props.groupBy("stack_id").agg(F.count_if(F.col("category") == 1).alias("total_dim_regions"), F.count_if(F.col("category") == 2).alias("total_bright_regions"))
    return n.join(sums, "stack_id", "left").select("stack_id", "n_frames", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total_dim_regions", "total_bright_regions")))


def contour_edges(px: DataFrame, flag: Column) -> DataFrame:
    """Half-pixel points between neighbours that differ in flag: the contour's points, unordered."""
    rows = px.withColumn("_f", flag)
    right = F.lead("_f").over(Window.partitionBy(*FRAME, "y").orderBy("x"))
    down = F.lead("_f").over(Window.partitionBy(*FRAME, "x").orderBy("y"))
    seen = rows.withColumns({"_r": right, "_d": down})
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    across = seen.where("_r is not null and _f != _r").select(*FRAME, y.alias("ey"), (x + 0.5).alias("ex"))
    return across.unionByName(seen.where("_d is not null and _f != _d").select(*FRAME, (y + 0.5).alias("ey"), x.alias("ex")))


#: Segments of a 2x2 cell by its corners (top left 8, top right 4, bottom right 2, bottom left 1);
#: sides are Top, Right, Bottom, Left. In the two saddles the set corners stay apart.
CELL = {
    1: ("LB",), 2: ("BR",), 3: ("LR",), 4: ("TR",), 5: ("TR", "LB"), 6: ("TB",), 7: ("TL",), 8: ("TL",),
    9: ("TB",), 10: ("TL", "BR"), 11: ("TR",), 12: ("LR",), 13: ("BR",), 14: ("LB",),
}
SIDES = {"T": (0.0, 0.5), "R": (0.5, 1.0), "B": (1.0, 0.5), "L": (0.5, 0.0)}


def trace_contours(mask: np.ndarray) -> list[list[tuple[float, float]]]:
    """Ordered polylines at level 0.5, open ones first; closed ones repeat their first point."""
    m = mask.astype(int)
    kind = 8 * m[:-1, :-1] + 4 * m[:-1, 1:] + 2 * m[1:, 1:] + m[1:, :-1]
    links: dict[tuple[float, float], list[tuple[float, float]]] = defaultdict(list)
    for y, x in np.argwhere((kind > 0) & (kind < 15)):
        for a, b in CELL[int(kind[y, x])]:
            p, q = ((y + SIDES[s][0], x + SIDES[s][1]) for s in (a, b))
            links[p].append(q)
            links[q].append(p)
    lines = []
    for ends in (True, False):
        for start in sorted(links):
            if len(links[start]) == 0 or (ends and len(links[start]) != 1):
                continue
            line, at = [start], start
            while links[at]:
                to = links[at].pop()
                links[to].remove(at)
                line.append(to)
                at = to
            lines.append([(float(a), float(b)) for a, b in line])
    return lines


def largest_contours(labelled: DataFrame, largest: DataFrame) -> DataFrame:
    """stack_id, frame, contour, seq, ey, ex: the ordered contours of each frame's largest region
    (contour 0 first; holes give further ones)."""
    rows = labelled.join(largest.select(*FRAME, F.col("label").alias("_best")), list(FRAME)).withColumn("_in", F.col("label") == F.col("_best")).select(*FRAME, "y", "x", F.coalesce("_in", F.lit(False)).alias("_in"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (stack, frame), one in pdf.groupby(["stack_id", "frame"]):
            mask, _ = cube(one.assign(_f=0), "_in", False)
            for c, line in enumerate(trace_contours(mask[0])):
                out += [(stack, frame, c, k, y, x) for k, (y, x) in enumerate(line)]
        return pd.DataFrame(out, columns=["stack_id", "frame", "contour", "seq", "ey", "ex"])

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in FRAME)
    return by_frames(rows, work, f"{kept}, contour int, seq int, ey double, ex double")


def with_scale(rows: DataFrame, objective: str = "objective") -> DataFrame:
    """Add um_per_pixel by objective; an unknown objective is an error."""
    scale = F.element_at(F.create_map(*(F.lit(v) for kv in PIXELS_PER_UM.items() for v in kv)), F.col(objective))
    checked = F.when(scale.isNull(), F.raise_error(F.concat(F.lit("unknown objective: "), F.coalesce(F.col(objective), F.lit("null"))))).otherwise(1 / scale)
    return rows.withColumn("um_per_pixel", checked.cast("double"))


def to_um(value: Column, um_per_pixel: Column) -> Column:
    return value * um_per_pixel


def area_to_um2(value: Column, um_per_pixel: Column) -> Column:
    return value * um_per_pixel * um_per_pixel


def scale_bar(width_um: float, share: float = 0.2) -> float:
    """The length nearest to a share of the width among 1, 2 and 5 times powers of ten (the
    shorter one on a tie)."""
    if width_um <= 0:
        raise ValueError("width must be positive")
    power = 10.0 ** np.floor(np.log10(width_um * share))
    return float(min((m * power for m in (1, 2, 5, 10)), key=lambda v: abs(v - width_um * share)))

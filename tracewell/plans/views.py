"""The data behind the figures: traces with peaks, segment pages, overviews, region details and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import functions as O
from tracewell.operators import cluster as K
from tracewell.operators import events as E
from tracewell.operators import regions as R
from tracewell.operators import segments as G
from tracewell.sources import standins as S
from tracewell.sources.lineage import cut

from .imaging import BEST, PER_FRAME, PROPS, regions
from .parts import PEAKS, REC, SCORED, TR
from .registry import add
from .spikes import SAMPLES, peaks, spikes, windows

#: Milliseconds of a frame, as the figures' axes have it.
FRAME_MS = 50


def trace_with_peaks(spark, sf_dir):
    found = peaks(spark, sf_dir).select("series_id", F.col("pos").alias("sample"), F.lit(True).alias("is_peak"))
    return S.trace(spark, sf_dir).join(found, ["series_id", "sample"], "left").withColumn("is_peak", F.coalesce("is_peak", F.lit(False)))


add("view_trace_peaks", "series_id:l sample:l vm:4 is_peak:b", trace_with_peaks,
    "SELECT tr.*, pk.pos IS NOT NULL AS is_peak FROM tr LEFT JOIN pk ON pk.series_id = tr.series_id AND pk.pos = tr.sample", PEAKS)


def segment_pages(spark, sf_dir):
    """A row for each frame of each segment: its number, its first time, and the segment's range
    for display; image frames and trace frames of a segment must match."""
    found = cut(spikes(spark, sf_dir))
    taken = G.windows_of(found, S.recordings(spark, sf_dir))
    scores = cut(G.window_scores(taken, S.pixels(spark, sf_dir)))
    imaged = scores.select(*G.WINDOW, "rel").distinct().join(G.display_range(scores, "z", *G.WINDOW), list(G.WINDOW))
    samples = G.segment_samples(found, S.trace(spark, sf_dir), S.SAMPLES_PER_FRAME)
    shown = samples.groupBy("series_id", "spike_id", "rel").agg(F.min("t").alias("t_start"), F.count("*").alias("n_samples"))
    return shown.join(taken, ["series_id", "spike_id"]).join(imaged, [*G.WINDOW, "rel"])


add("view_segment_pages", "series_id:l spike_id:l rel:l t_start:3 n_samples:l p01:4 p99:4", segment_pages,
    f"""SELECT * FROM (SELECT series_id, spike_id, rel, min(t) AS t_start, count(*) AS n_samples FROM ({SAMPLES}) GROUP BY ALL)
        JOIN (SELECT DISTINCT series_id, spike_id, rel FROM zz) USING (series_id, spike_id, rel)
        JOIN (SELECT series_id, spike_id, quantile_cont(z, 0.01) AS p01, quantile_cont(z, 0.99) AS p99 FROM zz GROUP BY ALL) USING (series_id, spike_id)""", SCORED)


def overview(spark, sf_dir):
    """The frames around a spike with their place and limits in milliseconds, 0 at the spike's."""
    frames = windows(spark, sf_dir)[1].select("stack_id", "rel").distinct()
    half = F.max(F.abs(F.col("rel"))).over(R.Window.partitionBy("stack_id"))
    return frames.withColumns({"position": F.col("rel") + half, "start_ms": F.col("rel") * FRAME_MS, "end_ms": (F.col("rel") + 1) * FRAME_MS, "limit_ms": half * FRAME_MS})


add("view_overview", "stack_id:l rel:l position:l start_ms:l end_ms:l limit_ms:l", overview,
    f"SELECT *, rel + h AS position, rel * {FRAME_MS} AS start_ms, (rel + 1) * {FRAME_MS} AS end_ms, h * {FRAME_MS} AS limit_ms FROM (SELECT *, max(abs(rel)) OVER (PARTITION BY stack_id) AS h FROM (SELECT DISTINCT stack_id, rel FROM zz))", SCORED)


def region_detail(spark, sf_dir):
    """Centre of each frame's largest bright region and the ends of its half spans, in micrometres."""
    um = 1 / R.PIXELS_PER_UM["60X"]
    best = R.largest_region(regions(spark, sf_dir).where("category = 2"), S.pixels(spark, sf_dir)).where("label is not null")
    ends = {f"{axis}_{end}": (F.col(f"c{axis}") + sign * F.col(f"{axis}_span") / 2) * um for axis in "yx" for end, sign in (("from", -1), ("to", 1))}
    return best.withColumns({"cy_um": F.col("cy") * um, "cx_um": F.col("cx") * um, "area_um2": F.col("area") * um * um, **ends})


ENDS = "y_from:6 y_to:6 x_from:6 x_to:6"
add("view_region_detail", f"stack_id:l frame:l cy_um:6 cx_um:6 area_um2:6 {ENDS}", region_detail,
    f"""SELECT stack_id, frame, cy / 4.5::DOUBLE AS cy_um, cx / 4.5::DOUBLE AS cx_um, area / 20.25::DOUBLE AS area_um2,
        (cy - y_span / 2) / 4.5::DOUBLE AS y_from, (cy + y_span / 2) / 4.5::DOUBLE AS y_to, (cx - x_span / 2) / 4.5::DOUBLE AS x_from, (cx + x_span / 2) / 4.5::DOUBLE AS x_to
        FROM ({BEST}) WHERE label IS NOT NULL""", PROPS)


def area_table(spark, sf_dir):
    areas = K.cluster_areas(K.kmeans_labels(S.pixels(spark, sf_dir), R.FRAME), 3, "60X")
    return areas.withColumns({"area": F.format_string("%.2f", "area_um2"), "side": F.format_string("%.2f", F.sqrt("area_um2"))})


add("view_cluster_table", "stack_id:l frame:l cluster:l area:s side:s", area_table,
    "SELECT *, printf('%.2f', n / 20.25::DOUBLE) AS area, printf('%.2f', sqrt(n / 20.25::DOUBLE)) AS side FROM (SELECT stack_id, frame, j AS cluster, count(*) FILTER (cluster = j) AS n FROM kl, range(3) r(j) GROUP BY stack_id, frame, j)", PER_FRAME)


def optics(spark, sf_dir):
    """Resolution limits of made-up objectives: wavelengths in nanometres, apertures from 0.3 to 1.2."""
    given = S.read(spark, sf_dir, "part").select("p_partkey", (F.lit(400.0) + F.col("p_size") * 5).alias("nm"), (F.lit(0.3) + F.col("p_partkey") % 10 / 10).alias("na"))
    sigma = O.psf_sigma(F.col("nm"), F.col("na"))
    return given.withColumns({"sigma": sigma, "width": O.fwhm(sigma), "cutoff": O.cutoff_frequency(F.col("nm"), F.col("na"))})


add("optics_limits", "p_partkey:l sigma:6 width:6 cutoff:9", optics,
    "SELECT *, 0.21 * nm / na AS sigma, 2 * sqrt(2 * ln(2::DOUBLE)) * 0.21 * nm / na AS width, 2 * na / nm AS cutoff FROM (SELECT p_partkey, 400.0::DOUBLE + p_size * 5 AS nm, 0.3::DOUBLE + (p_partkey % 10) / 10.0::DOUBLE AS na FROM part)")


def frame_times(spark, sf_dir):
    """Frames lost at the start, where the trigger counted others than were stored, and the first frame's time."""
    rec = S.recordings(spark, sf_dir)
    lost = E.dropped_frames(F.col("n_frames"), F.col("n_frames") + F.col("series_id") % 3 - 1)
    return rec.withColumn("dropped", lost).withColumn("first_ms", O.frame_to_ms(F.col("dropped")))


add("frame_times", "series_id:l dropped:l first_ms:3", frame_times,
    "SELECT *, dropped * 50.0::DOUBLE AS first_ms FROM (SELECT series_id, CASE WHEN series_id % 3 = 1 THEN 0 ELSE 1 END AS dropped FROM rec)", TR + ", " + REC)

"""The whole batch: pending pairs to catalogue rows and stored results, as one distributed plan.

Picked pairs that the catalogue lacks meet their traces and stacks by key; all pairs are analysed
together, and a pair that cannot be (no trace, no stack, an unknown objective, no usable spike) gets
a row that says why, while the others go on. Results are put into the stored catalogue by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import catalog as C
from tracewell.operators import categorize as K
from tracewell.operators import events as E
from tracewell.operators import regions as R
from tracewell.operators import segments as G
from tracewell.sources import standins as S
from tracewell.sources.lineage import cut

from .parts import PEAKS, PX
from .registry import add

HALF = E.MOST_GAP


def spikes_of(trace: DataFrame, recordings: DataFrame, samples_per_frame: int, distance: int, prominence: float) -> DataFrame:
    found = E.find_peaks(trace, 0.0, distance, prominence)
    return E.isolate(E.gaps(E.spike_frames(found, samples_per_frame), recordings))


def median_stacks(spikes: DataFrame, recordings: DataFrame, px: DataFrame) -> DataFrame:
    """A stack of 2 * HALF + 1 aligned median frames per series, as pixel rows with value i and
    the series as stack_id."""
    windows = cut(G.windows_of(spikes, recordings))
    frames = G.series_medians(windows, G.window_scores(windows, px))
    return frames.select(F.col("series_id").alias("stack_id"), (F.col("rel") + HALF).cast("int").alias("frame"), "y", "x", F.round("median_z", 6).alias("i"))


def outcomes(recordings: DataFrame, spikes: DataFrame) -> DataFrame:
    """recordings with n_spikes_detected, n_spikes_analyzed and error: why a pair gives no result,
    null where it gives one."""
    counts = spikes.groupBy("series_id").agg(F.count("*").alias("n_spikes_detected"), F.count_if("picked").alias("n_spikes_analyzed"))
    found = recordings.join(counts, "series_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_spikes_detected", "n_spikes_analyzed")})
    error = (
        F.when(F.col("n_samples").isNull(), "no trace").when(F.col("n_frames").isNull(), "no stack")
        .when(F.col("objective").isNull() | ~F.col("objective").isin(*R.PIXELS_PER_UM), "unknown objective")
        .when(F.col("n_spikes_analyzed") == 0, "no spike with enough frames on both sides")
    )
    return found.withColumn("error", error)


def categorized(stacks: DataFrame, method: str = "morphological", threshold_method: str = "otsu_double", **options) -> DataFrame:
    return K.categorize(stacks, method, threshold_method, **options)


def measure(kinds: DataFrame, pairs: DataFrame, threshold_method: str = "otsu_double") -> DataFrame:
    """Catalogue rows of categorised stacks (stack_id is a pair's series_id), without spike counts:
    region counts, the largest bright region of every frame as JSON, and that of the spike's frame
    in columns of its own. Stored categories give the same rows again."""
    props = cut(R.region_props(R.label_categories(kinds.where("category > 0"), F.col("category"))))
    summary = R.region_summary(props, kinds)
    bright = props.where("category = 2")
    best = R.largest_region(bright, kinds).join(bright.select("stack_id", "frame", "label", "min_row", "min_col", "max_row", "max_col"), ["stack_id", "frame", "label"], "left")
    scaled = R.with_scale(pairs.select("series_id", *C.KEY, "objective", "slice", "at"))
    best = best.join(scaled.select(F.col("series_id").alias("stack_id"), "um_per_pixel"), "stack_id")
    um = F.col("um_per_pixel")
    region = F.when(F.col("label").isNotNull(), F.struct(
        F.array("cy", "cx").alias("centroid"), F.array("min_row", "min_col", "max_row", "max_col").cast("array<bigint>").alias("bbox"), F.col("label").cast("bigint").alias("label"),
        F.col("x_span").cast("double").alias("x_span_pixels"), F.col("y_span").cast("double").alias("y_span_pixels"),
        (F.col("x_span") * um).alias("x_span_um"), (F.col("y_span") * um).alias("y_span_um")))
    lists = best.groupBy("stack_id").agg(F.array_sort(F.collect_list(F.struct("frame", region.alias("r")))).alias("_f")).select("stack_id", F.transform("_f", lambda f: f.r).alias("_regions"))
    middle = C.spike_frame_region(F.col("_regions"))
    rows = summary.join(lists, "stack_id").join(scaled, F.col("stack_id") == F.col("series_id"))
    return rows.select(
        "series_id", *C.KEY, F.current_timestamp().alias("timestamp"), "objective", "um_per_pixel", F.lit(threshold_method).alias("threshold_method"),
        "n_frames", "total_dim_regions", "total_bright_regions", C.region_json(F.col("_regions"), F.col("objective"), um).alias("region_analysis"),
        F.format_string("%s/abf%s_img%s", *C.KEY).alias("data_dir"), "slice", "at", middle["centroid"][0].alias("centroid_y"), middle["centroid"][1].alias("centroid_x"),
        *(middle[c].alias(c) for c in ("x_span_pixels", "y_span_pixels", "x_span_um", "y_span_um")))


@dataclass
class Results:
    rows: DataFrame  # the catalogue's columns, a row for each pair with a result
    failed: DataFrame  # keys and error of the other pairs
    stacks: DataFrame  # aligned median z-scores; stack_id is the pair's series_id
    kinds: DataFrame  # their categories
    spikes: DataFrame
    recordings: DataFrame
    trace: DataFrame
    px: DataFrame


def run(pairs: DataFrame, traces: DataFrame, stacks: DataFrame, done: DataFrame, samples_per_frame: int, distance: int, prominence: float, threshold_method: str = "otsu_double", k: int = 3) -> Results:
    """Analyse the pairs (KEY, objective, slice, at) that are not done yet.

    Repeated pairs are analysed once. Traces carry exp_date and abf_serial, stacks exp_date and
    img_serial; pairs meet them by these.
    """
    todo = C.pending(pairs, done).dropDuplicates(list(C.KEY))
    recordings, trace, px = G.paired(todo, traces, stacks)
    recordings, trace = cut(recordings), cut(trace)
    usable = recordings.where("n_samples is not null and n_frames is not null")
    spikes = cut(spikes_of(trace, usable, samples_per_frame, distance, prominence))
    found = cut(outcomes(recordings, spikes))
    good = found.where("error is null")
    medians = cut(median_stacks(spikes.join(good.select("series_id"), "series_id", "left_semi"), good, px))
    kinds = cut(categorized(medians, "morphological", threshold_method, k=k))
    counts = good.select("series_id", "n_spikes_detected", "n_spikes_analyzed")
    names = [f.split()[0] for f in C.SCHEMA.split(", ")]
    rows = measure(kinds, good, threshold_method).join(counts, "series_id").select(*names)
    return Results(rows, found.where("error is not null").select(*C.KEY, "error"), medians, kinds, spikes, good, trace, px)


def export_all(results: Results, path: str, samples_per_frame: int) -> None:
    """Store a batch: z-scored stacks (as float), categories, image and trace segments, failures,
    and the rows, which replace stored ones of the same key while all others stay. Each batch's
    stacks and segments are files of their own beside earlier ones."""
    part = results.stacks.withColumn("i", F.col("i").cast("float"))
    segments = G.segment_pixels(results.spikes, results.recordings, results.px)
    samples = G.segment_samples(results.spikes.join(results.recordings.select("series_id"), "series_id", "left_semi"), results.trace, samples_per_frame)
    for rows, name in ((part, "zscore_stack"), (results.kinds, "categories"), (segments, "image_segments"), (samples, "trace_segments"), (results.failed, "failed")):
        rows.write.mode("append").parquet(f"{path}/{name}")
    C.store_results(results.rows, f"{path}/experiments")


def recompute(spark, path: str, pairs: DataFrame) -> DataFrame:
    """The region columns of pairs, from the categories that a batch stored."""
    numbered = pairs.withColumn("series_id", F.xxhash64(*C.KEY))
    kinds = spark.read.parquet(f"{path}/categories").join(numbered.select(F.col("series_id").alias("stack_id")), "stack_id", "left_semi").dropDuplicates(["stack_id", "frame", "y", "x"])
    return measure(kinds, numbered)


def stand_in(spark, sf_dir):
    """(pairs, traces, stacks, done) of the benchmark tables: a pair for each user and the stack
    that the user's number names; every fifth user is done already."""
    trace, px = S.trace(spark, sf_dir), S.pixels(spark, sf_dir)
    date = F.lit("2025_01_01").alias("exp_date")
    users = trace.select("series_id").distinct()
    pairs = users.select(date, C.serial(F.col("series_id")).alias("abf_serial"), C.serial(F.col("series_id") % 10).alias("img_serial"),
        F.when(F.col("series_id") % 7 == 3, "5X").otherwise("60X").alias("objective"), F.lit(None).cast("int").alias("slice"), F.lit(None).cast("string").alias("at"), "series_id")
    traces = trace.select(date, C.serial(F.col("series_id")).alias("abf_serial"), "sample", "t", "vm")
    stacks = px.where("stack_id <> 9").select(date, C.serial(F.col("stack_id")).alias("img_serial"), "frame", "y", "x", "i")
    return pairs.drop("series_id"), traces, stacks, pairs.where("series_id % 5 = 0").select(*C.KEY)


def batch(spark, sf_dir):
    return run(*stand_in(spark, sf_dir), S.SAMPLES_PER_FRAME, S.PEAK_DISTANCE, S.PEAK_PROMINENCE, k=1).rows


def batch_outcomes(spark, sf_dir):
    pairs, traces, stacks, done = stand_in(spark, sf_dir)
    recordings, trace, _ = G.paired(C.pending(pairs, done), traces, stacks)
    usable = recordings.where("n_samples is not null and n_frames is not null")
    return outcomes(recordings, spikes_of(trace, usable, S.SAMPLES_PER_FRAME, S.PEAK_DISTANCE, S.PEAK_PROMINENCE))


KEYS = "exp_date:s abf_serial:s img_serial:s"
add("batch_analysis", f"{KEYS} objective:s threshold_method:s data_dir:s n_spikes_detected:l n_spikes_analyzed:l n_frames:l total_dim_regions:l total_bright_regions:l region_analysis:s centroid_y:6 centroid_x:6 x_span_um:6 y_span_um:6", batch)
# Gaps count the frames of the paired stack.
OUTCOMES = PEAKS + ", " + PX + """, fr AS (SELECT stack_id, max(frame) + 1 AS n_frames FROM px WHERE stack_id <> 9 GROUP BY stack_id),
us AS (SELECT DISTINCT series_id FROM tr WHERE series_id % 5 <> 0),
ur AS (SELECT us.series_id, n_frames FROM us LEFT JOIN fr ON fr.stack_id = us.series_id % 10),
og AS (SELECT p.series_id, least(coalesce(f - lag(f) OVER w - 1, f - 1), coalesce(lead(f) OVER w - f - 1, n_frames - f - 1)) AS g
       FROM (SELECT *, pos // 2 AS f FROM pk) p JOIN ur USING (series_id) WHERE n_frames IS NOT NULL WINDOW w AS (PARTITION BY p.series_id ORDER BY p.pos)),
oc AS (SELECT series_id, count(*) AS nd, count(*) FILTER (g >= 3) AS na FROM og GROUP BY series_id)"""
add("batch_outcomes", f"{KEYS} n_spikes_detected:l n_spikes_analyzed:l error:s", batch_outcomes,
    """SELECT '2025_01_01' AS exp_date, lpad(series_id::VARCHAR, greatest(4, length(series_id::VARCHAR))::INT, '0') AS abf_serial, lpad((series_id % 10)::VARCHAR, 4, '0') AS img_serial,
       coalesce(nd, 0) AS n_spikes_detected, coalesce(na, 0) AS n_spikes_analyzed,
       CASE WHEN n_frames IS NULL THEN 'no stack' WHEN series_id % 7 = 3 THEN 'unknown objective' WHEN coalesce(na, 0) = 0 THEN 'no spike with enough frames on both sides' END AS error
       FROM ur LEFT JOIN oc USING (series_id)""", OUTCOMES)

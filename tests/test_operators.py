"""Operators against golden vectors and plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.operators import catalog, cluster, events, regions, segments, spatial, temporal, threshold


def frame(spark, a, stack=0, number=0, name="i"):
    a = np.asarray(a)
    rows = [(stack, number, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, f"stack_id int, frame int, y int, x int, {name} double")


def image(df, name):
    pdf = df.select("y", "x", name).toPandas()
    out = np.zeros((pdf.y.max() + 1, pdf.x.max() + 1), pdf[name].dtype)
    out[pdf.y, pdf.x] = pdf[name]
    return out


BLOB = np.array([[0.1, 0.2, 0.3, 0.2, 0.1], [0.2, 0.8, 1.2, 0.8, 0.2], [0.3, 1.2, 2.0, 1.2, 0.3], [0.2, 0.8, 1.2, 0.8, 0.2], [0.1, 0.2, 0.3, 0.2, 0.1]])


def test_otsu_sweep_takes_the_first_of_tied_thresholds(spark):
    values = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 3, 3, 7, 8, 8, 9, 9)], "v double")
    best = threshold.sweep(values, "otsu").toPandas().round(9).sort_values(["score", "t"], ascending=[False, True]).iloc[0]
    assert (best.t, best.score) == (3, 9.0)


def test_median_and_mean_of_one_pixel(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0, v) for v in (2.0, 2.1, 15.0, 1.9, 2.0)], "stack_id int, rel int, y int, x int, z double")
    assert segments.aligned_median(rows).first().median_z == 2.0
    assert segments.aligned_mean(rows).first().mean_z == pytest.approx(4.6)


def test_connected_makes_the_whole_blob_dim(spark):
    out = image(regions.categorize_connected(frame(spark, BLOB), F.lit(0.5), F.lit(1.5), 1), "category")
    expected = np.zeros((5, 5), int)
    expected[1:4, 1:4] = 1
    assert (out == expected).all()


def brute_square(mask, k, shrink):
    h, w = mask.shape
    out = np.zeros_like(mask)
    for y in range(h):
        for x in range(w):
            box = mask[max(0, y - k) : y + k + 1, max(0, x - k) : x + k + 1]
            out[y, x] = (box.size == (2 * k + 1) ** 2 and box.all()) if shrink else box.any()
    return out


@pytest.mark.parametrize("k", [1, 3])
def test_morphology_matches_squares(spark, k):
    mask = (np.random.default_rng(k).random((20, 17)) < 0.85).astype(int)
    df = frame(spark, mask).withColumn("m", F.col("i").cast("int"))
    small, big = image(spatial.erode(df, "m", k), "eroded"), image(spatial.dilate(df, "m", k), "dilated")
    assert (small == brute_square(mask, k, True)).all() and (big == brute_square(mask, k, False)).all()
    assert (small <= mask).all() and (mask <= big).all()


def test_kernel_and_blur(spark):
    assert len(spatial.gaussian_kernel(6)) == 37 and sum(spatial.gaussian_kernel(6)) == pytest.approx(1)
    a = np.random.default_rng(0).random((9, 11))
    k = np.array(spatial.gaussian_kernel(1))
    for border in ("renorm", "clamp"):
        b = a
        for axis in (0, 1):
            wide = np.pad(b, [(3, 3) if d == axis else (0, 0) for d in (0, 1)], "edge" if border == "clamp" else "constant")
            ones = np.pad(np.ones_like(b), [(3, 3) if d == axis else (0, 0) for d in (0, 1)], "edge" if border == "clamp" else "constant")
            conv = lambda v: sum(w * np.take(v, np.arange(d, d + b.shape[axis]), axis) for d, w in enumerate(k))
            b = conv(wide) / conv(ones)
        assert np.allclose(image(spatial.gaussian_blur(frame(spark, a), 1.0, border=border), "blurred"), b)
    with pytest.raises(ValueError):
        spatial.gaussian_blur(frame(spark, a), 1.0, border="wrap")


def test_detrend_windows_are_half_open(spark):
    v = np.random.default_rng(1).random(40)
    df = spark.createDataFrame([(0, k, 0, 0, float(x)) for k, x in enumerate(v)], "stack_id int, frame int, y int, x int, i double")
    m = np.array([v[max(0, k - 5) : k + 5].mean() for k in range(40)])
    got = temporal.detrend(df, 11).orderBy("frame").toPandas().detrended
    assert np.allclose(got, v - (m - min(m[0], m[-1])))


def test_binning_leaves_remainders_at_zero(spark):
    a = np.arange(35.0).reshape(5, 7)
    out = image(spatial.roi_binning(frame(spark, a), 2), "binned")
    assert out[4].sum() == 0 and out[:, 6].sum() == 0 and out[0, 0] == a[:2, :2].mean()


@pytest.mark.parametrize("connectivity", [4, 8])
def test_labels_match_a_flood(spark, connectivity):
    mask = np.random.default_rng(connectivity).random((2, 24, 24)) < 0.55
    got = regions.label_array(mask, connectivity)
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    for k in range(2):
        want, n = np.zeros((24, 24), int), 0
        for y, x in np.argwhere(mask[k]):
            if not want[y, x]:
                n += 1
                todo = [(y, x)]
                want[y, x] = n
                while todo:
                    a, b = todo.pop()
                    for dy, dx in near:
                        c, d = a + dy, b + dx
                        if 0 <= c < 24 and 0 <= d < 24 and mask[k, c, d] and not want[c, d]:
                            want[c, d] = n
                            todo.append((c, d))
        assert (got[k] == want).all()


def test_region_measures_and_ties(spark):
    a = np.zeros((6, 8), int)
    a[1:3, 1:3] = 1
    a[4:6, 5:7] = 1
    labelled = regions.label_components(frame(spark, a), F.col("i") > 0, 8).withColumn("category", F.lit(1))
    props = regions.region_props(labelled)
    one = props.where("label = 1").first()
    assert (one.area, one.cy, one.cx, one.min_row, one.max_row, one.x_span, one.y_span) == (4, 1.5, 1.5, 1, 3, 1, 1)
    assert regions.largest_region(props, labelled).first().label == 1
    empty = regions.largest_region(props.where("false"), labelled).first()
    assert empty.label is None


def test_contours_close_and_show_holes(spark):
    ring = np.ones((5, 5), int)
    ring[2, 2] = 0
    lines = regions.trace_contours(np.pad(ring, 2))
    assert len(lines) == 2 and all(line[0] == line[-1] for line in lines)
    assert len(regions.trace_contours(np.array([[1, 1], [0, 0]]))[0]) == 2


def plain_peaks(v, distance):
    top, k = [], 1
    while k < len(v) - 1:
        j = k
        while j + 1 < len(v) and v[j + 1] == v[k]:
            j += 1
        if v[k - 1] < v[k] and j + 1 < len(v) and v[j + 1] < v[k]:
            top.append((k + j) // 2)
        k = j + 1
    kept = []
    for p in sorted(top, key=lambda p: (-v[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = {}
    for p in kept:
        left = next((k for k in range(p, -1, -1) if v[k] > v[p]), -1)
        right = next((k for k in range(p, len(v)) if v[k] > v[p]), len(v))
        out[p] = v[p] - max(min(v[left + 1 : p + 1]), min(v[p:right]))
    return out


def test_peaks_match_plain_python(spark):
    rng = np.random.default_rng(5)
    traces = {s: rng.integers(0, 12, 150).astype(float) for s in range(4)}
    df = spark.createDataFrame([(s, k, k / 10, float(x)) for s, v in traces.items() for k, x in enumerate(v)], "series_id long, sample long, t double, vm double")
    got = events.with_prominence(events.separate(events.local_maxima(df), 6), df).toPandas()
    for s, v in traces.items():
        mine = got[got.series_id == s]
        assert dict(zip(mine.pos, mine.prominence, strict=True)) == plain_peaks(v.tolist(), 6)


def test_gate_is_empty_without_a_rise(spark):
    df = spark.createDataFrame([(1, k, 0.0, v, v) for k, v in enumerate([0.0, 3.0, 1.0, 0.9, 0.1])] + [(2, 0, 0.0, 1.0, 1.0)], "series_id long, sample long, t double, vm double, gate double")
    bounds = {r.series_id: (r.start, r.stop) for r in events.gate_bounds(df).collect()}
    assert bounds == {1: (1, 4), 2: (None, 1)}
    assert events.within_gate(df, events.gate_bounds(df)).where("series_id = 2").count() == 0


def test_isolation_keeps_the_leading_gap_rule(spark):
    spikes = spark.createDataFrame([(1, 4.0, 4), (1, 11.0, 11), (1, 13.0, 13), (1, 20.0, 20)], "series_id long, pos double, frame long")
    rec = spark.createDataFrame([(1, 26)], "series_id long, n_frames long")
    got = events.isolate(events.gaps(spikes, rec)).orderBy("pos").toPandas()
    assert got.left_gap.tolist() == [3, 6, 1, 6] and got.right_gap.tolist() == [6, 1, 6, 5]
    assert got.picked.tolist() == [True, False, False, True] and got.interval.dropna().tolist() == [3, 4]


def test_zscore_of_a_flat_baseline(spark):
    df = spark.createDataFrame([(1, 0, 0, r, 0, 0, float(5 + (r >= 0))) for r in range(-3, 4)], "series_id long, spike_id long, stack_id int, rel long, y int, x int, i double")
    assert segments.zscore(df).orderBy("rel").toPandas().z.tolist() == [0, 0, 0, 1, 1, 1, 1]


def test_thresholds_of_flat_and_two_valued_stacks(spark):
    flat = frame(spark, np.full((4, 4), 7.0))
    assert threshold.otsu_double(flat, "i").first()[1:] == (7.0, 7.0)
    assert threshold.li_double(flat, "i").first()[1:] == (7.0, 7.0)
    two = frame(spark, np.array([[0.0] * 8, [10.0] * 8]))
    assert 0 < threshold.otsu(two, "i").first().threshold < 10
    assert 0 < threshold.li(two, "i").first().threshold < 10
    with pytest.raises(ValueError):
        threshold.thresholds(two, "none")
    with pytest.raises(ValueError):
        threshold.manual(two, 1.0, None)


def test_frame_kernels():
    a = np.zeros((30, 40))
    a[5:12, 5:12] = 6
    a[18:25, 25:32] = 1
    shed = cluster.watershed_frame(a, 0.3, 1.5, 5, 20)  # blurred rims pull the means down
    assert shed[8, 8] == 2 and shed[21, 28] == 1 and shed[0, 0] == 0
    dense = cluster.dbscan_frame(a, 0.5, 3.0, 10, 10.0)
    assert set(np.unique(dense)) == {0, 1, 2} and dense[8, 8] == 1
    grown = cluster.grow_frame(a, 2.0, 0.5, 0.5)
    assert (grown > 0).sum() == 49
    d = cluster._distance(np.pad(np.ones((5, 5), bool), 1))
    assert d[3, 3] == 3 and d[1, 1] == 1 and d[0, 0] == 0


def test_kmeans_orders_by_intensity(spark):
    a = np.array([[1, 1, 2, 50, 51, 99, 98, 100]], float)
    got = image(cluster.kmeans_labels(frame(spark, a), regions.FRAME), "cluster")
    assert got.tolist() == [[0, 0, 0, 1, 1, 2, 2, 2]]
    areas = cluster.cluster_areas(cluster.kmeans_labels(frame(spark, a), regions.FRAME), 4, "10X").orderBy("cluster").toPandas()
    assert areas.n.tolist() == [3, 2, 3, 0]


def test_concatenate_and_split_return_the_frames(spark):
    df = frame(spark, np.arange(12.0).reshape(3, 4), number=2)
    back = cluster.split_frames(cluster.concatenate_frames(df, 4), 4)
    assert sorted(map(tuple, back.select("frame", "y", "x", "i").collect())) == sorted(map(tuple, df.select("frame", "y", "x", "i").collect()))


def test_sheets(spark):
    sheet = spark.createDataFrame(
        [("2025_01_01-0012.tif", "23", "60X", "x", 1), ("2025_01_01-0013.tif", "0024", "60X", None, 1), ("nodash.tif", "25", "10X", "x", 1), ("", "26", "10X", "x", 1), ("2025_01_01-0014.tif", "0", "10X", "x", 1)],
        "Filename string, ABF_SERIAL string, OBJ string, PICK string, SLICE int")
    got = catalog.sheet_pairs(sheet, "2025_01_01").collect()
    assert [(r.abf_serial, r.img_serial, r.slice, r["at"]) for r in got] == [("0023", "0012", 1, None)]
    assert catalog.sheet_pairs(sheet.drop("PICK"), "2025_01_01") is None


def test_upsert_delete_and_missing_catalogue(spark, tmp_path):
    schema = "exp_date string, abf_serial string, img_serial string, n long"
    assert catalog.read_catalogue(spark, str(tmp_path / "none"), schema).count() == 0
    old = spark.createDataFrame([("d", "1", "1", 1), ("d", "2", "2", 1)], schema)
    new = spark.createDataFrame([("d", "2", "2", 9), ("d", "3", "3", 9)], schema)
    merged = catalog.upsert(old, new)
    assert sorted(r.n for r in merged.collect()) == [1, 9, 9]
    catalog.write_catalogue(merged, str(tmp_path / "c"))
    assert catalog.delete(catalog.read_catalogue(spark, str(tmp_path / "c"), schema), new).count() == 1
    catalog.write_csv(merged, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    assert catalog.pending(new, old).count() == 1


def test_scale_lookup_rejects_unknown_objectives(spark):
    good = regions.with_scale(spark.createDataFrame([("60X",)], "objective string")).first()
    assert good.um_per_pixel == pytest.approx(0.2222, abs=1e-4)
    with pytest.raises(Exception, match="unknown objective"):
        regions.with_scale(spark.createDataFrame([("5X",)], "objective string")).collect()
    assert regions.scale_bar(1000) == 200 and regions.scale_bar(30) == 5


def test_stack_round_trip(spark):
    from tracewell.sources import files

    px = frame(spark, np.arange(6.0).reshape(2, 3)).withColumn("stack_id", F.lit("a")).withColumn("i", F.col("i").cast("int"))
    frames = files.pixels_to_frames(px)
    assert frames.first().pixels == list(range(6))
    assert sorted(map(tuple, files.frames_to_pixels(frames).collect())) == sorted(map(tuple, px.collect()))


def test_streams(spark, tmp_path):
    from tracewell.streaming.triggered import running_catalogue, windowed_counts

    schema = "exp_date string, abf_serial string, img_serial string, recorded timestamp, n int"
    for k in range(2):
        rows = pd.DataFrame({"exp_date": "d", "abf_serial": "1", "img_serial": ["1", str(k + 2)], "recorded": pd.Timestamp(2025, 1, k + 1), "n": k})
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running_catalogue(stream, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.img_serial, r.n) for r in spark.read.parquet(str(tmp_path / "out" / "v00000001")).collect()} == {("1", 1), ("2", 0), ("3", 1)}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()

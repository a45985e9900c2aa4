"""The batch end to end, categorisers by name, streamed frames and trace kernels against plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.operators import catalog as C
from tracewell.operators import categorize as K
from tracewell.operators import cluster, events, frames, regions, segments, spatial, stored, temporal, threshold
from tracewell.plans import batch
from tracewell.sources import files
from tracewell.sources import standins as S

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def first(spark):
    return batch.run(*batch.stand_in(spark, DATA), S.SAMPLES_PER_FRAME, S.PEAK_DISTANCE, S.PEAK_PROMINENCE, k=1)


def test_two_batches_keep_each_others_rows(spark, first, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = first.rows.collect()
    assert rows and set(first.rows.columns) == {f.split()[0] for f in C.SCHEMA.split(", ")}
    half = [r.abf_serial for r in rows][: len(rows) // 2 or 1]
    pairs, traces, stacks, _ = batch.stand_in(spark, DATA)
    args = (S.SAMPLES_PER_FRAME, S.PEAK_DISTANCE, S.PEAK_PROMINENCE)
    one = batch.run(pairs.where(F.col("abf_serial").isin(half)), traces, stacks, C.read_catalogue(spark, f"{path}/experiments"), *args, k=1)
    batch.export_all(one, path, S.SAMPLES_PER_FRAME)
    stored = C.read_catalogue(spark, f"{path}/experiments")
    assert {r.abf_serial for r in stored.collect()} == set(half)
    two = batch.run(pairs.where(F.col("abf_serial").isin([r.abf_serial for r in rows])), traces, stacks, stored, *args, k=1)
    batch.export_all(two, path, S.SAMPLES_PER_FRAME)
    key = lambda r: (r.abf_serial, r.total_bright_regions, r.region_analysis, r.n_spikes_analyzed)
    assert sorted(map(key, C.read_catalogue(spark, f"{path}/experiments").collect())) == sorted(map(key, rows))
    again = batch.recompute(spark, path, pairs.where(F.col("abf_serial").isin(half)))
    assert {r.abf_serial: r.region_analysis for r in again.collect()} == {r.abf_serial: r.region_analysis for r in rows if r.abf_serial in half}
    assert spark.read.parquet(f"{path}/trace_segments").count() and spark.read.parquet(f"{path}/image_segments").count()


def test_failures_are_rows_of_their_own(spark, first):
    errors = {r.error for r in first.failed.collect()}
    assert {"no stack", "unknown objective"} <= errors
    pairs, traces, stacks, done = batch.stand_in(spark, DATA)
    alone = batch.run(pairs.limit(1).withColumn("abf_serial", F.lit("9999")), traces, stacks, done, 2, 8, 10.0)
    assert alone.rows.count() == 0 and [r.error for r in alone.failed.collect()] == ["no trace"]
    assert batch.run(pairs.where("false"), traces, stacks, done, 2, 8, 10.0).rows.count() == 0


def test_catalogue_is_created_once(spark, tmp_path):
    path = f"file://{tmp_path}/cat"
    for _ in range(2):
        C.create_catalogue(spark, path)
    assert C.read_catalogue(spark, path).count() == 0 and C._versions(spark, path) == [1]


def test_only_keys_in_all_outputs_are_done(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "stack_id string")
    assert [r.stack_id for r in C.not_stored(keys, keys.where("stack_id < 'c'"), keys.where("stack_id > 'a'")).orderBy("stack_id").collect()] == ["a", "c"]


def test_zip_is_strict(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "series_id long, spike_id long, l string")
    assert segments.zip_strict(a, a.withColumnRenamed("l", "r")).count() == 2
    with pytest.raises(Exception, match="no partner for 1, 1"):
        segments.zip_strict(a, a.where("spike_id = 0").withColumnRenamed("l", "r")).collect()


def test_sheets_are_read_and_odd_ones_reported(spark, tmp_path):
    head = "Filename,ABF,OBJ,PICK,SLICE\n"
    (tmp_path / "REC_2025_01_02.csv").write_text(head + "2025_01_02-12.tif,7,10X,x,3\n2025_01_02-13.tif,8,10X,,3\n")
    (tmp_path / "REC_2025_02_03.csv").write_text(head.replace("ABF", "ABF_NUMBER") + "2025_02_03-1.tif,9,40X,x,\n")
    (tmp_path / "REC_2025_03_04.csv").write_text("Filename,OBJ\nx,y\n")
    (tmp_path / "REC_undated.csv").write_text(head)
    found, skipped = files.read_sheets(spark, f"file://{tmp_path}")
    assert sorted((r.exp_date, r.abf_serial, r.img_serial) for r in found.collect()) == [("2025_01_02", "0007", "0012"), ("2025_02_03", "0009", "0001")]
    assert len(skipped) == 2


# -- frames


def stack(spark, n, side, seed=0):
    rng = np.random.default_rng(seed)
    f, y, x = (a.ravel() for a in np.mgrid[:n, :side, :side])
    pdf = pd.DataFrame({"stack_id": 1, "frame": f, "y": y, "x": x, "i": rng.integers(0, 65536, len(f))})
    return spark.createDataFrame(pdf.sample(frac=1, random_state=1), "stack_id int, frame int, y int, x int, i int"), pdf


def test_blocks_hold_whole_frames_within_the_bound():
    pdf = pd.DataFrame({"stack_id": 1, "frame": np.repeat(np.arange(40), 128 * 128)})
    batches = [pdf.iloc[k : k + 10_000] for k in range(0, len(pdf), 10_000)]
    blocks = list(frames.whole_frames(iter(batches), frames.FRAME))
    assert sum(map(len, blocks)) == len(pdf) and max(map(len, blocks)) < frames.BLOCK_PIXELS + 128 * 128
    assert all((b.groupby("_f").size() == 128 * 128).all() for b in blocks)
    large = pd.DataFrame({"stack_id": 1, "frame": np.repeat(np.arange(3), 1024 * 1024)})  # full-size frames go alone
    batches = [large.iloc[k : k + 200_000] for k in range(0, len(large), 200_000)]
    assert [len(b) for b in frames.whole_frames(iter(batches), frames.FRAME)] == [1024 * 1024] * 3


def test_preprocessing_matches_plain_numpy(spark):
    px, pdf = stack(spark, 12, 6)
    a = pdf["i"].to_numpy().reshape(12, 6, 6).astype(float)
    half, out = 2, np.empty_like(a)
    mean = np.stack([a[max(0, k - half) : k + half].mean(0) for k in range(12)])
    out = a - (mean - np.minimum(mean[0], mean[-1]))
    out -= out.mean(0) - out.mean(0).min()
    taps = spatial.gaussian_kernel(1.0)
    smooth = np.zeros_like(out)
    for k in range(12):
        for y in range(6):
            for x in range(6):
                near = lambda line, c: sum(taps[d + 3] * line[c + d] for d in range(-3, 4) if 0 <= c + d < 6) / sum(taps[d + 3] for d in range(-3, 4) if 0 <= c + d < 6)
                smooth[k, y, x] = near([near(out[k, r], x) for r in range(6)], y)
    got = temporal.preprocess(px, 4, 1.0).orderBy("frame", "y", "x").toPandas()
    for name, want in (("calibrated", out), ("smoothed", smooth)):
        assert np.abs(got[name].to_numpy() - np.trunc(np.clip(want, 0, 65535)).ravel()).max() <= 1


def test_categorisers_by_name(spark):
    px, _ = stack(spark, 2, 12)
    for method in K.METHODS:
        got = K.categorize(px, method, **({"k": 1} if method == "morphological" else {"min_size": 2}))
        assert got.count() == 2 * 144 and {r.category for r in got.select("category").distinct().collect()} <= {0, 1, 2}
    stats = K.category_statistics(K.categorize(px, "connected", "manual", dim=1000.0, bright=60_000.0, min_size=1)).collect()
    assert all(s.n == 144 == s.background + s.dim + s.bright for s in stats)
    for name in ("otsu", "li"):
        assert threshold.thresholds(px, name).where("dim = bright").count() == 1
    for wrong in ({"method": "none"}, {"threshold_method": "none"}, {"threshold_method": "manual"}, {"kk": 1}, {"k": -1}):
        with pytest.raises(ValueError):
            K.categorize(px, **wrong)


def test_multi_otsu_matches_all_pairs_of_bins(spark):
    px, pdf = stack(spark, 1, 9)
    v = pdf["i"].to_numpy().astype(float)
    lo, hi = v.min(), v.max()
    b = np.minimum(255, np.floor((v - lo) * 256 / (hi - lo))).astype(int)
    best = None
    for i in range(255):
        for j in range(i + 1, 255):
            parts = [b[b <= i], b[(b > i) & (b <= j)], b[b > j]]
            if all(map(len, parts)) and i in b and j in b:
                score = round(sum(float(p.sum()) ** 2 / len(p) for p in parts), 3)
                if best is None or score > best[0]:
                    best = score, i, j
    got = threshold.multi_otsu(px, "i").first()
    assert np.allclose([got.dim, got.bright], [lo + (k + 0.5) * (hi - lo) / 256 for k in best[1:]])


@pytest.mark.parametrize("seed", range(5))
def test_prominence_and_distance_match_plain_loops(spark, seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 12, 120).astype(float)
    trace = spark.createDataFrame([(1, k, x) for k, x in enumerate(v.tolist())], "series_id long, sample long, vm double")
    got = events.with_prominence(events.local_maxima(trace), trace).orderBy("pos").collect()
    for r in got:
        lb = max((k for k in range(r.pos) if v[k] > r.h), default=-1)
        rb = min((k for k in range(r.pos + 1, len(v)) if v[k] > r.h), default=len(v))
        assert r.prominence == r.h - max(v[lb + 1 : r.pos + 1].min(), v[r.pos : rb].min())
    kept = []
    for r in sorted(got, key=lambda r: (-r.h, -r.pos)):
        if all(abs(r.pos - k) >= 7 for k in kept):
            kept.append(r.pos)
    strong = {r.pos for r in got if r.pos in kept and r.prominence >= 4}
    assert {r.pos for r in events.find_peaks(trace, 0.0, 7, 4.0).collect()} == strong


def test_density_clusters_and_noise_match_plain_loops(spark):
    rng = np.random.default_rng(3)
    a = rng.random((9, 9)) * 2
    rows = [(1, 0, y, x, float(a[y, x]), 0.5, 1.5) for y in range(9) for x in range(9)]
    px = spark.createDataFrame(rows, "stack_id long, frame int, y int, x int, v double, dim double, bright double")
    points = [(y, x, 2.0 * a[y, x]) for y in range(9) for x in range(9) if a[y, x] > 0.5]
    near = [[j for j, q in enumerate(points) if sum((c - d) ** 2 for c, d in zip(p, q)) <= 1.5**2] for p in points]
    core = [len(n) >= 5 for n in near]
    seen, clusters = set(), 0
    for k in range(len(points)):
        if core[k] and k not in seen:
            clusters, todo = clusters + 1, [k]
            while todo:
                i = todo.pop()
                if i not in seen:
                    seen.add(i)
                    todo += near[i] if core[i] else []
    got = cluster.dbscan_noise(px, cluster.dbscan_labels(px, 1.5, 5, 2.0, "v"), "v").first()
    assert (got.n_clusters, got.n_noise) == (clusters, len(points) - len(seen))


def test_labels_of_all_categories_in_one_pass(spark):
    px, _ = stack(spark, 3, 10)
    kinds = px.withColumn("category", (F.col("i") % 3).cast("int"))
    both = regions.label_categories(kinds, F.col("category")).select("frame", "y", "x", "category", "label")
    for c in (1, 2):
        one = regions.label_components(px.withColumn("c", F.col("i") % 3), F.col("c") == c, 8).where("label > 0").select("frame", "y", "x", F.lit(c).alias("category"), "label")
        assert sorted(map(tuple, both.where(f"category = {c}").collect())) == sorted(map(tuple, one.collect()))


def test_stored_frames_give_what_pixel_rows_give(spark, monkeypatch):
    px, _ = stack(spark, 7, 10)
    monkeypatch.setattr(stored, "BAND_VALUES", 7 * 10 * 3)  # bands of three rows, the last of one
    whole = files.pixels_to_frames(px)
    got = stored.preprocess(whole, 4, 1.0)
    want = temporal.preprocess(px, 4, 1.0)
    for name in ("calibrated", "smoothed"):
        flat = files.frames_to_pixels(got.select("stack_id", "frame", "w", F.col(name).alias("pixels")))
        assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, want.select("stack_id", "frame", "y", "x", name).collect()))
    kinds = stored.categorize(whole.withColumns({"dim": F.lit(20_000.0), "bright": F.lit(45_000.0)}), 1)
    flat = files.frames_to_pixels(kinds.select("stack_id", "frame", "w", "pixels"))
    plain = spatial.categorize_morphological(px, F.lit(20_000.0), F.lit(45_000.0), 1).select("stack_id", "frame", "y", "x", "category")
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, plain.collect()))
    labels = files.frames_to_pixels(stored.label(kinds, 2).select("stack_id", "frame", "w", "pixels"))
    one = regions.label_components(plain, F.col("category") == 2, 8).select("stack_id", "frame", "y", "x", "label")
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, one.collect()))

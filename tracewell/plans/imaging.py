"""Queries over image stacks: preprocessing, thresholds, morphology, regions, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import cluster as K
from tracewell.operators import regions as R
from tracewell.operators import spatial as P
from tracewell.operators import stored as D
from tracewell.operators import temporal as T
from tracewell.operators import threshold as H
from tracewell.sources import standins as S
from tracewell.sources.files import frames_to_pixels, pixels_to_frames

from .parts import PX, blur, labels, morph, otsu, otsu_double
from .registry import add



def preprocessed(spark, sf_dir):
    return T.preprocess(S.pixels(spark, sf_dir), 10, 1.0)


XY = "stack_id:l frame:l y:l x:l"
MASK = "i > 32767"

add("pixel_stack_scan", f"{XY} i:l", S.pixels, "SELECT * FROM px", PX)
add("clip_uint16", f"{XY} clipped:l", lambda s, d: S.pixels(s, d).withColumn("clipped", T.clip_uint16((F.col("i") - 20000) * 3.7)),
    "SELECT *, trunc(least(greatest((i - 20000) * 3.7::DOUBLE, 0), 65535)) AS clipped FROM px", PX)
DETREND = """SELECT *, i - (m - least(first_value(m) OVER w, last_value(m) OVER w)) AS detrended
  FROM (SELECT *, avg(i) OVER (PARTITION BY stack_id, y, x ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS m FROM px)
  WINDOW w AS (PARTITION BY stack_id, y, x ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
add("detrend_moving_avg", f"{XY} detrended:6", lambda s, d: T.detrend(S.pixels(s, d), 10), DETREND, PX)
add("detrend_mean_to_min", f"{XY} aligned:6", lambda s, d: T.mean_to_min(S.pixels(s, d)),
    "SELECT px.*, i - (m - low) AS aligned FROM px JOIN mp USING (stack_id, y, x) JOIN (SELECT stack_id, min(m) AS low FROM mp GROUP BY stack_id) USING (stack_id)",
    PX + ", mp AS (SELECT stack_id, y, x, avg(i) AS m FROM px GROUP BY stack_id, y, x)")


def kernel(spark, _):
    weights = P.gaussian_kernel(6.0)
    return spark.createDataFrame([(k - len(weights) // 2, w) for k, w in enumerate(weights)], "k long, w double")


add("gauss_kernel", "k:l w:9", kernel,
    "SELECT k, exp(-(k * k) / 72.0::DOUBLE) / (SELECT sum(exp(-(j * j) / 72.0::DOUBLE)) FROM range(-18, 19) r(j)) AS w FROM range(-18, 19) t(k)")
add("gauss_blur_renorm", f"{XY} blurred:6", lambda s, d: P.gaussian_blur(S.pixels(s, d), 1.0), "SELECT *, bv_v AS blurred FROM bv", blur("renorm"))
add("gauss_blur_clamp", f"{XY} blurred:6", lambda s, d: P.gaussian_blur(S.pixels(s, d), 1.0, border="clamp"), "SELECT *, bv_v AS blurred FROM bv", blur("clamp"))
add("roi_binning", f"{XY} binned:6", lambda s, d: P.roi_binning(S.pixels(s, d), 3),
    "SELECT *, CASE WHEN y < 6 AND x < 6 THEN avg(i) OVER (PARTITION BY stack_id, frame, y // 3, x // 3) ELSE 0 END AS binned FROM px", PX)
ALIGNED = PX + f""", dt AS (SELECT * EXCLUDE (m) FROM ({DETREND})),
al AS (SELECT stack_id, frame, y, x, round(detrended - (m - min(m) OVER (PARTITION BY stack_id)), 6) AS v
       FROM (SELECT *, avg(detrended) OVER (PARTITION BY stack_id, y, x) AS m FROM dt))"""
STORED = "trunc(least(greatest(round({}, 3), 0), 65535))"
add("preprocess_calibrated", f"{XY} stored:l", lambda s, d: preprocessed(s, d).select("stack_id", "frame", "y", "x", F.col("calibrated").alias("stored")),
    f"SELECT *, {STORED.format('v')} AS stored FROM al", ALIGNED)
SMOOTHED = f"SELECT *, {STORED.format('bv_v')} AS stored FROM bv", blur("renorm").replace(PX, ALIGNED).replace("b0 AS (SELECT *, i::DOUBLE AS v FROM px)", "b0 AS (SELECT * FROM al)")
add("preprocess_stack", f"{XY} stored:l", lambda s, d: preprocessed(s, d).select("stack_id", "frame", "y", "x", F.col("smoothed").alias("stored")), *SMOOTHED)



def stored_pixels(spark, sf_dir):
    """The smoothed stacks by the kernels on stored frames, as pixel rows again."""
    frames = D.preprocess(pixels_to_frames(S.pixels(spark, sf_dir)), 10, 1.0)
    return frames_to_pixels(frames.select("stack_id", "frame", "w", F.col("smoothed").alias("pixels"))).withColumnRenamed("i", "stored")


add("preprocess_stored", f"{XY} stored:l", stored_pixels, *SMOOTHED)

# -- thresholds

add("otsu", "stack_id:l threshold:6", lambda s, d: H.otsu(S.pixels(s, d), "i"), "SELECT stack_id, t AS threshold FROM t", PX + ", " + otsu("px", "i", "t"))
add("otsu_double", "stack_id:l dim:6 bright:6", lambda s, d: H.otsu_double(S.pixels(s, d), "i"), "SELECT * FROM th", PX + ", " + otsu_double("px", "i"))
M = otsu("px", "i", "t", 256)
MULTI = M[: M.index("t AS (\n")] + """best AS (
  SELECT a.stack_id, a.lo, a.hi, a.bin AS b1, b.bin AS b2, row_number() OVER (PARTITION BY a.stack_id ORDER BY round(
      a.s0 * a.s0 / a.n0 + (b.s0 - a.s0) * (b.s0 - a.s0) / (b.n0 - a.n0) + (a.st - b.s0) * (a.st - b.s0) / (a.nt - b.n0), 3) DESC, a.bin, b.bin) AS k
  FROM t_c a JOIN t_c b ON a.stack_id = b.stack_id AND a.bin < b.bin AND b.n0 < b.nt)"""
add("multiotsu", "stack_id:l dim:6 bright:6", lambda s, d: H.multi_otsu(S.pixels(s, d), "i"),
    "SELECT stack_id, lo + (b1 + 0.5) * (hi - lo) / 256 AS dim, lo + (b2 + 0.5) * (hi - lo) / 256 AS bright FROM best WHERE k = 1", PX + ", " + MULTI)


def li_sql(source: str, name: str) -> str:
    low = "list_sum(list_transform(list_filter(h, lambda e: e.v <= t), lambda e: e.n * {}))"
    high = "list_sum(list_transform(list_filter(h, lambda e: e.v > t), lambda e: e.n * {}))"
    ml, mh = (f"({x.format('(e.v - lo)')} / {x.format('1.0::DOUBLE')})" for x in (low, high))
    step = f"coalesce(lo + ({ml} - {mh}) / (ln(nullif({ml}, 0)) - ln(nullif({mh}, 0))), t)"
    rounds = ", ".join(["s0 AS (SELECT *, m AS t FROM l)"]).replace("s0", f"{name}_0").replace("FROM l", f"FROM {name}_l")
    chain = ", ".join(f"{name}_{k} AS MATERIALIZED (SELECT stack_id, h, lo, {step} AS t FROM {name}_{k - 1})" for k in range(1, 31))
    return f"""{name}_l AS (SELECT stack_id, list({{'v': v, 'n': n}} ORDER BY v) AS h, min(v) AS lo, sum(v * n) / sum(n) AS m
  FROM (SELECT stack_id, i::DOUBLE AS v, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL) GROUP BY stack_id), {rounds}, {chain}, {name} AS (SELECT stack_id, t AS {name} FROM {name}_30)"""


add("li", "stack_id:l threshold:3", lambda s, d: H.li(S.pixels(s, d), "i"), "SELECT stack_id, t1 AS threshold FROM t1", PX + ", " + li_sql("px", "t1"))
add("li_double", "stack_id:l dim:3 bright:3", lambda s, d: H.li_double(S.pixels(s, d), "i"),
    "SELECT stack_id, t1 AS dim, coalesce(t2, t1) AS bright FROM t1 LEFT JOIN t2 USING (stack_id)",
    PX + ", " + li_sql("px", "t1") + ", ab AS (SELECT px.* FROM px JOIN t1 USING (stack_id) WHERE i > t1.t1), " + li_sql("ab", "t2"))
SWEEP = """lv AS (SELECT (l_quantity % 10)::DOUBLE AS v FROM lineitem),
sw AS (SELECT t, sum(CASE WHEN v <= t THEN 1 ELSE 0 END)::DOUBLE AS n0, sum(CASE WHEN v > t THEN 1 ELSE 0 END)::DOUBLE AS n1,
         sum(CASE WHEN v <= t THEN v ELSE 0 END) AS s0, sum(CASE WHEN v > t THEN v ELSE 0 END) AS s1
       FROM lv, range(1, 10) r(t) GROUP BY t HAVING n0 > 0 AND n1 > 0)"""


def levels(spark, sf_dir):
    return S.read(spark, sf_dir, "lineitem").select((F.col("l_quantity") % 10).alias("v"))


for criterion, score in (
    ("otsu", "n0 / (n0 + n1) * (n1 / (n0 + n1)) * (s0 / n0 - s1 / n1) * (s0 / n0 - s1 / n1)"),
    ("li", "-s0 * ln(s0 / n0 + 0.01) - s1 * ln(s1 / n1 + 0.01)"),
    ("yen", "-ln(power(n0 / (n0 + n1), 2) + power(n1 / (n0 + n1), 2) + 1e-10)"),
):
    add(f"{criterion}_sweep", "t:l score:5", lambda s, d, c=criterion: H.sweep(levels(s, d), c), f"SELECT t, {score} AS score FROM sw", SWEEP)

# -- morphology


def flagged(spark, sf_dir):
    return S.pixels(spark, sf_dir).withColumn("m", F.expr(MASK).cast("int"))


FLAG = PX + f", fl AS (SELECT *, ({MASK})::INT AS m FROM px)"
add("erode", f"{XY} eroded:l", lambda s, d: P.erode(flagged(s, d), "m", 1), "SELECT *, e_v AS eroded FROM e", FLAG + ", " + morph("fl", "m", 1, True, "e"))
add("dilate", f"{XY} dilated:l", lambda s, d: P.dilate(flagged(s, d), "m", 1), "SELECT *, e_v AS dilated FROM e", FLAG + ", " + morph("fl", "m", 1, False, "e"))


def with_thresholds(spark, sf_dir):
    px = S.pixels(spark, sf_dir)
    return px.join(H.otsu_double(px, "i"), "stack_id")


TH = PX + ", " + otsu_double("px", "i") + ", pt AS (SELECT px.*, th.dim, th.bright FROM px JOIN th USING (stack_id))"


def cleaned(flag: str, name: str) -> str:
    steps, source, column = [], "ct", flag
    for k, shrink in enumerate((True, False, False, True)):
        steps.append(morph(source, column, 1, shrink, f"{name}{k}"))
        source, column = f"{name}{k}", f"{name}{k}_v"
    return ", ".join(steps)


add("categorize_morphological", f"{XY} category:l", lambda s, d: P.categorize_morphological(with_thresholds(s, d), F.col("dim"), F.col("bright"), 1),
    "SELECT d3.*, CASE WHEN q3_v = 1 THEN 2 WHEN d3_v = 1 THEN 1 ELSE 0 END AS category FROM d3 JOIN q3 USING (stack_id, frame, y, x)",
    TH + ", ct AS (SELECT *, (i > dim AND i <= bright)::INT AS d, (i > bright)::INT AS q FROM pt), " + cleaned("d", "d") + ", " + cleaned("q", "q"))

# -- regions

for n in (4, 8):
    add(f"label_components_{n}", f"{XY} label:l", lambda s, d, n=n: R.label_components(S.pixels(s, d), F.expr(MASK), n), "SELECT * FROM lb", PX + ", " + labels("px", MASK, n, "lb"))
CONNECTED = TH + ", " + labels("pt", "i > dim", 4, "lc") + """, cc AS (
  SELECT *, CASE WHEN label = 0 OR count(*) OVER w < 3 THEN 0 WHEN avg(i) OVER w > bright THEN 2 ELSE 1 END AS category
  FROM lc WINDOW w AS (PARTITION BY stack_id, frame, label))"""


def connected(spark, sf_dir):
    return R.categorize_connected(with_thresholds(spark, sf_dir), F.col("dim"), F.col("bright"), 3)


add("categorize_connected", f"{XY} category:l", connected, "SELECT * FROM cc", CONNECTED)


def regions(spark, sf_dir, min_area=0):
    """Dim and bright regions of plainly thresholded pixels, labelled 8-connected."""
    px = with_thresholds(spark, sf_dir)
    return R.region_props(R.label_categories(px, F.expr("case when i > bright then 2 when i > dim then 1 else 0 end")), min_area)


PROPS = TH + ", " + labels("pt", "i > dim AND i <= bright", 8, "ld") + ", " + labels("pt", "i > bright", 8, "lq") + """, props AS (
  SELECT stack_id, frame, category, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS min_row, min(x) AS min_col,
         max(y) + 1 AS max_row, max(x) + 1 AS max_col, max(x) - min(x) AS x_span, max(y) - min(y) AS y_span
  FROM (SELECT *, 1 AS category FROM ld WHERE label > 0 UNION ALL SELECT *, 2 FROM lq WHERE label > 0) GROUP BY stack_id, frame, category, label)"""
REGION = "stack_id:l frame:l category:l label:l area:l cy:6 cx:6 min_row:l min_col:l max_row:l max_col:l x_span:l y_span:l"
add("region_props", REGION, regions, "SELECT * FROM props", PROPS)
add("region_min_area", REGION, lambda s, d: regions(s, d, 4), "SELECT * FROM props WHERE area >= 4", PROPS)
BEST = "SELECT f.stack_id, f.frame, r.* EXCLUDE (stack_id, frame) FROM (SELECT DISTINCT stack_id, frame FROM px) f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY stack_id, frame ORDER BY area DESC, label) AS k FROM props WHERE category = 2) r ON r.stack_id = f.stack_id AND r.frame = f.frame AND k = 1"
add("region_largest", "stack_id:l frame:l label:l area:l cy:6 cx:6 x_span:l y_span:l",
    lambda s, d: R.largest_region(regions(s, d).where("category = 2"), S.pixels(s, d)), BEST, PROPS)
add("category_centroid", "stack_id:l frame:l cy:6 cx:6 n:l", lambda s, d: R.category_centroid(connected(s, d), 2),
    "SELECT stack_id, frame, avg(CASE WHEN category = 2 THEN y END) AS cy, avg(CASE WHEN category = 2 THEN x END) AS cx, count(*) FILTER (category = 2) AS n FROM cc GROUP BY stack_id, frame", CONNECTED)
add("region_summary", "stack_id:l n_frames:l total_dim_regions:l total_bright_regions:l", lambda s, d: R.region_summary(regions(s, d), S.pixels(s, d)),
    "SELECT stack_id, n_frames, coalesce(a, 0) AS total_dim_regions, coalesce(b, 0) AS total_bright_regions FROM (SELECT stack_id, count(DISTINCT frame) AS n_frames FROM px GROUP BY stack_id) LEFT JOIN (SELECT stack_id, count(*) FILTER (category = 1) AS a, count(*) FILTER (category = 2) AS b FROM props GROUP BY stack_id) USING (stack_id)", PROPS)
add("contour_edges", "stack_id:l frame:l ey:1 ex:1", lambda s, d: R.contour_edges(S.pixels(s, d), F.expr(MASK)),
    "SELECT a.stack_id, a.frame, (a.y + b.y) / 2.0 AS ey, (a.x + b.x) / 2.0 AS ex FROM fl a JOIN fl b ON a.stack_id = b.stack_id AND a.frame = b.frame AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.y = a.y + 1 AND b.x = a.x)) WHERE a.m <> b.m", FLAG)


def contours(spark, sf_dir):
    labelled = R.label_components(with_thresholds(spark, sf_dir), F.expr("i > bright"), 8)
    props = R.region_props(labelled.withColumn("category", F.lit(2)))
    return R.largest_contours(labelled, R.largest_region(props, S.pixels(spark, sf_dir)))


add("region_contours", "stack_id:l frame:l contour:l seq:l ey:1 ex:1", contours)

# -- clusters

KM = 12


def kmeans_sql(keys: str, source: str = "px") -> str:
    mean = "coalesce(list_sum(list_transform(list_filter(h, lambda e: {w}), lambda e: e.v * e.n)) / list_sum(list_transform(list_filter(h, lambda e: {w}), lambda e: e.n)), c[{j}])"
    inside = ("e.v <= (c[1] + c[2]) / 2", "e.v > (c[1] + c[2]) / 2 AND e.v <= (c[2] + c[3]) / 2", "e.v > (c[2] + c[3]) / 2")
    step = "[" + ", ".join(mean.format(w=w, j=j) for j, w in enumerate(inside, 1)) + "]"
    chain = ", ".join(f"km{k} AS MATERIALIZED (SELECT {keys}, h, {step} AS c FROM km{k - 1})" for k in range(1, KM + 1))
    return f"""km0 AS (SELECT {keys}, h, c FROM (SELECT {keys}, list({{'v': v, 'n': n}} ORDER BY v) AS h FROM (SELECT {keys}, i::DOUBLE AS v, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL) GROUP BY {keys})
  JOIN (SELECT {keys}, quantile_cont(i::DOUBLE, [1/6.0, 0.5, 5/6.0]::DOUBLE[]) AS c FROM {source} GROUP BY {keys}) USING ({keys})), {chain},
kl AS (SELECT p.*, (i > (c[1] + c[2]) / 2)::INT + (i > (c[2] + c[3]) / 2)::INT AS cluster FROM {source} p JOIN km{KM} USING ({keys}))"""


PER_FRAME = PX + ", " + kmeans_sql("stack_id, frame")
add("kmeans_1d_fixed", f"{XY} cluster:l", lambda s, d: K.kmeans_labels(S.pixels(s, d), R.FRAME), "SELECT * FROM kl", PER_FRAME)
add("kmeans_concat", f"{XY} cluster:l", lambda s, d: K.kmeans_labels(S.pixels(s, d), ("stack_id",)), "SELECT * FROM kl", PX + ", " + kmeans_sql("stack_id"))
add("cluster_areas", "stack_id:l frame:l cluster:l n:l area_um2:6 side_um:6", lambda s, d: K.cluster_areas(K.kmeans_labels(S.pixels(s, d), R.FRAME), 3, "60X").withColumn("side_um", F.sqrt("area_um2")),
    "SELECT *, n / 20.25::DOUBLE AS area_um2, sqrt(n / 20.25::DOUBLE) AS side_um FROM (SELECT stack_id, frame, j AS cluster, count(*) FILTER (cluster = j) AS n FROM kl, range(3) r(j) GROUP BY stack_id, frame, j)", PER_FRAME)
add("frames_concat_split", f"{XY} i:l", lambda s, d: K.split_frames(K.concatenate_frames(S.pixels(s, d), 8), 8), "SELECT * FROM px", PX)
add("frames_concat", "stack_id:l y:l x:l i:l", lambda s, d: K.concatenate_frames(S.pixels(s, d), 8), "SELECT stack_id, y, x + frame * 8 AS x, i FROM px", PX)


def scaled(spark, sf_dir):
    """Pixels as z-scores of their stack, so that the kernels' default constants apply."""
    px = S.pixels(spark, sf_dir)
    stats = px.groupBy("stack_id").agg(F.avg("i").alias("m"), F.stddev_pop("i").alias("d"))
    return px.join(stats, "stack_id").select("stack_id", "frame", "y", "x", ((F.col("i") - F.col("m")) / F.col("d")).alias("v"), F.lit(0.5).alias("dim"), F.lit(1.5).alias("bright"))


add("categorize_watershed", f"{XY} category:l", lambda s, d: K.categorize_watershed(scaled(s, d), apart=2, min_size=3, value="v"))
add("categorize_dbscan", f"{XY} category:l", lambda s, d: K.categorize_dbscan(scaled(s, d), least=3, min_size=3, value="v"))
add("categorize_growing", f"{XY} category:l", lambda s, d: K.categorize_growing(scaled(s, d), min_size=3, value="v"))

# -- a larger raster, for throughput

RASTER = """ra AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) - 1 - 1995 * 12 AS frame, l_suppkey % 32 AS y, l_partkey % 32 AS x, sum(l_quantity)::BIGINT AS i FROM lineitem GROUP BY ALL),
px AS (SELECT f.frame, a.y, b.x, coalesce(ra.i, 0) AS i FROM (SELECT DISTINCT frame FROM ra) f CROSS JOIN (SELECT range AS y FROM range(32)) a CROSS JOIN (SELECT range AS x FROM range(32)) b
       LEFT JOIN ra ON ra.frame = f.frame AND ra.y = a.y AND ra.x = b.x)"""
TAPS = P.gaussian_kernel(1.0)
WEIGHTS = ", ".join(f"({k - len(TAPS) // 2}, {w!r}::DOUBLE)" for k, w in enumerate(TAPS))
add("raster_blur", "frame:l y:l x:l blurred:4", lambda s, d: P.gaussian_blur(S.raster(s, d), 1.0, keys=("frame",)), "SELECT * FROM rv",
    RASTER + f""", wt(d, w) AS (VALUES {WEIGHTS}),
rh AS (SELECT a.frame, a.y, a.x, sum(b.i * w) / sum(w) AS i FROM px a JOIN wt ON a.x + d BETWEEN 0 AND 31 JOIN px b ON b.frame = a.frame AND b.y = a.y AND b.x = a.x + d GROUP BY ALL),
rv AS (SELECT a.frame, a.y, a.x, sum(b.i * w) / sum(w) AS blurred FROM px a JOIN wt ON a.y + d BETWEEN 0 AND 31 JOIN rh b ON b.frame = a.frame AND b.x = a.x AND b.y = a.y + d GROUP BY ALL)""")

"""Queries over the experiment catalogue and its metadata sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import catalog as C
from tracewell.operators.regions import with_scale
from tracewell.sources import standins as S

from .parts import EX, PAIRS
from .registry import add

EXP, KEYS = "exp_date:s img_serial:s", list(C.KEY)

add("catalog_count", "n:l", lambda s, d: S.experiments(s, d).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM ex", EX)
add("catalog_by_date", "exp_date:s n:l", lambda s, d: S.experiments(s, d).groupBy("exp_date").agg(F.count("*").alias("n")).orderBy("exp_date"),
    "SELECT exp_date, count(*) AS n FROM ex GROUP BY exp_date", EX, "ORDER BY exp_date")
add("catalog_filter_eq", f"{EXP} slice:l at:s", lambda s, d: S.experiments(s, d).where("slice = 7 and at = 'NATION_7'"),
    "SELECT * FROM ex WHERE slice = 7 AND \"at\" = 'NATION_7'", EX)
add("catalog_filter_span", f"{EXP} x_span_um:3", lambda s, d: S.experiments(s, d).where("x_span_um > 50"), "SELECT * FROM ex WHERE x_span_um > 50", EX)
add("catalog_not_null_sorted", f"{EXP} slice:l at:s total_bright_regions:l",
    lambda s, d: S.experiments(s, d).where("slice is not null").orderBy("slice", "at", "img_serial"),
    "SELECT * FROM ex WHERE slice IS NOT NULL", EX, 'ORDER BY slice, "at", img_serial')
add("catalog_avg_by_slice", "slice:l avg_area:4", lambda s, d: S.experiments(s, d).where("slice is not null").groupBy("slice").agg(F.avg("bright_area_um2").alias("avg_area")),
    "SELECT slice, avg(bright_area_um2) AS avg_area FROM ex WHERE slice IS NOT NULL GROUP BY slice", EX)
add("catalog_topk_regions", f"{EXP} total_bright_regions:l x_span_um:3",
    lambda s, d: S.experiments(s, d).where("x_span_um > 50").orderBy(F.desc("total_bright_regions"), F.desc("x_span_um"), "img_serial").limit(10),
    "SELECT * FROM ex WHERE x_span_um > 50 ORDER BY total_bright_regions DESC, x_span_um DESC, img_serial LIMIT 10", EX)
add("catalog_scan_keys", "exp_date:s abf_serial:s img_serial:s", lambda s, d: S.experiments(s, d).select(*KEYS), "SELECT exp_date, abf_serial, img_serial FROM ex", EX)


def picked(spark, sf_dir):
    return C.sheet_pairs(S.pairs(spark, sf_dir), "2025_01_01")


def processed(spark, sf_dir):
    """Keys that are in the catalogue already: recordings with a large order on file."""
    orders = S.read(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("k")).distinct()
    number = C.serial(F.col("k"))
    return orders.select(F.lit("2025_01_01").alias("exp_date"), number.alias("abf_serial"), number.alias("img_serial"))


DONE = PAIRS + """, dn AS (SELECT DISTINCT '2025_01_01' AS exp_date, lpad(o_custkey::VARCHAR, greatest(4, length(o_custkey::VARCHAR))::INT, '0') AS abf_serial FROM orders WHERE o_totalprice > 450000)"""
PAIR = "exp_date:s abf_serial:s img_serial:s objective:s slice:l"
ANTI = "SELECT * FROM pr WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.exp_date = pr.exp_date AND dn.abf_serial = pr.abf_serial)"
add("pairs_picked_union", PAIR, picked, "SELECT * FROM pr", PAIRS)
add("pairs_pending_anti", PAIR, lambda s, d: C.pending(picked(s, d), processed(s, d)), ANTI, DONE)
add("pairs_unique_images", "img_serial:s", lambda s, d: picked(s, d).select("img_serial").distinct().orderBy("img_serial"), "SELECT DISTINCT img_serial FROM pr", PAIRS, "ORDER BY img_serial")
add("pairs_for_date", PAIR, lambda s, d: picked(s, d).where("exp_date = '2025_01_01'").orderBy("img_serial").limit(20),
    "SELECT * FROM pr WHERE exp_date = '2025_01_01' ORDER BY img_serial LIMIT 20", PAIRS)
add("batch_counters", "n_success:l n_skipped:l",
    lambda s, d: picked(s, d).join(processed(s, d).withColumn("done", F.lit(True)), KEYS, "left").agg(F.count_if(F.col("done").isNull()).alias("n_success"), F.count_if("done").alias("n_skipped")),
    f"SELECT count(*) AS n_success, (SELECT count(*) FROM pr) - count(*) AS n_skipped FROM ({ANTI})", DONE)


def orders_by_customer(spark, sf_dir, low, high):
    rows = S.read(spark, sf_dir, "orders").where(f"o_orderdate >= '{low}' and o_orderdate < '{high}'")
    one = C.latest(rows, ("o_custkey",), F.desc("o_orderdate"), F.desc("o_orderkey"))
    return one.select("o_custkey", "o_orderkey", "o_totalprice")


def upserted(spark, sf_dir):
    old, new = orders_by_customer(spark, sf_dir, "1900-01-01", "1997-01-01"), orders_by_customer(spark, sf_dir, "1997-01-01", "2100-01-01")
    return C.upsert(old, new, ("o_custkey",))


add("catalog_upsert_latest", "o_custkey:l o_orderkey:l o_totalprice:4", upserted,
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
add("catalog_delete_key", "exp_date:s abf_serial:s img_serial:s",
    lambda s, d: C.delete(S.experiments(s, d), S.experiments(s, d).where("objective = '60X'")),
    "SELECT * FROM ex WHERE objective <> '60X'", EX)
add("objective_scale_lookup", "img_serial:s objective:s um_per_pixel:6 span_um:6",
    lambda s, d: with_scale(S.experiments(s, d)).withColumn("span_um", F.col("x_span_um") * F.col("um_per_pixel")),
    "SELECT *, x_span_um * um_per_pixel AS span_um FROM (SELECT *, 1 / CASE objective WHEN '10X' THEN 0.75::DOUBLE WHEN '40X' THEN 3.0::DOUBLE WHEN '60X' THEN 4.5::DOUBLE END AS um_per_pixel FROM ex)", EX)
add("json_extract_largest", "event_id:l k:l", lambda s, d: S.read(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")),
    "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")


def json_catalogue(spark, sf_dir):
    """A catalogue row per user with a region, or null, for each of the user's events."""
    k = F.from_json("props", "k bigint")["k"]
    null = F.lit(None)
    region = F.when(k % 3 != 0, F.struct(
        F.array(k.cast("double"), (k + 1).cast("double")).alias("centroid"), F.array(*[F.lit(0)] * 4).cast("array<bigint>").alias("bbox"), k.alias("label"),
        F.col("value").alias("x_span_pixels"), null.cast("double").alias("y_span_pixels"), null.cast("double").alias("x_span_um"), null.cast("double").alias("y_span_um")))
    events = S.read(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", region.alias("r")).alias("e"))
    lists = events.groupBy("user_id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return lists.select("user_id", C.region_json(F.transform("e", lambda e: e.r), F.lit("60X"), F.lit(1 / 4.5)).alias("region_analysis"))


JSON = """ev AS (SELECT user_id, json_extract(props, '$.k')::BIGINT AS k, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index FROM events)"""
add("export_exploded_regions", "user_id:l frame_index:l label:l cy:3 x_span_pixels:4",
    lambda s, d: C.exploded_regions(json_catalogue(s, d)).withColumn("cy", F.col("centroid")[0]),
    "SELECT *, k AS label, k AS cy, value AS x_span_pixels FROM ev WHERE k % 3 <> 0", JSON)
add("spike_frame_region", "user_id:l label:l",
    lambda s, d: json_catalogue(s, d).select("user_id", C.spike_frame_region(F.from_json("region_analysis", C.ANALYSIS)["bright_largest"])["label"].alias("label")),
    "SELECT e.user_id, CASE WHEN k % 3 <> 0 THEN k END AS label FROM ev e JOIN (SELECT user_id, count(*) // 2 AS mid FROM ev GROUP BY user_id) m ON m.user_id = e.user_id AND frame_index = mid", JSON)

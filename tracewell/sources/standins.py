"""Views that give the benchmark tables the shape of recordings.

pixels       embeddings as 8x8 frames: one stack per label, one frame per vector
trace, gate  events as one voltage-like series per user
experiments  orders with their customer and nation as a catalogue of experiments
pairs        picked recordings; processed: those a catalogue already holds
raster       lineitem as a 32x32 frame per month
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 8
PEAK_DISTANCE, PEAK_PROMINENCE, SAMPLES_PER_FRAME = 8, 10.0, 2


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stack_id, frame, y, x, i: whole-number intensities, 0 to 65535."""
    order = Window.partitionBy("label").orderBy("vec_id")
    frames = read(spark, sf_dir, "embeddings").select(
        F.col("label").alias("stack_id"), (F.dense_rank().over(order) - 1).alias("frame"), "embedding")
    z = F.col("z").cast("double")
    level = F.least(F.lit(65535), F.greatest(F.lit(0), F.floor((z + 1) * 32767.5))).cast("int")
    return frames.select("stack_id", "frame", F.posexplode("embedding").alias("p", "z")).select(
        "stack_id", "frame", (F.col("p") / SIDE).cast("int").alias("y"), (F.col("p") % SIDE).alias("x"), level.alias("i"))


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, sample, t (seconds), vm."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_id"), (F.row_number().over(order) - 1).cast("long").alias("sample"),
        seconds.alias("t"), F.col("value").alias("vm"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id with its stack_id and frame count, the pairing of traces with image stacks."""
    return trace(spark, sf_dir).groupBy("series_id").agg(
        (F.col("series_id") % 10).cast("int").alias("stack_id"), F.floor(F.count("*") / SAMPLES_PER_FRAME).alias("n_frames"))


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    nations = F.broadcast(read(spark, sf_dir, "nation"))  # a fixed list of countries
    objective = F.element_at(F.create_map(*(F.lit(v) for v in ("1", "10X", "2", "40X", "3", "60X", "4", "40X", "5", "60X"))), F.substring("o_orderpriority", 1, 1))
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, customers.c_nationkey == nations.n_nationkey)
    return joined.select(
        F.date_format("o_orderdate", "yyyy_MM_dd").alias("exp_date"),
        F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("abf_serial"),
        F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("img_serial"),
        F.col("o_orderdate").alias("recorded"), objective.alias("objective"),
        F.when(F.col("n_regionkey") != 0, F.col("n_nationkey")).alias("slice"),
        F.when(F.col("n_regionkey") != 0, F.col("n_name")).alias("at"),
        (F.col("o_orderkey") % 23).alias("total_dim_regions"), (F.col("o_orderkey") % 17).alias("total_bright_regions"),
        F.round(F.col("o_totalprice") / 1000, 3).alias("x_span_um"), F.col("o_totalprice").alias("bright_area_um2"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two metadata sheets in one shape: one names SLICE and AT, the other does not."""
    customers = read(spark, sf_dir, "customer")
    pick = F.when(F.col("c_acctbal") > 0, F.lit("x"))
    base = customers.select(
        F.concat(F.lit("2025_01_01-"), F.col("c_custkey"), F.lit(".tif")).alias("Filename"),
        F.col("c_custkey").alias("ABF"), F.col("c_mktsegment").alias("OBJ"), pick.alias("PICK"),
        F.col("c_nationkey").alias("SLICE"), F.col("c_custkey").alias("key"))
    with_slice = base.where("key % 2 = 0").drop("key")
    without = base.where("key % 2 = 1").drop("key", "SLICE")
    return with_slice.unionByName(without, allowMissingColumns=True)


def raster(spark: SparkSession, sf_dir: str, side: int = 32) -> DataFrame:
    """frame, y, x, i: whole quantities by month over a full grid, 0 where nothing was shipped."""
    items = read(spark, sf_dir, "lineitem")
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1 - 1995 * 12).alias("frame")
    sums = items.groupBy(month, (F.col("l_suppkey") % side).cast("int").alias("y"), (F.col("l_partkey") % side).cast("int").alias("x")).agg(F.sum("l_quantity").cast("long").alias("i"))
    spread = spark.range(side * side).select((F.col("id") / side).cast("int").alias("y"), (F.col("id") % side).cast("int").alias("x"))
    grid = sums.select("frame").distinct().crossJoin(F.broadcast(spread))  # side * side cells for every frame
    return grid.join(sums, ["frame", "y", "x"], "left").select("frame", "y", "x", F.coalesce("i", F.lit(0)).alias("i"))

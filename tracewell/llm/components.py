"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import shared_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (columns a, b), the component being its
    smallest node. Nodes without edges are absent; loops and repeated edges are ignored.

    Each round points the larger neighbours of every node at its smallest neighbour, then the
    node and its smaller neighbours too; it ends once a round changes nothing. Rounds are
    written out, so a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        seen = Observation()
        path = shared_dir(spark, "components")
        now.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).write.parquet(path)
        now = spark.read.schema("u long, v long").parquet(path)
        mark = (seen.get["n"], seen.get["s"])
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

"""Streaming counterparts: an extension, the batch operators are the model.

`running_catalogue` keeps a catalogue up to date from a stream of finished experiments, one
upsert per micro-batch; `windowed_counts` counts events by time window with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tracewell.operators.catalog import KEY, latest, upsert


def running_catalogue(stream: DataFrame, path: str, key: tuple[str, ...] = KEY, order: str = "recorded") -> DataStreamWriter:
    """A writer that upserts each micro-batch under path, a version folder per batch; a repeated
    batch writes the same folder again, so a restart changes nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        new = latest(batch, key, F.desc(order))
        if epoch:
            new = upsert(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/v{epoch - 1:08d}"), new, key)
        new.write.mode("overwrite").parquet(f"{path}/v{epoch:08d}")

    return stream.writeStream.foreachBatch(merge)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return seen.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total")

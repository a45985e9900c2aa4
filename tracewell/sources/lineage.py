"""Cutting lineage where a result feeds several later steps."""

from __future__ import annotations

from pyspark.sql import DataFrame

FALLBACK = "/tmp/checkpoints/tracewell"  # sessions without spark.checkpoint.dir: tests on one machine


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(FALLBACK)
    return df.checkpoint()

"""Queries with their DuckDB twins. Both sides end in the same column list and types."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    query: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def _spark_column(spec: str):
    name, kind = spec.split(":")
    if kind.isdigit():
        # + 0.0 turns a negative zero into zero
        return (F.round(F.col(name).cast("double"), int(kind)) + F.lit(0.0)).alias(name)
    return F.col(name).cast({"l": "long", "s": "string", "b": "boolean", "d": "double"}[kind]).alias(name)


def _sql_column(spec: str) -> str:
    name, kind = spec.split(":")
    if kind.isdigit():
        return f"round(\"{name}\"::DOUBLE, {kind}) + 0.0::DOUBLE AS \"{name}\""
    return f"\"{name}\"::{dict(l='BIGINT', s='VARCHAR', b='BOOLEAN', d='DOUBLE')[kind]} AS \"{name}\""


def add(name: str, columns: str, query: Query, sql: str | None = None, parts: str = "", tail: str = "") -> None:
    """columns: "name:kind ..." with l (long), s (string), b (boolean), d (double) or digits to
    round to. sql is a SELECT over the WITH list in parts; tail (ORDER BY, LIMIT) closes it."""
    specs = columns.split()

    def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir).select(*map(_spark_column, specs))

    text = None
    if sql is not None:
        text = f"{'WITH RECURSIVE ' + parts if parts else ''}\nSELECT {', '.join(map(_sql_column, specs))} FROM ({sql}) AS result {tail}"
    ENTRIES[name] = Entry(shaped, text)

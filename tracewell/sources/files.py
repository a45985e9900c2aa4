"""File sources and sinks of recordings, as Spark-side readers where Spark has none.

Stacks are stored as one row per frame (or tile) with an integer array; TIFF, trace and sheet
files are decoded by Arrow functions over the binaryFile source, each behind an optional import.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "stack_id string, frame int, h int, w int, pixels array<int>, error string"
TRACES = "rec_id string, rate_hz double, sample long, t double, vm double, gate double, error string"
#: Samples that one output batch of a trace holds.
TRACE_ROWS = 200_000


def need(module: str):
    """The optional decoder module, or an error that names it."""
    import importlib

    try:
        return importlib.import_module(module)
    except ModuleNotFoundError as e:
        raise RuntimeError(f"reading these files needs the optional package {module}") from e


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(stem.alias("stem"), "content")


def read_stacks(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """TIFF stacks as rows of whole frames. A file must fit the 2 GB of a binary value; one that
    cannot be read gives one row with its error, and the others go on."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tifffile = need("tifffile")
        for pdf in batches:
            for stem, content in zip(pdf["stem"], pdf["content"], strict=True):
                try:
                    with tifffile.TiffFile(io.BytesIO(content)) as file:
                        for k, page in enumerate(file.pages):
                            a = page.asarray().astype("uint16")
                            yield pd.DataFrame({"stack_id": [stem], "frame": [k], "h": [a.shape[0]], "w": [a.shape[1]], "pixels": [a.ravel().astype("int32")], "error": [None]})
                except Exception as e:  # whatever the decoder raises for a damaged file
                    yield pd.DataFrame({"stack_id": [stem], "frame": [None], "h": [None], "w": [None], "pixels": [None], "error": [f"{type(e).__name__}: {e}"]})

    return _files(spark, path, pattern).mapInPandas(decode, FRAMES)


def read_traces(spark: SparkSession, path: str, pattern: str = "*.abf", voltage: int = 0, gate: int = 3) -> DataFrame:
    """Recordings as samples of the voltage and gate channels; a file that cannot be read gives
    one row with its error."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tempfile

        pyabf = need("pyabf")
        for pdf in batches:
            for stem, content in zip(pdf["stem"], pdf["content"], strict=True):
                try:
                    with tempfile.NamedTemporaryFile(suffix=".abf") as file:  # the decoder takes names only
                        file.write(content)
                        file.flush()
                        abf = pyabf.ABF(file.name)
                    n = abf.data.shape[1]
                except Exception as e:  # whatever the decoder raises for a damaged file
                    yield pd.DataFrame({"rec_id": [stem], "rate_hz": [None], "sample": [None], "t": [None], "vm": [None], "gate": [None], "error": [f"{type(e).__name__}: {e}"]})
                    continue
                for first in range(0, n, TRACE_ROWS):
                    rows = slice(first, min(n, first + TRACE_ROWS))
                    yield pd.DataFrame({"rec_id": stem, "rate_hz": float(abf.dataRate), "sample": range(rows.start, rows.stop), "t": [k / abf.dataRate for k in range(rows.start, rows.stop)], "vm": abf.data[voltage][rows], "gate": abf.data[gate][rows], "error": None})

    return _files(spark, path, pattern).mapInPandas(decode, TRACES)


def frames_to_pixels(frames: DataFrame) -> DataFrame:
    """Long pixel rows of stored frames: for windows of a few frames, not for whole recordings."""
    at = frames.select("stack_id", "frame", "w", F.posexplode("pixels").alias("p", "i"))
    return at.select("stack_id", "frame", F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).alias("x"), "i")


def pixels_to_frames(px: DataFrame, value: str = "i") -> DataFrame:
    """One row per frame, its pixels in raster order."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).alias("v"))))
    grouped = px.groupBy("stack_id", "frame").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), cells.alias("c"))
    return grouped.select("stack_id", "frame", "h", "w", F.transform("c", lambda c: c.v).alias("pixels"))


def stack_date(path: Column) -> Column:
    """The YYYY_MM_DD part of a recording's or sheet's file name."""
    return F.regexp_extract(path, r"(\d{4}_\d{2}_\d{2})", 1)


def write_stack(frames: DataFrame, path: str) -> None:
    frames.write.mode("overwrite").partitionBy("stack_id").parquet(path)


def read_sheets(spark: SparkSession, path: str, pattern: str = "REC_*") -> tuple[DataFrame | None, list[str]]:
    """Picked pairs of all sheets under path, and the files that lack a needed column. Sheets are
    CSV with a header, or Excel where openpyxl is installed; a sheet's date is in its file name."""
    from tracewell.operators.catalog import sheet_pairs

    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}.*")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, skipped, whole = sorted(str(s.getPath()) for s in fs.globStatus(root)), [], None
    for file in found:
        date = stack_date_of(file)
        try:
            sheet = spark.read.option("header", True).csv(file) if file.endswith(".csv") else _excel(spark, file)
            pairs = sheet_pairs(sheet, date) if date else None
        except Exception as e:  # an unreadable sheet is reported, the others are read
            skipped.append(f"{file}: {type(e).__name__}")
            continue
        if pairs is None:
            skipped.append(f"{file}: no date or a column is missing")
            continue
        whole = pairs if whole is None else whole.unionByName(pairs)
    return whole, skipped


def _excel(spark: SparkSession, file: str) -> DataFrame:
    openpyxl = need("openpyxl")
    content = spark.read.format("binaryFile").load(file).select("content").first()[0]  # a sheet of some hundred rows
    rows = list(openpyxl.load_workbook(io.BytesIO(content), read_only=True, data_only=True).active.values)
    names = [str(c) for c in rows[0] if c is not None]
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in r[: len(names)]) for r in rows[1:]], ", ".join(f"`{n}` string" for n in names))


def stack_date_of(name: str) -> str | None:
    import re

    found = re.search(r"\d{4}_\d{2}_\d{2}", name.rsplit("/", 1)[-1])
    return found.group() if found else None

"""The experiment catalogue: keys, pending work, upsert, deletion, JSON and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ("exp_date", "abf_serial", "img_serial")
#: Names that a sheet's trace column may have, first match wins for the sheet.
TRACE_COLUMNS = ("ABF_NUMBER", "ABF_SERIAL_NUMBER", "ABF_SERIAL", "ABF", "STIM_PROTOCOL_NUMBER")
#: The catalogue's columns. `error` says why a pair gave no result.
SCHEMA = (
    "exp_date string, abf_serial string, img_serial string, timestamp timestamp, objective string, um_per_pixel double, threshold_method string, "
    "n_spikes_detected bigint, n_spikes_analyzed bigint, n_frames bigint, total_dim_regions bigint, total_bright_regions bigint, region_analysis string, "
    "data_dir string, slice int, at string, centroid_y double, centroid_x double, x_span_pixels double, y_span_pixels double, x_span_um double, y_span_um double"
)
REGION = "struct<centroid:array<double>,bbox:array<bigint>,label:bigint,x_span_pixels:double,y_span_pixels:double,x_span_um:double,y_span_um:double>"
ANALYSIS = f"struct<bright_largest:array<{REGION}>,obj:string,um_per_pixel:double>"


def serial(column: Column) -> Column:
    """Four digits at least, whether the sheet held text or a number."""
    text = column.cast("string")
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)


def sheet_pairs(sheet: DataFrame, exp_date: str) -> DataFrame | None:
    """Picked rows of one sheet as pairs; None where a needed column is missing (the sheet is
    then to be reported as skipped). Rows need a pick mark, a file name with a serial, a trace
    number and an objective; empty text and numeric 0 count as missing."""
    trace = next((c for c in TRACE_COLUMNS if c in sheet.columns), None)
    if trace is None or not {"Filename", "OBJ", "PICK"} <= set(sheet.columns):
        return None

    def given(name: str) -> Column:
        text = F.col(name).cast("string")
        return text.isNotNull() & ~text.isin("", "0", "0.0", "false")

    number = F.regexp_extract("Filename", r"-(.+?)(?:\.tif)?$", 1)
    optional = [F.col(c) if c in sheet.columns else F.lit(None) for c in ("SLICE", "AT")]
    return sheet.where(given("PICK") & given("Filename") & given("OBJ") & given(trace) & (number != "")).select(
        F.lit(exp_date).alias("exp_date"), serial(F.col(trace)).alias("abf_serial"), serial(number).alias("img_serial"),
        F.col("OBJ").cast("string").alias("objective"), optional[0].cast("int").alias("slice"), optional[1].cast("string").alias("at"))


def pending(pairs: DataFrame, done: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Pairs that the catalogue doesn't hold yet; repeated pairs stay repeated."""
    return pairs.join(done.select(*key), list(key), "left_anti")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Whole versions of the catalogue under path."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for s in fs.listStatus(root) if fs.exists(root) else []:
        name = s.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found.append(int(name[1:]))
    return sorted(found)


def read_catalogue(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """The newest version of the stored catalogue, or an empty one where nothing is stored yet."""
    held = _versions(spark, path)
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v{held[-1]:06d}")


def create_catalogue(spark: SparkSession, path: str, schema: str = SCHEMA) -> None:
    """An empty catalogue, where there is none."""
    if not _versions(spark, path):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/v{1:06d}")


def upsert(stored: DataFrame, new: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """New rows replace stored ones of the same key."""
    return stored.join(new.select(*key), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def latest(rows: DataFrame, key: tuple[str, ...], *order: Column) -> DataFrame:
    """One row for each key, the first by order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def delete(stored: DataFrame, keys: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    return stored.join(keys.select(*key), list(key), "left_anti")


def region_json(regions: Column, objective: Column, um_per_pixel: Column) -> Column:
    """The three stored keys as JSON; frames without a region are null elements."""
    return F.to_json(F.struct(regions.alias("bright_largest"), objective.alias("obj"), um_per_pixel.alias("um_per_pixel")), {"ignoreNullFields": "false"})


def exploded_regions(catalogue: DataFrame, column: str = "region_analysis") -> DataFrame:
    """A row for each frame's stored region, with its frame index; null elements are skipped."""
    rest = [c for c in catalogue.columns if c != column]
    held = catalogue.select(*rest, F.posexplode(F.from_json(column, ANALYSIS)["bright_largest"]).alias("frame_index", "r"))
    return held.where("r is not null").select(*rest, "frame_index", "r.*")


def spike_frame_region(regions: Column) -> Column:
    """The middle frame's element of an array of regions."""
    return F.get(regions, F.floor(F.size(regions) / 2).cast("int"))


def write_catalogue(rows: DataFrame, path: str) -> None:
    """Store rows as the next version; readers see it once it is whole, and older ones stay."""
    held = _versions(rows.sparkSession, path)
    rows.write.mode("overwrite").parquet(f"{path}/v{(held[-1] if held else 0) + 1:06d}")


def store_results(results: DataFrame, path: str, key: tuple[str, ...] = KEY) -> None:
    """Put results into the stored catalogue: rows of the same key are replaced, others stay."""
    create_catalogue(results.sparkSession, path)
    write_catalogue(upsert(read_catalogue(results.sparkSession, path), results, key), path)


def not_stored(keys: DataFrame, *stored: DataFrame) -> DataFrame:
    """The keys that are absent from at least one of the stored outputs (those in all are done)."""
    names, done = keys.columns, keys
    for rows in stored:
        done = done.join(rows.select(*names).distinct(), names, "left_semi")
    return keys.join(done.distinct(), names, "left_anti")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)

"""Shared helpers: work folders, lineage cuts, id filters and text normalisation."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids above this count are never broadcast (8 bytes each, so 16 MB at most).
BROADCAST_IDS = 2_000_000
#: Where a session with a local master names no checkpoint folder (tests only).
FALLBACK_DIR = "file:///tmp/checkpoints/tracewell"
#: Bytes of input for a shuffle partition whose number follows from the input's size.
TASK_BYTES = 128 << 20
#: Bytes of text that a Python task handles at a time.
SLICE_BYTES = 4 << 20
#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 4 << 20
#: The bytes that separate words, and the upper-case letters that are folded.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _give_memory_back() -> None:
    """Buffers from 4 MB up get pages of their own, which go back when they are freed, and Arrow
    takes its memory from the same place. Otherwise what one task needed stays with the reused
    worker, and the workers of an executor add up."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL(None).mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD


_give_memory_back()
_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """The Python worker's cache for one operator.

    Spark reuses workers, so one may serve several operators in turn; taking an operator's cache
    drops those of the others, and gives their memory back.
    """
    if owner not in _caches:
        if _caches:
            _caches.clear()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
                ctypes.CDLL(None).malloc_trim(0)
        _caches[owner] = {}
    return _caches[owner]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, under spark.checkpoint.dir."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = FALLBACK_DIR
    if "://" not in root and not root.startswith("file:"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        root = ("file://" if default.startswith("file:") else default.rstrip("/")) + root
    return f"{root.rstrip('/')}/tracewell-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of Hadoop for a path of any scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps survive lost executors."""
    small_batches(df.sparkSession)
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let rows go to Python BATCH_BYTES at a time, unless the session asks for less: executors
    hold several such batches off the heap, and their size does not make tasks faster."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = str(spark.conf.get(key)).rstrip("b")
    if not size.isdigit() or int(size) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_case(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def parts(spark: SparkSession, rows: int = 0, per_task: int = 1_000_000) -> int:
    """Number of shuffle partitions: the session's setting, or more where rows ask for it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def size_parts(df: DataFrame, per_task: int = TASK_BYTES) -> int:
    """Number of shuffle partitions for df: the session's setting, or more where df's size in
    bytes (the plan's statistics, or a scan where they are unknown) asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        texts = [F.octet_length(F.col(f"`{f.name}`")) if f.dataType.typeName() in ("string", "binary") else F.lit(8) for f in df.schema]
        size = df.agg(F.sum(sum((F.coalesce(t, F.lit(0)).cast("long") for t in texts), F.lit(0)))).first()[0] or 0
    return max(parts(df.sparkSession), -(-size // per_task))


def keep_ids(df: DataFrame, ids: DataFrame, anti: bool = False, column: str = "doc_id") -> DataFrame:
    """Rows whose id is in ids (or is not). ids is small in most corpora and is then broadcast
    after a count; above BROADCAST_IDS the same join shuffles both sides."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), column, "left_anti" if anti else "left_semi")


def boxed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and the whole row in one struct, so that no added name can clash."""
    return docs.select(*needed, F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"))


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about limit bytes of text."""
    import numpy as np

    for batch in batches:
        i = batch.schema.get_field_index(text)
        if batch.num_rows == 0:
            continue
        sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(i)), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def id_column(values: pa.Array) -> pa.Array:
    return values.cast(pa.int64())

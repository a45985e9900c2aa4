"""Token ids as length-delimited binary records with an offset index.

A shard holds frames of
    u64 length | u32 masked checksum of those 8 bytes | payload | u32 masked checksum of payload
(little-endian; checksums are CRC-32, rotated and offset so that a checksum of data that holds
checksums stays sound). A payload is: i64 id | u8 flags (1: no id, 2: ids take 4 bytes, else 2)
| ids. Beside each shard an index file holds the u64 offset of every frame, so that records can
be read in any order. Shards follow ascending doc_id; a manifest table, written by Spark's own
commit protocol, names the shards that count, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_column, size_parts, slices, text_of
from .tokens import encoder

MASK_DELTA = 0xA282EAD8  # fixed value: the offset of masked checksums
HEAD, FOOT, LEAD = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qB")
NO_ID, WIDE = 1, 2
READ_BYTES = 8 << 20
MANIFEST = "shard int, file string, n_records long, n_tokens long, n_bytes long"
RECORDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    flags = (NO_ID if doc_id is None else 0) | (WIDE if wide else 0)
    payload = LEAD.pack(doc_id or 0, flags) + ids.astype("<u4" if wide else "<u2").tobytes()
    size = struct.pack("<Q", len(payload))
    return HEAD.pack(len(payload), masked(size)) + payload + FOOT.pack(masked(payload))


def unframe(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """(doc_id, ids as little-endian u32, next offset); ValueError where a checksum differs."""
    size, check = HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError(f"damaged length at {at}")
    at += HEAD.size
    payload = bytes(data[at : at + size])
    if masked(payload) != FOOT.unpack_from(data, at + size)[0]:
        raise ValueError(f"damaged record at {at}")
    doc_id, flags = LEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=LEAD.size)
    return (None if flags & NO_ID else doc_id), ids.astype("<u4"), at + size + FOOT.size


def open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """Encode every whole text (null: empty) and write shards in ascending doc_id under folder.

    Rows without an id come first; rows that repeat an id follow each other in an order fixed by
    their texts, and may lie in several shards, so neither null ids nor one repeated id land in
    one task. Shards take about TASK_BYTES of text. An empty table gives no shard. Other columns
    are ignored. Returns the manifest, already written.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        wide = max(enc.vocabulary, end_id or 0) > 0xFFFF
        store, root = open_folder(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}"
        out, offsets, at, tokens = None, [], 0, 0
        tail = np.array([] if end_id is None else [end_id], "<u4").tobytes()
        for batch in slices(batches):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/.{name}.tmp", buffer_size=1 << 20)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                row = np.frombuffer(enc.encode_one(text.as_py()) + tail, "<u4")
                framed = frame(doc_id, row, wide)
                out.write(framed)
                offsets.append(at)
                at += len(framed)
                tokens += len(row)
        if out is not None:
            out.close()
            with store.open_output_stream(f"{root}/{name}.idx") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            store.move(f"{root}/.{name}.tmp", f"{root}/{name}.rec")
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, "n_records": len(offsets), "n_tokens": tokens, "n_bytes": at}], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(size_parts(rows), *order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def scan(uri: str, name: str, order: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a shard's records, in file order or by the given record numbers."""
    store, root = open_folder(uri)
    with store.open_input_stream(f"{root}/{name}.idx") as index:
        offsets = np.frombuffer(index.read(), "<u8").astype(np.int64)
    with store.open_input_file(f"{root}/{name}.rec") as file:
        ends = np.append(offsets[1:], file.size())
        if order is not None:
            for k in order:
                doc_id, ids, _ = unframe(memoryview(file.read_at(int(ends[k] - offsets[k]), int(offsets[k]))), 0)
                yield doc_id, ids
            return
        k = 0
        while k < len(offsets):
            stop = max(k + 1, int(np.searchsorted(ends, offsets[k] + READ_BYTES, "right")))
            data, at = memoryview(file.read_at(int(ends[stop - 1] - offsets[k]), int(offsets[k]))), 0
            for _ in range(k, stop):
                doc_id, ids, at = unframe(data, at)
                yield doc_id, ids
            k = stop


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Per record, in the shards' order: doc_id, start (ids before it), n_tokens, ids_crc32.

    The manifest (a row for each shard) gives every shard's first position; each task then
    scans whole shards and checks every checksum.
    """
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("shard").collect()
    starts = np.cumsum([0, *(s.n_tokens for s in shards)])
    listed = spark.createDataFrame([(s.file, int(b)) for s, b in zip(shards, starts, strict=False)], "file string, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                at, rows = entry["base"], []
                for doc_id, ids in scan(folder, entry["file"]):
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([id_column(pa.array(c)) for c in zip(*rows, strict=True)], schema=RECORDS)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([id_column(pa.array(c)) for c in zip(*rows, strict=True)], schema=RECORDS)

    return listed.repartition(max(1, len(shards))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

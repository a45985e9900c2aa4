"""Texts as lossless WebP media: stored in a table, read back to pixels and described.

A payload (the text's UTF-8 bytes, spaces up to a multiple of 192) becomes rows of 64 RGB
pixels; payloads over 16,384 such rows become rows of 16,384 pixels, filled up with zeros. The
format ends at 16,384 rows: a text over 805 MB raises.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, text_of
from .webp import decode, encode

UNIT, NARROW, SIDE = 192, 64, 1 << 14
STORED = "doc_id long, n_bytes long, payload_bytes long, media binary"


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT))


def store_payload(payload: bytes) -> bytes:
    width = NARROW if len(payload) <= 3 * NARROW * SIDE else SIDE
    height = -(-len(payload) // (3 * width))
    if height > SIDE:
        raise ValueError("a payload over 805 MB does not fit one image")
    return encode(np.frombuffer(payload.ljust(3 * width * height, b"\0"), np.uint8).reshape(height, width, 3))


def read_pixels(media: bytes) -> np.ndarray:
    """Red, green and blue, (height, width, 3)."""
    return decode(media)[:, :, 1:]


def feature(pixels: np.ndarray) -> str:
    """Size, channel means and a 64-bit hash (which of 64 runs of pixels are brighter than all)."""
    flat = pixels.reshape(-1, 3).astype(np.float64)
    light = flat.sum(1)
    runs = np.add.reduceat(light, edges := np.arange(64) * len(light) // 64)
    means = runs / np.diff(np.append(edges, len(light))) if len(light) >= 64 else light
    bits = sum(1 << k for k, bright in enumerate(means > light.mean()) if bright)
    r, g, b = flat.mean(0)
    return f"{pixels.shape[1]}x{pixels.shape[0]} {r:.3f},{g:.3f},{b:.3f} {bits:016x}"


def store(docs: DataFrame) -> DataFrame:
    """Write doc_id, n_bytes, payload_bytes and media of every whole text (null: empty).

    Equal texts give equal media; repeated rows are stored as often as they occur; an empty
    table gives an empty one; other columns are ignored.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.as_py().encode("utf-8", "surrogatepass") for t in batch.column("text")]
            payloads = [payload_of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(map(len, payloads), pa.int64()), pa.array(map(store_payload, payloads), pa.binary())],
                ["doc_id", "n_bytes", "payload_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return cut(rows.mapInArrow(pack, STORED), "media")


def pixels(stored: DataFrame) -> DataFrame:
    """doc_id, height, width and the decoded pixel array (interleaved RGB bytes)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            found = [read_pixels(m.as_py()) for m in batch.column("media")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f.shape[0] for f in found], pa.int32()), pa.array([f.shape[1] for f in found], pa.int32()), pa.array([f.tobytes() for f in found], pa.binary())],
                ["doc_id", "height", "width", "rgb"])

    return stored.select("doc_id", "media").mapInArrow(read, "doc_id long, height int, width int, rgb binary")


REPORT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_report(docs: DataFrame) -> DataFrame:
    """Store every text and describe what the stored bytes decode to, a row per document.

    Null and empty texts are one unit of spaces; equal texts get equal values, repeated rows a row
    each; an empty table gives no rows; other columns are ignored.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for r in batch.to_pylist():
                found = read_pixels(r["media"])
                payload = found.tobytes()[: r["payload_bytes"]]
                rows.append((r["doc_id"], r["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(r["media"]), hashlib.sha256(r["media"]).hexdigest(), feature(found)))
            types = [pa.string() if "string" in f else pa.int64() for f in REPORT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in REPORT.split(", ")])

    return store(docs).mapInArrow(describe, REPORT)

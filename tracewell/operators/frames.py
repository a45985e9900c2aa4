"""Whole frames for numpy kernels, streamed: a task holds a frame, or small frames together up to
BLOCK_PIXELS, whatever the size of frames and stacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

FRAME = ("stack_id", "frame")
#: Pixels handed to one call: small frames travel together, a larger frame alone.
BLOCK_PIXELS = 1 << 18


def whole_frames(batches: Iterator[pd.DataFrame], keys: tuple[str, ...], limit: int = BLOCK_PIXELS) -> Iterator[pd.DataFrame]:
    """Rows sorted by keys as blocks of whole frames; `_f` numbers a block's frames. A block is
    handed on as soon as it holds `limit` rows, so it is under `limit` rows and one frame."""
    held: list[pd.DataFrame] = []
    rows = 0

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        new = (pdf[list(keys)] != pdf[list(keys)].shift()).any(axis=1)
        return pdf.assign(_f=new.cumsum().to_numpy() - 1)

    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows < limit:
            continue
        block = numbered(pd.concat(held, ignore_index=True))
        f = block["_f"].to_numpy()
        first_of_last = int(np.searchsorted(f, f[-1]))
        held = [block.iloc[first_of_last:].drop(columns="_f")]
        rows = len(held[0])
        if first_of_last:
            yield block.iloc[:first_of_last]
    if rows:
        yield numbered(pd.concat(held, ignore_index=True))


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Arrow rows sorted by keys as blocks of whole runs of equal keys, with marks where a run
    begins. A block is handed on as soon as it holds `limit` rows. Null keys are equal."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def marked() -> tuple[pa.Table, np.ndarray]:
        block = pa.Table.from_batches(held).combine_chunks()
        new = np.ones(block.num_rows, bool)
        new[1:] = False
        for k in keys:
            a, b = block.column(k).slice(1), block.column(k).slice(0, block.num_rows - 1)
            differ = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.xor(pc.is_null(a), pc.is_null(b)), pc.not_equal(a, b))
            new[1:] |= differ.to_numpy().astype(bool)
        return block, new

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < limit:
            continue
        block, new = marked()
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield block.slice(0, last).combine_chunks(), new[:last]
        held = block.slice(last).to_batches()
        rows = block.num_rows - last
    if rows:
        yield marked()


def by_frames(px: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """work(pdf of whole frames, with their number in the block as `_f`) for all frames of px.

    Frames are dealt out by their keys and sorted within tasks; null keys are frames like others.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in whole_frames(batches, keys):
            yield work(block)

    return px.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(stream, schema)


def cube(pdf: pd.DataFrame, value: str, fill=0) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(frames, height, width) of a block, and where its rows stand; absent pixels are `fill`."""
    f, y, x = (pdf[c].to_numpy() for c in ("_f", "y", "x"))
    out = np.full((int(f.max()) + 1, int(y.max()) + 1, int(x.max()) + 1), fill, pdf[value].dtype)
    out[f, y, x] = pdf[value]
    return out, (f, y, x)


def with_columns(px: DataFrame, kernel: Callable[[pd.DataFrame], dict[str, np.ndarray]], added: str, keys: tuple[str, ...] = FRAME, drop: tuple[str, ...] = ()) -> DataFrame:
    """px with the columns that kernel gives for the rows of a block; `added` is their schema."""
    kept = [f for f in px.schema if f.name not in drop]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", {added}"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.drop(columns=["_f", *drop]).assign(**kernel(pdf))

    return by_frames(px, work, schema, keys)

"""Exact Jaccard self-join of documents on word shingles, and its connected components.

A document is the set of its distinct 5-word shingles, as sorted 64-bit hashes. Two documents
link when 100 * |intersection| >= 75 * |union|. The join finds every link's component:

1. One scan gives each document its set's size, fingerprint, two minima and bitmap signature
   (bit k is the parity of the shingles hashed to k; as many bits as 8n rounded up). Equal sets
   fall together by fingerprint, with map-side aggregation. The scan also counts shingles that
   recur within a task; the most frequent go last in the order of shingles.
2. Documents of a size band that share a minimum are compared with one leader of their group,
   so that a large group of near copies becomes one component for a linear number of pairs.
3. A second scan emits each set's prefix: the first n - ceil(3n/4) + 1 shingles in the order.
   Two linked sets share one. Documents that share a prefix shingle form a tile, sorted by size.
   Tiles of one component are dropped first; then one document stands for each component of a
   tile, where of many candidates a forest of the likeliest is verified; and last all do, but for
   tiles all of whose pairs were verified. No pair is verified twice. Only pairs of compatible sizes and positions, in
   different components, are candidates; in larger tiles the folded signatures must leave room for a link too. Rows come
   to Python sorted, tile by tile; a tile over BLOCK rows is split into pairs of blocks, each a
   tile of its own, so no task holds or compares more than two blocks.
4. A candidate is dropped if the set bits of its whole signatures' XOR, a lower bound of the
   difference, leave too little overlap; the rest is decided by intersecting the sorted arrays.

Nothing is sampled or capped: steps 1 to 4 lose no link, the order of shingles and step 2 only
save work. Hash collisions of 64-bit shingles within one pair are the only approximation.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, cut, keep_ids, parts, remove, shared_dir, slices, text_of, worker_cache
from .components import components

WORDS = 5
#: Link when UNION_PARTS * intersection >= LINK_PARTS * union.
LINK_PARTS, UNION_PARTS = 75, 100
#: Shingles counted together in a task, and the count there from which one may be frequent.
COUNTED, RECURS = 2_000_000, 3
#: A shingle is frequent from this count, or from total / FREQUENT on: at most FREQUENT of them,
#: 8 MB, are broadcast.
FREQUENT_FROM, FREQUENT = 256, 1 << 20
#: Rows compared with rows at a time, rows of a tile that one task takes.
TILE, BLOCK = 512, 8192
#: Rows of a tile up to which all such tiles of a batch are compared together, not one by one.
SMALL = 32
#: Rows of a tile from which they carry signatures (a smaller one has one pair), folded to FOLDED
#: bytes at most (so that they grow with a text's length, not its square); words of them compared
#: at a time.
LARGE, FOLDED, WORDS_AT_ONCE = 3, 256, 1 << 21
#: Bits of a signature for each shingle. With few, shingles that differ cancel out, and sets a
#: little too different to link pass as candidates: for each group of near copies, its square.
BITS_A_SHINGLE = 8
#: Candidates for each row of a tile from which a forest of them is verified first.
PAIRS_A_ROW = 2
#: Bytes of text whose shingles are made together: its arrays stay in a processor's cache.
TEXT_BYTES = 1 << 20
#: Bytes of a word that are hashed eight at a time for all words together; longer ones go singly.
LONG = 64
#: Sets that a task remembers so as to emit equal ones once.
REMEMBERED = 1 << 17
#: A leader of this many sets, and of more than a HOT_SHARE-th of all, is broadcast.
HOT_ROWS, HOT_SHARE = 500, 5000
FACTS = "doc_id long, n int, h1 long, h2 long, m1 long, m2 long, bits binary, folded binary, shingle long, count long"
_FACTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("m1", pa.int64()), ("m2", pa.int64()), ("bits", pa.binary()), ("folded", pa.binary()), ("shingle", pa.int64()), ("count", pa.int64())])
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX1, _MIX2, _STEP = (np.uint64(v) for v in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    y = x >> np.uint64(30)
    y ^= x
    y *= _MIX1
    z = y >> np.uint64(27)
    y ^= z
    y *= _MIX2
    np.right_shift(y, np.uint64(31), out=z)
    y ^= z
    return y


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (binary or string, no nulls), and each text's number."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = int(at[-1] - at[0])
    if not size:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    padded = np.frombuffer(data[int(at[0]) : int(at[-1])].to_pybytes().translate(ASCII_LOWER) + bytes(LONG), np.uint8)
    at -= at[0]
    inside = (padded[:size] != 32) & (padded[:size] - np.uint8(9) > 4)
    edge = np.zeros(size + 1, bool)  # where a text begins or ends
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:size]
    last[:-1] &= ~inside[1:] | edge[1:size]
    start = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - start
    eight = np.ndarray((size + LONG - 7,), "<u8", padded, strides=(1,))
    hashed = length.astype(np.uint64)
    some = slice(None)
    for k in range(0, LONG, 8):
        if k:
            some = np.flatnonzero(length > k)
            if not len(some):
                break
        hashed[some] = mix(hashed[some] * _STEP + (eight[start[some] + k] & _FIRST_BYTES[np.minimum(length[some] - k, 8)]))
    long = np.flatnonzero(length > LONG)
    if len(long):
        whole = np.empty(len(long), object)
        whole[:] = [padded[i : i + n].tobytes() for i, n in zip(start[long].tolist(), length[long].tolist(), strict=True)]
        hashed[long] = pd.util.hash_array(whole, categorize=False)
    return hashed, np.diff(np.searchsorted(start, at))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles, sorted within each text, and where each text's begin (and the
    last one's end); fewer words than five make one shingle."""
    worker_cache("shingles")
    if not len(texts):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    hashed, words = word_hashes(texts)
    rolled = mix(hashed + _STEP)
    for k in range(1, WORDS):
        rolled = mix(rolled[: max(0, len(hashed) - k)] * _STEP + hashed[k:]) if len(hashed) > k else np.empty(0, np.uint64)
    begin = np.cumsum(words) - words
    count = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    value = np.concatenate([rolled, np.empty(len(hashed) - len(rolled), np.uint64)])
    for n in range(1, WORDS):
        at = begin[words == n]
        whole = np.full(len(at), n, np.uint64)
        for k in range(n):
            whole = mix(whole * _STEP + hashed[at + k])
        value[at] = whole
    value = value[np.arange(len(hashed)) - np.repeat(begin, words) < np.repeat(count, words)]
    ends = np.concatenate([[0], np.cumsum(count)])
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if j - i > 1:
            value[i:j].sort()
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    new[ends[:-1][count > 0]] = True
    return value[new], np.concatenate([[0], np.cumsum(new)])[ends]


def shingle_sets(texts: list[str] | pa.Array) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted uint64."""
    if not isinstance(texts, pa.Array):
        texts = pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary())
    value, at = shingles(texts)
    return [value[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def of_each(operation: np.ufunc, value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """operation over each text's values; 0 for none."""
    out, some = np.zeros(len(at) - 1, value.dtype), at[1:] > at[:-1]
    if some.any():
        out[some] = operation.reduceat(value, at[:-1][some])
    return out


def fingerprints(mixed: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each text's mixed shingles."""
    return of_each(np.add, mixed, at), of_each(np.add, mix(mixed ^ _MIX2), at)


def signature(s: np.ndarray) -> bytes:
    """Parity bitmap of a power of two of bits, BITS_A_SHINGLE * n or more."""
    size = max(64, 1 << (BITS_A_SHINGLE * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def signatures_of(value: np.ndarray, at: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """signature and folded of every text's shingles."""
    n = np.diff(at)
    size = np.maximum(64, 1 << np.frexp(BITS_A_SHINGLE * n - 1.0)[1].astype(np.int64))
    whole: list[bytes] = []
    short: list[bytes] = []
    ends = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(n):  # some WORDS_AT_ONCE bits at a time
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + WORDS_AT_ONCE, "right")) - 1)
        s, k = value[at[lo] : at[hi]], n[lo:hi]
        bit = (s >> np.uint64(20)).astype(np.int64) & np.repeat(size[lo:hi] - 1, k)
        bits = np.zeros(int(ends[hi] - ends[lo]), np.uint8)
        np.add.at(bits, bit + np.repeat(ends[lo:hi] - ends[lo], k), np.uint8(1))
        packed = np.packbits(bits & 1)
        where = (ends[lo : hi + 1] - ends[lo]) // 8
        data = packed.tobytes()
        own = [data[i:j] for i, j in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
        whole += own
        large = np.flatnonzero(np.diff(where) > FOLDED)
        if len(large):
            own = list(own)
            rows = packed.reshape(-1, 8)[np.repeat(np.diff(where) > FOLDED, np.diff(where) // 8)].reshape(-1, FOLDED)
            tall = np.diff(where)[large] // FOLDED
            for i, row in zip(large.tolist(), np.bitwise_xor.reduceat(rows, np.cumsum(tall) - tall, axis=0), strict=True):
                own[i] = row.tobytes()
        short += own
        lo = hi
    return whole, short


def needed(n1, n2):
    """Least overlap of linked sets: ceil(75 / 175 * (n1 + n2))."""
    return -(-LINK_PARTS * (n1 + n2) // (LINK_PARTS + UNION_PARTS))


def may_link(n1: int, bits1: bytes, n2: int, bits2: bytes) -> bool:
    """Whether the signatures leave enough overlap. The longer one is folded onto the shorter."""
    a, b = np.frombuffer(bits1, np.uint8), np.frombuffer(bits2, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    differ = int(np.bitwise_count(a ^ b).sum())
    return (n1 + n2 - differ) // 2 >= needed(n1, n2)


def folded(bits: bytes) -> bytes:
    """A signature XOR-folded to FOLDED bytes at most: a parity bitmap of fewer bits."""
    if len(bits) <= FOLDED:
        return bits
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, FOLDED), axis=0).tobytes()


def may_link_all(n1: np.ndarray, bits1: list[bytes], n2: np.ndarray, bits2: list[bytes]) -> np.ndarray:
    """may_link for many pairs: those of equal signature lengths go together."""
    out = np.zeros(len(n1), bool)
    shape = np.array([(len(x), len(y)) for x, y in zip(bits1, bits2, strict=True)]).reshape(-1, 2)
    for la, lb in np.unique(shape, axis=0).tolist():
        mine, short = np.flatnonzero((shape[:, 0] == la) & (shape[:, 1] == lb)), min(la, lb)
        for k in range(0, len(mine), step := max(1, WORDS_AT_ONCE // max(la, lb))):
            part = mine[k : k + step]
            x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join([bits[i] for i in part]), np.uint8).reshape(len(part), -1, short), axis=1) for bits in (bits1, bits2))
            differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            out[part] = (n1[part] + n2[part] - differ) // 2 >= needed(n1[part], n2[part])
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted arrays link: each item of the shorter one is looked up in the other."""
    if len(a) > len(b):
        a, b = b, a
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0
    return UNION_PARTS * common >= LINK_PARTS * (len(a) + len(b) - common)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def facts_of(docs: DataFrame) -> DataFrame:
    """Written: a row per document (n to bits), and rows with recurring shingles and counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def recurring() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            kept = counts >= RECURS
            columns = [pa.nulls(int(kept.sum()), f.type) for f in _FACTS][:8]
            return pa.RecordBatch.from_arrays([*columns, pa.array(values[kept].view(np.int64)), pa.array(counts[kept])], schema=_FACTS)

        for batch in slices(batches, limit=TEXT_BYTES):
            value, at = shingles(batch.column("text"))
            mixed = mix(value + _STEP)
            columns = [*fingerprints(mixed, at), of_each(np.minimum, value, at), of_each(np.minimum, mixed, at)]
            columns = [pa.array(c.view(np.int64)) for c in columns]
            bits = [pa.array(b, pa.binary()) for b in signatures_of(value, at)]
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at).astype(np.int32)), *columns, *bits, none, none], schema=_FACTS)
            held.append(value)
            size += len(value)
            if size >= COUNTED:
                yield recurring()
                held, size = [], 0
        if held:
            yield recurring()

    return cut(_rows(docs).mapInArrow(scan, FACTS), "ngram-facts")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_BYTES):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "s"])

    return keep_ids(_rows(docs), ids).mapInArrow(make, "doc_id long, s binary")


def release(spark, *paths: str) -> None:
    """Drop written steps that are no longer needed, and the shuffles behind them."""
    remove(spark, *paths)
    gc.collect()
    spark._jvm.System.gc()


def verify(docs: DataFrame, signatures: DataFrame, pairs: DataFrame) -> DataFrame:
    """Written: those of the (written) pairs (a, b) that link."""
    spark = docs.sparkSession

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "b1"), "b2"):
            n1, n2 = (batch.column(c).to_numpy().astype(np.int64) for c in ("n1", "n2"))
            kept = may_link_all(n1, batch.column("b1").to_pylist(), n2, batch.column("b2").to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "s1"), "s2"):
            kept = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column("s1"), batch.column("s2"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    signatures = keep_ids(signatures, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    left = signatures.select(F.col("doc_id").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("b1"))
    right = signatures.select(F.col("doc_id").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("b2"))
    folder = shared_dir(spark, "ngram-candidates")
    pairs.join(left, "a").join(right, "b").mapInArrow(bounded, "a long, b long").distinct().write.parquet(f"{folder}/pairs")
    close = spark.read.schema("a long, b long").parquet(f"{folder}/pairs")
    ids = close.select(F.col("a").alias("doc_id")).union(close.select("b")).distinct()
    sets_of(docs, ids).write.parquet(f"{folder}/sets")
    sets = spark.read.schema("doc_id long, s binary").parquet(f"{folder}/sets")
    both = close.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("s1")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("s2")), "b")
    found = cut(both.mapInArrow(exact, "a long, b long").distinct(), "ngram-links")
    release(spark, folder)
    return found


def leader_pairs(classes: DataFrame, n_classes: int) -> DataFrame:
    """Each set with the leader of the sets of its size band that share a minimum, two ways.
    Leaders of many sets (at most HOT_SHARE of each kind) are broadcast to them."""
    scale = F.log(F.col("n").cast("double")) / float(np.log(4 / 3))
    key, found, hot = ["m", "band"], [], F.col("k") > max(HOT_ROWS, n_classes // HOT_SHARE)
    for minimum, shift in (("m1", 0.0), ("m2", 0.5)):
        keyed = classes.where("n > 0").select(F.col("rep").alias("a"), F.col(minimum).alias("m"), F.floor(scale + shift).alias("band"))
        leaders = cut(keyed.groupBy(*key).agg(F.min("a").alias("b"), F.count("*").alias("k")).where("k > 1"), "ngram-leaders")
        often = F.broadcast(leaders.where(hot))
        found.append(keyed.join(often, key).select("a", "b"))
        found.append(keyed.join(often, key, "left_anti").join(leaders.where(~hot), key).select("a", "b"))
    pairs = found[0].union(found[1]).union(found[2]).union(found[3])
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Whole runs of equal keys of sorted batches, some `least` rows of them at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        stop = np.zeros(whole.num_rows - 1, bool)
        for k in keys:
            v = whole.column(k).to_numpy()
            stop |= v[1:] != v[:-1]
        last = np.flatnonzero(stop)
        if len(last):
            yield whole.slice(0, int(last[-1]) + 1)
            held = whole.slice(int(last[-1]) + 1).to_batches()
            rows = sum(b.num_rows for b in held)
        else:
            held = whole.to_batches()
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def postings(docs: DataFrame, frequent: np.ndarray, total: int) -> DataFrame:
    """Written: (shingle, doc_id, n, pos) of prefix shingles that two or more rows share.

    A task emits equal sets once, as far as it remembers them. Frequent shingles stand last in
    the order.
    """
    spark = docs.sparkSession
    last = spark.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        maybe = np.zeros(1 << 22, bool)  # whether a shingle with these last bits is frequent
        maybe[(last.value & np.uint64(len(maybe) - 1)).astype(np.int64)] = True
        for batch in slices(batches, limit=TEXT_BYTES):
            value, at = shingles(batch.column("text"))
            n = np.diff(at)
            kept = (n > 0) & np.asarray(batch.column("doc_id").is_valid())
            marks = list(zip(*(h.tolist() for h in fingerprints(mix(value + _STEP), at)), strict=True))
            for k in np.flatnonzero(kept).tolist():
                if marks[k] in seen:
                    kept[k] = False
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(marks[k])
            if not kept.any():
                continue
            late = np.zeros(len(value), bool)
            if len(last.value):
                hits = np.flatnonzero(maybe[(value & np.uint64(len(maybe) - 1)).astype(np.int64)])
                found = np.minimum(np.searchsorted(last.value, value[hits]), len(last.value) - 1)
                late[hits] = last.value[found] == value[hits]
            early = np.concatenate([[0], np.cumsum(~late)])
            before = early[:-1] - np.repeat(early[at[:-1]], n)  # of its set, not frequent
            pos = np.where(late, np.repeat(np.diff(early[at]), n) + np.arange(len(value)) - np.repeat(at[:-1], n) - before, before)
            taken = np.flatnonzero(pos < np.repeat(np.where(kept, n - (3 * n + 3) // 4 + 1, 0), n))
            doc = np.repeat(np.arange(len(n)), n)[taken]
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[taken].view(np.int64)), batch.column("doc_id").take(pa.array(doc)), pa.array(n[doc].astype(np.int32)), pa.array(pos[taken].astype(np.int32))],
                ["shingle", "doc_id", "n", "pos"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, held = None, None  # a run may go on in the next batch: its last row waits
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("shingle").to_numpy()
            same = key[1:] == key[:-1]
            kept = np.zeros(len(key), bool)
            kept[1:] |= same
            kept[:-1] |= same
            if last_key is not None:
                if key[0] == last_key[0]:
                    kept[0] = True
                if key[0] == last_key[0] or last_key[1]:
                    yield held
            last_key, held = (key[-1], bool(kept[-1])), batch.slice(batch.num_rows - 1)
            kept[-1] = False
            yield batch.filter(pa.array(kept))
        if held is not None and last_key[1]:
            yield held

    columns = "shingle long, doc_id long, n int, pos int"
    dealt = _rows(docs).mapInArrow(emit, columns).repartition(parts(spark, total // 4), "shingle").sortWithinPartitions("shingle")
    return cut(dealt.mapInArrow(shared, columns), "ngram-postings")


class Signatures:
    """The signatures of a batch's rows, where they have any. Their lengths are powers of two of 8
    bytes or more, and sizes that may link are less than a factor of two apart: of two lengths
    the longer is folded onto the shorter."""

    def __init__(self, bits: pa.Array):
        _, offsets, data = bits.buffers()
        at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(bits.type) else np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
        self.size = np.diff(at) // 8
        self.words = np.frombuffer(data, np.uint64, int(at[-1] - at[0]) // 8, int(at[0])) if at[-1] > at[0] else np.empty(0, np.uint64)
        self.at = (at[:-1] - at[0]) // 8

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Set bits of each pair's XOR: at most the number of shingles that only one has. 0 for
        rows without signatures."""
        out = np.zeros(len(x), np.int64)
        swap = self.size[x] > self.size[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        short, twice = self.size[x], self.size[y] > self.size[x]
        for size in (np.flatnonzero(np.bincount(short)[1:]) + 1).tolist():
            reach = np.arange(size)
            for fold in (False, True):
                mine = np.flatnonzero((short == size) & (twice == fold))
                step = max(1, WORDS_AT_ONCE // 8 // size)
                for k in range(0, len(mine), step):
                    part = mine[k : k + step]
                    other = self.at[y[part]][:, None] + reach
                    both = self.words[self.at[x[part]][:, None] + reach] ^ self.words[other]
                    if fold:
                        both ^= self.words[other + size]
                    out[part] = np.bitwise_count(both).sum(1, dtype=np.int64)
        return out


def tiles_of(lists: DataFrame, components_of: DataFrame, signatures: DataFrame, one_each: bool, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The postings of tiles that hold two components or more, as rows of (shingle, i, j, side,
    doc_id, n, pos, component, bits), and the shingles whose tiles one_each does not settle.
    only: the shingles to take, if not all.

    A tile is settled if each component has one row there, so that none is left out, and if its
    candidates are too few for a forest: all of them are verified then.

    one_each: one document stands for each component of a tile. i, j number the pair of blocks of
    a large tile; side tells whose block it is (0: i, 1: j; other tiles are one block, i = j = 0).
    """
    spark = lists.sparkSession
    named = cut(lists.join(components_of, "doc_id"), "ngram-named")
    rows = named.count()
    if one_each:
        first = F.min(F.struct("n", "doc_id", "pos")).alias("r")
        named = named.groupBy("shingle", "component").agg(first, F.count("*").alias("alike")).select("shingle", "component", "r.*", "alike")
    else:
        named = named.withColumn("alike", F.lit(1))
    dealt = named.repartition(parts(spark, rows), "shingle")
    if only is not None:
        dealt = dealt.join(only.hint("merge"), "shingle", "left_semi")
    tile = Window.partitionBy("shingle")
    counted = dealt.withColumns({"lo": F.min("component").over(tile), "hi": F.max("component").over(tile), "m": F.count("*").over(tile), "most": F.max("alike").over(tile)}).where("lo != hi")
    open_ = (F.col("most") > 1) | (F.col("m") > 2 * PAIRS_A_ROW + 1)  # m rows have m (m - 1) / 2 pairs
    mixed = cut(counted.select("shingle", "component", "n", "doc_id", "pos", "m", open_.alias("open")), "ngram-mixed")
    unsettled = mixed.where("open").select("shingle").distinct()
    mixed = mixed.drop("open")
    none = F.lit(None).cast("binary").alias("bits")
    small = mixed.where(F.col("m") < LARGE).select("*", none)
    large = mixed.where(F.col("m") >= LARGE).join(signatures.select("doc_id", F.col("folded").alias("bits")), "doc_id").select(*mixed.columns, "bits")
    plain = small.unionByName(large.where(F.col("m") <= BLOCK)).withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)})
    place = F.row_number().over(Window.partitionBy("shingle").orderBy("n", "doc_id", "pos")) - 1
    blocked = large.where(F.col("m") > BLOCK).withColumns({"_b": F.floor(place / BLOCK).cast("int"), "_n": F.floor((F.col("m") - 1) / BLOCK).cast("int")})
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("_n")), lambda k: F.struct(F.least(k, F.col("_b")).alias("i"), F.greatest(k, F.col("_b")).alias("j"), (k < F.col("_b")).cast("int").alias("side"))))
    blocked = blocked.withColumn("p", pair).select(*large.columns, "p.*")
    return plain.unionByName(blocked).drop("m"), unsettled


def forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Which edges (x, y) make a forest of greatest weight over n nodes: each round, every tree
    takes the heaviest edge that leaves it."""
    order = np.argsort(weight, kind="stable")
    left, kept, tree = order, np.zeros(len(x), bool), np.arange(n)
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x))
    while True:
        left = left[tree[x[left]] != tree[y[left]]]
        if not len(left):
            return np.flatnonzero(kept)
        best = np.full((2, n), -1)
        best[0, tree[x[left]]] = rank[left]  # ascending: the last, heaviest one stays
        best[1, tree[y[left]]] = rank[left]
        best = best.max(0)
        trees = np.flatnonzero(best >= 0)
        edge = order[best[trees]]
        kept[edge] = True
        ends = np.stack([tree[x[edge]], tree[y[edge]]])
        to = np.where(ends[0] == trees, ends[1], ends[0])
        parent = np.arange(n)
        parent[trees] = to
        both = trees[(parent[to] == trees) & (trees < to)]
        parent[both] = both  # two trees that chose each other: the smaller is the root
        while not np.array_equal(parent, hop := parent[parent]):
            parent = hop
        tree = parent[tree]


def tile_pairs(tiles: DataFrame, rows: int, forests: bool = False) -> DataFrame:
    """Candidates (a, b) of the tiles. A pair is a candidate if the components differ, sizes and
    the shingle's positions allow a link (it lies in the prefixes that two sets of these sizes
    need, and leaves room for enough more) and, where rows carry them, the signatures do.

    forests: of a tile with more candidates than PAIRS_A_ROW for each row, only a forest of the
    likeliest that connects all others do: as many as rows. It merges components; what it leaves
    apart is for a later call without it.
    """

    def fitting(n1, p1, comp1, n2, p2, comp2) -> np.ndarray:
        least = needed(n1, n2)
        fits = (UNION_PARTS * np.minimum(n1, n2) >= LINK_PARTS * np.maximum(n1, n2)) & (comp1 != comp2)
        fits &= (p1 <= n1 - least) & (p2 <= n2 - least)
        return fits & (np.minimum(n1 - p1, n2 - p2) + np.minimum(p1, p2) >= least)

    def close(n: np.ndarray, bits: Signatures | None, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows x, y whose signatures leave room for a link, and their likeness."""
        differ = bits.differ(x, y) if bits is not None and len(x) else np.zeros(len(x), np.int64)
        kept = (n[x] + n[y] - differ) // 2 >= needed(n[x], n[y])
        x, y, differ = x[kept], y[kept], differ[kept]
        return x, y, 1 - differ / (n[x] + n[y])

    def together(t: dict[str, np.ndarray], bits: Signatures | None, lo: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The candidates, or forests of them, of the tiles of m rows from lo on, all at once."""
        n, pos, comp, doc = t["n"], t["pos"], t["component"], t["doc_id"]
        xs, ys, tiles = [], [], []
        for k in np.unique(m).tolist():
            of = np.flatnonzero(m == k)
            u, v = np.triu_indices(k, 1)
            xs.append((lo[of][:, None] + u).ravel())
            ys.append((lo[of][:, None] + v).ravel())
            tiles.append(np.repeat(of, len(u)))
        x, y, tile = (np.concatenate(c) for c in (xs, ys, tiles))
        fits = fitting(n[x], pos[x], comp[x], n[y], pos[y], comp[y])
        of_row = np.zeros(len(n), np.int64)
        of_row[x] = tile
        x, y, weight = close(n, bits, x[fits], y[fits])
        if forests:
            many = np.bincount(of_row[x], minlength=len(m)) > PAIRS_A_ROW * m
            kept = ~many[of_row[x]]
            for k in np.flatnonzero(many).tolist():
                mine = np.flatnonzero(of_row[x] == k)
                node = np.unique(comp[lo[k] : lo[k] + m[k]], return_inverse=True)[1]
                kept[mine[forest(node[x[mine] - lo[k]], node[y[mine] - lo[k]], weight[mine], int(m[k]))]] = True
            x, y = x[kept], y[kept]
        return np.stack([np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])], 1)

    def within(t: dict[str, np.ndarray], bits: Signatures | None, lo: int, mid: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Candidates (rows x, rows y, likeness) between rows lo to mid and mid to hi, or, without a
        second block (mid = hi), among rows lo to hi; both sorted by size."""
        n, pos, comp = t["n"], t["pos"], t["component"]
        alone = mid == hi
        for i in range(lo, mid, TILE):
            i2 = min(i + TILE, mid)
            for j in range(i if alone else mid, hi, TILE):
                j2 = min(j + TILE, hi)
                if UNION_PARTS * n[i2 - 1] < LINK_PARTS * n[j]:
                    break
                if UNION_PARTS * n[j2 - 1] < LINK_PARTS * n[i]:
                    continue
                fits = fitting(n[i:i2, None], pos[i:i2, None], comp[i:i2, None], n[None, j:j2], pos[None, j:j2], comp[None, j:j2])
                if alone and i == j:
                    fits &= np.arange(i, i2)[:, None] < np.arange(j, j2)[None]
                x, y = np.nonzero(fits)
                x, y, weight = close(n, bits, x + i, y + j)
                if len(x):
                    yield x, y, weight

    def chosen(t: dict[str, np.ndarray], bits: Signatures | None, lo: int, mid: int, hi: int) -> Iterator[np.ndarray]:
        """The candidates, or a forest of them, as they come; edges over components."""
        doc = t["doc_id"]
        named = lambda x, y: np.stack([np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])], 1)
        if not forests:
            yield from (named(x, y) for x, y, _ in within(t, bits, lo, mid, hi))
            return
        held, node = [], None
        for some in within(t, bits, lo, mid, hi):
            held.append(some)
            if sum(len(x) for x, _, _ in held) > PAIRS_A_ROW * (hi - lo):
                if node is None:
                    node = np.unique(t["component"][lo:hi], return_inverse=True)[1]
                x, y, weight = (np.concatenate(c) for c in zip(*held, strict=True))
                kept = forest(node[x - lo], node[y - lo], weight, hi - lo)
                held = [(x[kept], y[kept], weight[kept])]
        yield from (named(x, y) for x, y, _ in held)

    def once(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        size = 0
        for whole in runs_of(batches, ["shingle", "i", "j"], least=20_000):
            t = {c: whole.column(c).to_numpy().astype(np.int64) for c in ("shingle", "i", "j", "side", "doc_id", "n", "pos", "component")}
            bits = Signatures(pa.concat_arrays(whole.column("bits").chunks)) if whole.column("bits").null_count < whole.num_rows else None
            new = np.zeros(whole.num_rows, bool)
            new[0] = True
            for k in ("shingle", "i", "j"):
                new[1:] |= t[k][1:] != t[k][:-1]
            starts = np.flatnonzero(new)
            ends = np.concatenate([starts[1:], [whole.num_rows]])
            small = (ends - starts <= min(SMALL, TILE)) & (t["side"][ends - 1] == 0)
            if small.any():
                found.append(together(t, bits, starts[small], (ends - starts)[small]))
                size += len(found[-1])
            for lo, hi in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
                for some in chosen(t, bits, lo, lo + int(np.searchsorted(t["side"][lo:hi], 1)), hi):
                    found.append(some)
                    size += len(some)
                    if size > 300_000:
                        yield once(found)
                        found, size = [], 0
        if found:
            yield once(found)

    key = ["shingle", "i", "j"]
    dealt = tiles.repartition(parts(tiles.sparkSession, rows), *key).sortWithinPartitions(*key, "side", "n", "doc_id")
    return dealt.mapInArrow(pairs, "a long, b long").where("a != b").distinct()


def label(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with column component: their doc_id's, or the doc_id itself."""
    named = found.select(F.col("node").alias("doc_id"), "component")
    return rows.join(named, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of every row.

    Null and empty texts and texts without words have no shingles, link with nothing and are
    their own component. Rows that repeat an id are one node with the links of all their texts,
    and keep a row each. Rows without an id link with nothing and have no component. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    facts = facts_of(docs)
    rows = facts.where("n is not null").select("doc_id", "n", "h1", "h2", "m1", "m2", "bits", "folded")
    some = rows.where("n > 0 and doc_id is not null")
    total = some.agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT_FROM, total // FREQUENT)
    often = facts.where("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("count")).where(F.col("count") >= least)
    frequent = np.sort(often.select("shingle").toArrow().column(0).to_numpy().view(np.uint64))
    key = ["n", "h1", "h2"]
    classes = cut(some.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("m1").alias("m1"), F.first("m2").alias("m2")), "ngram-classes")
    equal = some.select("doc_id", *key).join(classes.select("rep", *key), key).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    signatures = some.select("doc_id", "n", "bits")
    tested = cut(leader_pairs(classes, classes.count()), "ngram-pairs")
    edges = equal.union(verify(docs, signatures, tested))
    found = components(edges)
    lists = postings(docs, frequent, total)
    short = some.select("doc_id", "folded")
    release(spark)
    unsettled = None
    for one_each in (True, False):
        rows_of, unsettled = tiles_of(lists, label(some.select("doc_id").distinct(), found), short, one_each, unsettled)
        tiles = cut(rows_of, "ngram-tiles")
        pairs = cut(tile_pairs(tiles, tiles.count(), forests=one_each).join(tested, ["a", "b"], "left_anti"), "ngram-pairs")
        more, tested = verify(docs, signatures, pairs), tested.union(pairs)
        known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = components(known.union(more))
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"))
    return label(out, found).withColumnRenamed("component", "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id; rows without an id stay."""
    gone = cut(ngram_components(docs).where("doc_id != component_id").select("doc_id").distinct(), "ngram-gone")
    return keep_ids(docs, gone, anti=True)

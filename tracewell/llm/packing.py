"""Packing token pieces into fixed-size sequences through a configuration linear program.

The lengths' histogram (at most `capacity` numbers) is all the planner sees. The covering
program "how often to use each way of filling a sequence" is solved by multiplicative weights:
a length whose coverage runs ahead loses weight, lengths that lag start the new fillings, and an
unbounded knapsack over the weights prices what goes with them. The solution, scaled to SHARE, is
rounded to whole sequences; the rest, which so keeps all lengths in about their proportions, is
placed best-fit in decreasing length. On the documents' histogram the program places 85 to 89 %
of the pieces below the capacity, and needs fewer sequences than best-fit alone (a test holds
both). Pieces then find their place by their rank among pieces of the same length, so no task
ever holds a sequence's pieces or all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, text_of
from .tokens import encoder

#: Coverage that one filling may add to a length, fillings priced at a time, rounds at most.
STEP, COLUMNS, ROUNDS = 0.02, 64, 1200
#: How fast a weight falls with a coverage ahead of the mean (in units of length, at most 1, so
#: that a filling without room beats one with room), and the share of the program that is used.
FALL, SHARE = 2.0, 0.9
#: Rows of (task, length) counts up to which they are broadcast (24 bytes each).
BROADCAST_COUNTS = 400_000
RANKS = 1 << 40
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c] and the item last put in (-1: one unit stays free) for every capacity c."""
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            total = best[c - sizes[:k]] + values[:k]
            j = int(total.argmax())
            if total[j] > best[c]:
                best[c], item[c] = total[j], j
    return best, item


def fill(sizes: np.ndarray, item: np.ndarray, room: int, first: int) -> tuple[tuple[int, int], ...]:
    """The best filling that holds item `first`, as (item, copies)."""
    used, room = Counter([first]), room - int(sizes[first])
    while room > 0:
        j = int(item[room])
        if j < 0:
            room -= 1
        else:
            used[j] += 1
            room -= int(sizes[j])
    return tuple(sorted(used.items()))


def fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> dict[tuple[tuple[int, int], ...], float]:
    """How often to use each filling, by multiplicative weights.

    Weights start from the lengths themselves, the dual solution of a program whose sequences
    can all be full. Of the lengths over a third of the capacity (they decide how many sequences
    there are; without any, of all) those that lag start the fillings. Fillings with room are
    taken only where there are no others before SHARE is covered. A length that is wholly covered
    leaves the program.
    """
    covered, plan, slack, volume = np.zeros(len(sizes)), defaultdict(float), 0, sizes * demand
    for _ in range(ROUNDS):
        live, mean = np.flatnonzero(covered < 1 - 1e-6), float(np.average(covered, weights=volume))
        if not len(live):
            break
        held = sizes[live]
        _, item = knapsack(held, held - np.clip(FALL * (covered[live] - mean), -1, 1), capacity)
        order = np.lexsort((-held, covered[live]))
        large = order[held[order] > capacity // 3]
        found: dict[tuple, None] = {}
        for j in large if len(large) else order:
            filling = fill(held, item, capacity, int(j))
            if capacity - sum(int(held[k]) * n for k, n in filling) <= slack:
                found[tuple((int(live[k]), n) for k, n in filling)] = None
            if len(found) == COLUMNS:
                break
        before = len(plan), covered.sum()
        for filling in found:
            times = min(min(STEP, 1 - covered[j]) * demand[j] / n for j, n in filling)
            if times > 0:
                plan[filling] += times
                for j, n in filling:
                    covered[j] += n * times / demand[j]
        if covered.sum() - before[1] < 1e-9:
            slack = max(1, 2 * slack)
            if mean >= SHARE or slack > capacity:
                break
    return plan


def rounded(plan: dict[tuple[tuple[int, int], ...], float], rest: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Whole numbers of each filling: fractions add up from filling to filling, the most used
    first, and no length is placed oftener than `rest` has it. Takes them off `rest`."""
    done, carry = [], 0.5
    for filling, share in sorted(plan.items(), key=lambda x: (-x[1], x[0])):
        carry += share
        times = min(int(carry), *(int(rest[j]) // n for j, n in filling))
        carry -= int(carry)
        if times > 0:
            done.append((filling, times))
            for j, n in filling:
                rest[j] -= n * times
    return done


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over whole runs of equal pieces and equal sequences."""
    by_room: dict[int, Counter] = defaultdict(Counter)
    rooms = np.zeros(capacity + 1, bool)
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            fit = np.flatnonzero(rooms[n:])
            if len(fit):
                room = n + int(fit[0])
                filling, times = by_room[room].popitem()
                if times > count:
                    by_room[room][filling] = times - count
                rooms[room] = bool(by_room[room])
            else:
                filling, times, room = (), -(-count // (capacity // n)), capacity
            copies = min(count // times or 1, room // n)
            times = min(times, count)
            filling, room = (*filling, (n, copies)), room - n * copies
            by_room[room][filling] += times
            rooms[room] = True
            count -= times * copies
    merged = Counter()
    for group in by_room.values():
        for filling, times in group.items():
            total = Counter()
            for n, copies in filling:
                total[n] += copies
            merged[tuple(sorted(total.items()))] += times
    return sorted(merged.items())


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((length, copies), ...), sequences)] that holds every piece of the histogram exactly.

    The program's rounded fillings come first, best-fit's for the rest follow.
    """
    placed, left = planned(histogram, capacity)
    return placed + best_fit(left, capacity)


def planned(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], dict[int, int]]:
    """The part of the plan that the program makes, and the histogram of what it leaves."""
    left = {n: c for n, c in histogram.items() if c > 0}
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []
    if full := left.pop(capacity, 0):
        done.append((((capacity, 1),), full))
    if left:
        sizes = np.array(sorted(left))
        rest = np.array([left[n] for n in sizes])
        solved = {f: SHARE * t for f, t in fractional(sizes, rest.astype(float), capacity).items()}
        for filling, times in rounded(solved, rest):
            done.append((tuple((int(sizes[j]), n) for j, n in filling), times))
        left = {int(n): int(c) for n, c in zip(sizes, rest, strict=True) if c}
    return done, left


def places(planned: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: first rank, first sequence, copies a sequence, offset."""
    runs, taken, sequence = [], Counter(), 0
    for filling, times in planned:
        offset = 0
        for length, copies in filling:
            runs.append((length * RANKS + taken[length], sequence, copies, offset, length))
            taken[length] += copies * times
            offset += length * copies
        sequence += times
    runs.sort()
    return {k: np.array(c, np.int64) for k, c in zip(("key", "sequence", "copies", "offset", "length"), zip(*runs, strict=True), strict=True)}


def ranks(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each piece's rank among those of its length, counting on from `seen`, which moves on."""
    order = np.argsort(length, kind="stable")
    held = length[order]
    first = np.searchsorted(held, held)
    out = np.empty(len(length), np.int64)
    out[order] = seen[held] + np.arange(len(held)) - first
    seen += np.bincount(length, minlength=len(seen))
    return out


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece, with its rank among its task's pieces of the same length. Written."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen, tail = np.zeros(capacity + 1, np.int64), np.array([end_id], "<u4").tobytes()
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        names = [f.split()[0] for f in PIECES.split(", ")]
        for batch in slices(batches):
            counts, length, check = [], [], []
            for text in batch.column("text"):
                data = memoryview(enc.encode_one(text.as_py()) + tail)
                n = len(data) // 4
                first = (n - 1) % capacity + 1
                ends = [first, *range(first + capacity, n + 1, capacity)]
                counts.append(len(ends))
                length += [first] + [capacity] * (len(ends) - 1)
                check += [zlib.crc32(data[max(0, e - capacity) * 4 if e > first else 0 : e * 4]) for e in ends]
            counts, length = np.array(counts), np.array(length)
            first = np.repeat(np.cumsum(counts) - counts, counts)
            before = np.concatenate([[0], np.cumsum(length)])
            doc = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            columns = [doc, np.arange(len(first)) - first, before[:-1] - before[first], length, np.array(check), np.full(len(first), part), ranks(length, seen)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return cut(rows.mapInArrow(pieces, PIECES), "pieces")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document (null text: empty) ends with end_id, so none is without tokens. Documents
    over the capacity are cut so that all pieces but the first fill a sequence. Repeated rows
    are packed as often as they occur; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = cut_pieces(docs, tokenizer, end_id, capacity)
    counts = cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    few = counts.count() <= BROADCAST_COUNTS
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    if not histogram:
        return spark.createDataFrame([], out)
    find = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = find.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(c), dtype=np.int64) for c in ("length", "rank"))
            at = np.searchsorted(p["key"], length * RANKS + rank, "right") - 1
            k = length * RANKS + rank - p["key"][at]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(p["sequence"][at] + k // p["copies"][at]), pa.array(p["offset"][at] + k % p["copies"][at] * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # Pieces are a twentieth of the texts' bytes: beyond the bound they move, not the counts.
    ranked = pieces.join(F.broadcast(bases) if few else bases.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("part", "base")
    return ranked.mapInArrow(place, out)

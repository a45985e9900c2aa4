"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text are computed with numpy over its bytes and words. Trees are grown
on the driver from a bounded sample of labelled documents (binned features, gradient sums by
bincount) and flattened into arrays, which tasks traverse for all documents of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, keep_ids, slices, text_of, unboxed, worker_cache

#: Labelled documents that the trees are grown on, at most about this many.
TRAIN_DOCUMENTS = 12_000
TREES, LEAVES_DEPTH, BINS, RATE, LEAST_HESSIAN, SMOOTH = 60, 4, 64, 0.2, 2.0, 1.0
THRESHOLD = 0.3

_LETTER, _UPPER, _DIGIT, _SPACE, _LINE, _MARK, _HIGH = (1 << i for i in range(7))


def _classes() -> np.ndarray:
    c = np.full(256, _MARK, np.uint8)
    c[128:] = _LETTER | _HIGH
    for lo, hi, v in ((65, 90, _LETTER | _UPPER), (97, 122, _LETTER), (48, 57, _DIGIT), (0, 32, _SPACE)):
        c[lo : hi + 1] = v
    c[10] = _SPACE | _LINE
    return c


CLASSES = _classes()
FEATURES = (
    "log_bytes", "log_words", "letters", "upper", "digits", "marks", "high", "spaces", "lines",
    "word_length", "word_length_spread", "distinct", "top_word", "repeats_last", "odd_end", "capital_words",
    "long_words", "run_share", "line_repeats", "bars", "shouts", "stops", "distinct_bytes", "entropy",
)


def features(texts: list[str]) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    worker_cache("quality")
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        if not data:
            continue
        b = np.frombuffer(data, np.uint8)
        n, counts = len(b), np.bincount(b, minlength=256)
        share = [counts[(CLASSES & v) > 0].sum() / n for v in (_LETTER, _UPPER, _DIGIT, _MARK, _HIGH, _SPACE, _LINE)]
        p = counts[counts > 0] / n
        row = [np.log1p(n), np.log1p(len(words)), *share]
        if words:
            m = len(words)
            lengths = np.fromiter(map(len, words), np.int32, m)
            seen: dict[bytes, int] = {}
            for w in words:
                seen[w] = seen.get(w, 0) + 1
            last = sum(map(bytes.__eq__, words[1:], words[:-1]))
            ends = CLASSES[np.fromiter((w[-1] for w in words), np.uint8, m)]
            first = CLASSES[np.fromiter((w[0] for w in words), np.uint8, m)]
            row += [lengths.mean(), lengths.std(), len(seen) / m, max(seen.values()) / m, last / m, ((ends & _MARK) > 0).mean(), ((first & _UPPER) > 0).mean(), (lengths > 20).mean()]
        else:
            row += [0] * 8
        lines = data.split(b"\n")
        row += [(b[1:] == b[:-1]).mean() if n > 1 else 0, 1 - len(set(lines)) / len(lines), counts[124] / n, counts[33] / n, counts[46] / n, len(p) / 256, -(p * np.log2(p)).sum()]
        out[i] = row
    return out


@dataclass
class Trees:
    """Complete trees in arrays: node k of a tree has children 2k+1 and 2k+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cuts, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(LEAVES_DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cuts[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for labels y in {0, 1}; without rows, or with one label only, a constant score."""
    inner = 2**LEAVES_DEPTH - 1
    p = (y.sum() + 1) / (len(y) + 2)
    feature, cuts, value = (np.zeros((TREES, k), t) for k, t in ((inner, np.int64), (inner, np.float64), (inner + 1, np.float64)))
    base = float(np.log(p / (1 - p)))
    if len(set(y.tolist())) < 2:
        return Trees(feature, cuts + np.inf, value, base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="nearest")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    flat = binned + np.arange(x.shape[1]) * BINS
    total = np.full(len(y), base)
    for t in range(TREES):
        score = 1 / (1 + np.exp(-total))
        g, h = y - score, score * (1 - score)
        node = np.zeros(len(y), np.int64)
        for depth in range(LEAVES_DEPTH):
            first, width = 2**depth - 1, x.shape[1] * BINS
            key = ((node - first)[:, None] * width + flat).ravel()
            size = (2**depth) * width
            gs, hs = (np.bincount(key, np.repeat(v, x.shape[1]), size).reshape(-1, x.shape[1], BINS) for v in (g, h))
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + SMOOTH) + (gt - gl) ** 2 / (ht - hl + SMOOTH) - gt**2 / (ht + SMOOTH)
            gain[(hl < LEAST_HESSIAN) | (ht - hl < LEAST_HESSIAN)] = 0
            best = gain.reshape(len(gain), -1).argmax(1)
            for k, at in enumerate(best):
                f, b = divmod(int(at), BINS)
                split = gain[k, f, b] > 0 and b < len(edges[f])
                feature[t, first + k], cuts[t, first + k] = f, edges[f][b] if split else np.inf
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cuts[t, node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value[t] = RATE * gs / (hs + SMOOTH)
        total += value[t, leaf]
    return Trees(feature, cuts, value, base)


def remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def train(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCUMENTS) -> Trees:
    """Grow trees on at most about `sample` labelled documents whose crc32 mod 5 is not 0.

    The sample is a seeded hash share of the labelled ids, so it is the same in every run.
    Only quality and doc_id of labels are read; doc_id joins and splits, and is no input.
    """
    given = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder(5) != 0))
    given = given.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    share = min(1.0, sample / max(1, given.count()))
    given = given.where(F.xxhash64("doc_id", F.lit(6)) / F.lit(2.0**64) + 0.5 < share)
    known = {r.doc_id: r.quality for r in given.collect()}
    texts = keep_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), given.select(F.col("doc_id").cast("long").alias("doc_id")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "x"])

    got = sorted((r.doc_id, r.x) for r in texts.mapInArrow(rows, "doc_id long, x array<float>").collect())
    x = np.array([v for _, v in got], np.float32).reshape(len(got), len(FEATURES))
    return grow(x, np.array([known[k] for k, _ in got], np.float64))


def with_score(docs: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """docs with a double column `name`: the chance that a text is good.

    Null counts as empty; equal texts score alike; repeated rows stay; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = slices([pa.RecordBatch.from_arrays([texts], ["text"])])
            scored = [sent.value.score(features(r.column("text").to_pylist()).astype(np.float64)) for r in rows]
            yield pa.array(np.concatenate(scored) if scored else [], pa.float64())

    return docs.withColumn(name, score(text_of()))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts get the score of an all-zero row; repeated rows and ties are scored
    alike; an empty table gives no rows; labels without a quality or a document are ignored.
    """
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return scored.select("doc_id", (F.coalesce(remainder(5) == 0, F.lit(False))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score THRESHOLD or more, with all their columns."""
    return unboxed(with_score(boxed(docs, "text"), train(docs, labels)).where(F.col("score") >= THRESHOLD))

"""Language identification with language-bitmask n-gram filters.

All languages share one bit-sliced Bloom filter: position k of the table holds a word with one
bit per language, and an n-gram sets its language's bit at each of its hash positions. One
lookup (the AND over the positions) therefore returns every language that holds the n-gram.
A text's n-grams are looked up in bulk; each language's hits are corrected by its filter's
false-positive rate, and the language with the most corrected hits wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, text_of
from .quality import remainder

#: Training documents of a language, at most about this many, chosen by a seeded hash.
TRAIN_DOCUMENTS = 1500
#: N-gram length in bytes, n-grams kept for a language, table positions, hashes.
N, GRAMS, POSITIONS, HASHES = 4, 12_000, 1 << 18, 2
#: An n-gram joins a language where its rate is at least this share of its highest rate.
RATE_SHARE = 0.25
#: Languages up to which their shares are broadcast (some 50 bytes each).
BROADCAST_LANGUAGES = 10_000
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77)  # fixed values: odd hash multipliers
UNKNOWN = "und"
#: Bytes that part words: everything ASCII that is not a letter becomes a space.
LETTERS_ONLY = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_SPACES = re.compile(rb" +")


def grams(text: str) -> np.ndarray:
    """The text's byte n-grams inside and across words, as 32-bit numbers."""
    data = b" " + _SPACES.sub(b" ", text.lower().encode("utf-8", "surrogatepass").translate(LETTERS_ONLY)).strip() + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < N:
        return np.empty(0, np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


def positions(values: np.ndarray) -> list[np.ndarray]:
    shift = np.uint32(32 - (POSITIONS.bit_length() - 1))
    mixed = values ^ (values >> np.uint32(15))
    return [(mixed * np.uint32(m)) >> shift for m in MULTIPLIERS[:HASHES]]


@dataclass
class Languages:
    names: list[str]
    table: np.ndarray  # positions x words, 64 languages a word
    false_rate: np.ndarray

    def hits(self, values: np.ndarray) -> np.ndarray:
        """For each language the n-grams found, less the false ones expected."""
        first, *others = positions(values)
        found = self.table[first]
        for p in others:
            found = found & self.table[p]
        counts = []
        for k in range(len(self.names)):
            counts.append(np.count_nonzero(found[:, k // 64] & np.uint64(1 << k % 64)))
        return np.maximum(0.0, (np.array(counts) - len(values) * self.false_rate) / (1 - self.false_rate))

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        hits = self.hits(grams(text))
        best = int(hits.argmax())
        total = hits.sum()
        return self.names[best], float(hits[best] / total) if total else 1 / len(self.names)


def build(sets: dict[str, np.ndarray]) -> Languages:
    names = sorted(sets)
    table = np.zeros((POSITIONS, max(1, -(-len(names) // 64))), np.uint64)
    for k, name in enumerate(names):
        for p in positions(sets[name].astype(np.uint32)):
            table[p, k // 64] |= np.uint64(1 << k % 64)
    fill = np.array([np.count_nonzero(table[:, k // 64] & np.uint64(1 << k % 64)) for k in range(len(names))]) / POSITIONS
    return Languages(names, table, fill**HASHES)


def train(docs: DataFrame, per_language: int = TRAIN_DOCUMENTS) -> Languages:
    """Filters from text and lang of documents whose crc32 mod 4 is not 2.

    Each language gives about per_language documents at most, chosen by a seeded hash of the id,
    and its GRAMS most frequent n-grams, so the driver's share does not grow with the corpus.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(remainder(4) != 2, F.lit(True)))
    shares = [(r.lang, min(1.0, per_language / r.n)) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not shares:
        return build({})
    # The shares go to the rows: a language may hold a third of them, and texts need not move.
    listed = spark.createDataFrame(shares, "lang string, share double")
    listed = F.broadcast(listed) if len(shares) <= BROADCAST_LANGUAGES else listed
    sample = known.select("doc_id", "lang", text_of().alias("text")).join(listed, "lang").where(F.xxhash64("doc_id", F.lit(9)) / F.lit(2.0**64) + 0.5 < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, rows in held.items():
                values, n = np.unique(np.concatenate(rows), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

        size = 0
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, []).append(grams(text))
                size += len(held[lang][-1])
            if size > 8_000_000:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    rated = counts.withColumn("rate", rate).withColumn("top", F.max("rate").over(Window.partitionBy("gram")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "gram"))
    kept = rated.where(F.col("rate") >= RATE_SHARE * F.col("top")).withColumn("k", rank).where(F.col("k") <= GRAMS)
    sets: dict[str, list[int]] = {lang: [] for lang, _ in shares}
    for r in kept.select("lang", "gram").collect():
        sets[r.lang].append(r.gram)
    return build({k: np.array(v, np.int64) for k, v in sets.items()})


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """docs' ids with lang_pred and score; null texts and texts without a letter are `und`, 0.

    Of languages with equal hits the first in code-point order wins. Repeated rows get a row each
    and equal answers, null ids stay null, an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sent.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    score is the winner's share of all languages' corrected hits. Repeated rows and ties get
    equal answers (the first language in code-point order wins a tie); a table without known
    languages gives `und` throughout; an empty table gives no rows.
    """
    return identify(docs, train(docs))

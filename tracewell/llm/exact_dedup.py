"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a bucketed table sorted by digest. A batch of documents is digested once, grouped
by digest with map-side aggregation, and met with the index in one sort-merge join: groups
without a partner are what the anti-join leaves, and their digests are appended. Appending is the
last step and carries the batch's name, so a batch that died, or is sent again, decides as it did
the first time. A hot group of copies costs one row per task after the partial aggregate, and
its decision is broadcast to its rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, cut, fold_case, keep_ids, parts, text_of, unboxed

INDEX_SCHEMA = "digest binary, keep_id long, n_rows long, batch string"
#: A group of this many rows, and of more than a HOT_SHARE-th of all rows, is hot: there are fewer
#: than HOT_SHARE such groups, so their decisions (some 60 bytes each) are broadcast.
HOT_ROWS, HOT_SHARE = 1000, 5000
#: Digests for a bucket, batches after which the buckets are written anew.
BUCKET_DIGESTS, BATCHES = 2_000_000, 16


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row (tells repeated rows apart) and the SHA-256 of the A-Z-folded UTF-8 text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(fold_case(text_of()).cast("binary"), 256)).alias("digest"),
    )


class DigestIndex:
    """A persistent set of digests: a bucketed, sorted table in the warehouse.

    The table is a generation, `name_gN`; `compact` writes the next one and drops the last, so
    buckets hold one sorted file again and their number follows the index's size.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self._buckets = spark, name, buckets
        if not self._generations():
            self._create(0, spark.createDataFrame([], INDEX_SCHEMA), 0)

    def _generations(self) -> list[int]:
        found = self.spark.catalog.listTables(pattern=f"{self.name}_g*")
        return sorted(int(t.name.rsplit("_g", 1)[1]) for t in found)

    def table(self) -> str:
        return f"{self.name}_g{self._generations()[-1]}"

    def _create(self, generation: int, rows: DataFrame, n: int) -> None:
        buckets = self._buckets or parts(self.spark, n, BUCKET_DIGESTS)
        self._write(rows, f"{self.name}_g{generation}", buckets, "error")

    @staticmethod
    def _write(rows: DataFrame, table: str, buckets: int, mode: str) -> None:
        # repartition() deals rows as bucketBy() does, so each task writes one bucket file.
        rows.repartition(buckets, "digest").write.bucketBy(buckets, "digest").sortBy("digest").mode(mode).saveAsTable(table)

    def append(self, rows: DataFrame) -> None:
        table = self.table()
        described = {r.col_name: r.data_type for r in self.spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
        self._write(rows, table, int(described["Num Buckets"]), "append")

    def read(self) -> DataFrame:
        return self.spark.table(self.table())

    def compact(self) -> None:
        """Write the next generation. It is in the catalogue only once it is whole; older ones are
        dropped then. Batches are not taken in at the same time."""
        old = self._generations()
        now = self.read().groupBy("digest").agg(F.min_by(F.struct("keep_id", "n_rows", "batch"), "batch").alias("r"))
        self._create(old[-1] + 1, now.select("digest", "r.*"), self.read().count())
        for g in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_g{g}")

    def drop(self) -> None:
        for g in self._generations():
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_g{g}")

    def ingest(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Decide on every row of a batch and append the unseen digests.

        Returns doc_id, row, digest, keep_id, group_size, kept: group_size counts the batch's
        rows with that digest, keep_id is the row that stays. Within a batch the largest doc_id
        stays (null ids last; of repeated rows, one); a digest that an earlier batch brought
        keeps that batch's row, so the whole new group goes. `batch` names the batch: the same
        rows under the same name get the same decisions again and add nothing. Null text counts
        as empty; an empty batch gives no rows; other columns are ignored.
        """
        batch = batch or uuid.uuid4().hex[:12]
        rows = cut(digests(docs), "digests")
        groups = cut(
            rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("n_rows")),
            "digest-groups",
        )
        known = self.read().select("digest", F.col("keep_id").alias("known_id"), F.col("batch").alias("known_batch"))
        absent = F.col("known_batch").isNull()
        fresh = absent | (F.col("known_batch") == batch)
        decided = cut(
            groups.hint("merge").join(known, "digest", "left").select(
                "digest", "n_rows", F.when(fresh, F.col("best.row")).alias("best_row"),
                F.when(absent, F.col("best.doc_id")).otherwise(F.col("known_id")).alias("keep_id"), absent.alias("absent")),
            "digest-decisions",
        )
        self.append(decided.where("absent").select("digest", "keep_id", "n_rows", F.lit(batch).alias("batch")))
        if self.read().select(F.approx_count_distinct("batch")).first()[0] > BATCHES and not self._buckets:
            self.compact()
        total = groups.agg(F.sum("n_rows")).first()[0] or 0
        hot = F.col("n_rows") > max(HOT_ROWS, total // HOT_SHARE)
        often = decided.where(hot)
        if often.isEmpty():
            met = rows.join(decided, "digest")
        else:
            rare = rows.join(F.broadcast(often.select("digest")), "digest", "left_anti").join(decided.where(~hot), "digest")
            met = rare.unionByName(rows.join(F.broadcast(often), "digest"))
        return met.select("doc_id", "row", "digest", "keep_id", F.col("n_rows").alias("group_size"), F.coalesce(F.col("row") == F.col("best_row"), F.lit(False)).alias("kept"))


def index_name(spark: SparkSession) -> str:
    return f"digest_index_{uuid.uuid4().hex[:12]}"


def decisions(docs: DataFrame, index: str | None, batch: str | None) -> DataFrame:
    """Decisions against the named index, or against one of their own that goes again: they are
    written before it does."""
    held = DigestIndex(docs.sparkSession, index or index_name(docs.sparkSession))
    out = held.ingest(docs, batch)
    if index is None:
        held.drop()
    return out


def dedup_report(docs: DataFrame, index: str | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (see `ingest`)."""
    out = decisions(docs, index, batch)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, index: str | None = None, batch: str | None = None) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows without a duplicate never move: ids all of whose rows go are joined back and removed.
    Only ids with rows of both kinds, and rows without an id, are matched by id and digest, and
    one of equal ones stays. Null texts count as empty; an empty table gives an empty one.
    """
    decided = cut(decisions(docs, index, batch), "dedup-decided")
    gone = decided.where(~F.col("kept"))
    stay = decided.where("kept").select("doc_id", "digest")
    mixed = cut(stay.join(gone.select("doc_id"), "doc_id", "left_semi").select("doc_id").distinct(), "dedup-mixed")
    ids = gone.where("doc_id is not null").select("doc_id").distinct()
    out = keep_ids(docs, ids, anti=True)
    unnamed = not gone.where("doc_id is null").isEmpty()
    if mixed.isEmpty() and not unnamed:
        return out
    if unnamed:
        out = out.where("doc_id is not null")
    part = docs.join(mixed, "doc_id", "left_semi")
    part = part.unionByName(docs.where("doc_id is null")) if unnamed else part
    digest = F.unhex(F.sha2(fold_case(text_of()).cast("binary"), 256)).alias("_digest")
    part = boxed(part, F.col("doc_id").cast("long").alias("_id"), digest)
    held = part.join(stay, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest")), "left_semi")
    return out.unionByName(unboxed(held.dropDuplicates(["_id", "_digest"])))

"""Size-tiered compaction of immutable shards under versioned manifests (DataFrame operations only).

An append writes the arrival as it comes, without a shuffle, and commits a manifest that adds
its files. Compaction sorts the live shards below the target size into tiers by size (each tier
`fanout` times the one before) and merges runs of neighbours: a run's files are read by one
task and written as one file, so rows move from file to file and never through a shuffle, and
every row is rewritten once per tier at most. A merge becomes visible only when the next
manifest version lists its output instead of its inputs.

A manifest holds what its version adds and removes, and every CHECKPOINT-th one the whole list,
so that a commit's size is that of its change. A version is taken by renaming its file into place
without overwriting, which is the only claim: a writer that dies before it leaves nothing that
blocks others, one that loses it looks at the new version and tries again. (The rename is atomic
on HDFS; a store without such a rename needs a committer of its own.) Readers of a version keep
its files until `vacuum`, which spares young files too: they may belong to a commit under way.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import hadoop_path, shared_dir, text_of

#: Production sizes: files are merged up to TARGET bytes, FANOUT of a tier at a time.
TARGET, FANOUT, SMALLEST = 128 << 20, 4, 1 << 20
#: Runs that one job's plan holds, jobs at a time, waves that a table's files are taken in.
RUNS_PER_JOB, JOBS, WAVES = 64, 8, 4
#: Versions between full manifests, tries to commit, seconds that unlisted files are spared.
CHECKPOINT, TRIES, SPARED = 16, 20, 7 * 86_400


@dataclass(frozen=True)
class Shard:
    path: str
    size: int


class Conflict(RuntimeError):
    """Another writer committed the version first; reload and try again."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target, fanout

    # -- manifests

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:010d}.json"

    def version(self) -> int:
        """The newest committed version; 0 where nothing is committed."""
        fs, folder = hadoop_path(self.spark, f"{self.root}/manifests")
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def _load(self, version: int) -> dict:
        fs, path = hadoop_path(self.spark, self._manifest(version))
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> tuple[StructType | None, list[Shard]]:
        """The schema and the shards of a version: the last full manifest and what changed since."""
        version = self.version() if version is None else version
        if not version:
            return None, []
        changes = []
        for v in range(version, 0, -1):
            changes.append(self._load(v))
            if "shards" in changes[-1]:
                break
        live = {s["path"]: s for s in changes[-1].get("shards", [])}
        for change in reversed(changes):
            for s in change["add"]:
                live[s["path"]] = s
            for path in change["remove"]:
                live.pop(path, None)
        return StructType.fromJson(changes[0]["schema"]), [Shard(**s) for s in live.values()]

    def _take(self, version: int, content: dict) -> bool:
        """Put a version's manifest into place; False where another writer has."""
        jvm = self.spark._jvm
        fs, final = hadoop_path(self.spark, self._manifest(version))
        _, draft = hadoop_path(self.spark, f"{self.root}/manifests/draft-{uuid.uuid4().hex}")
        fs.mkdirs(final.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        never = self.spark.sparkContext._gateway.new_array(rename, 1)
        never[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), never)
        except Exception as failed:
            fs.delete(draft, False)
            if fs.exists(final):
                return False
            raise failed
        return True

    def _commit(self, schema: StructType, add: list[Shard], remove: list[Shard] = ()) -> int:
        """Commit a change on top of the newest version. Conflict where a shard to be removed is
        no longer live, or the schema is another."""
        for _ in range(TRIES):
            base = self.version()
            held, live = self.manifest(base)
            if held is not None and [(f.name, f.dataType) for f in held] != [(f.name, f.dataType) for f in schema]:
                raise ValueError("the arrival's columns differ from the store's")
            if not {s.path for s in remove} <= {s.path for s in live}:
                raise Conflict("another writer has merged these shards")
            content = {"schema": (held or schema).jsonValue(), "add": [asdict(s) for s in add], "remove": [s.path for s in remove]}
            if (base + 1) % CHECKPOINT == 0:
                content["shards"] = [asdict(s) for s in live]
            if self._take(base + 1, content):
                return base + 1
        raise Conflict(f"no version to be had in {TRIES} tries")

    # -- data

    def _write(self, df: DataFrame) -> list[Shard]:
        folder = f"{self.root}/data/{uuid.uuid4().hex[:12]}"
        df.write.parquet(folder)
        fs, path = hadoop_path(self.spark, folder)
        return [Shard(f"{folder}/{s.getPath().getName()}", int(s.getLen())) for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet")]

    def append(self, df: DataFrame) -> int:
        """Add an arrival as it is partitioned, as new shards; returns the committed version."""
        schema, _ = self.manifest()
        if schema is not None and [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError("the arrival's columns differ from the store's")
        return self._commit(schema or df.schema, self._write(df))

    def read(self, version: int | None = None) -> DataFrame:
        schema, live = self.manifest(version)
        if schema is None:
            raise ValueError("nothing is committed yet")
        if not live:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(s.path for s in live))

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / SMALLEST, self.fanout)) + 1)

    def runs(self, live: list[Shard]) -> list[list[Shard]]:
        """Runs of `fanout` or more similarly sized shards; each fills about the target at most."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(live, key=lambda s: (s.size, s.path)):
            if s.size < self.target // 2:
                tiers.setdefault(self.tier(s.size), []).append(s)
        found = []
        for shards in tiers.values():
            run: list[Shard] = []
            for s in shards:
                if len(run) >= 2 and sum(x.size for x in run) + s.size > self.target:
                    found.append(run)
                    run = []
                run.append(s)
            if len(run) >= self.fanout:
                found.append(run)
        return found

    def compact(self) -> int:
        """Merge until no tier holds `fanout` shards; returns the number of merged shards.

        A pass merges all runs of all tiers, in jobs of RUNS_PER_JOB tasks that run JOBS at a
        time, and commits one version.
        """
        merged = 0
        while True:
            schema, live = self.manifest()
            todo = self.runs(live)
            if not todo:
                return merged

            def merge(runs: list[list[Shard]], schema: StructType = schema) -> list[Shard]:
                whole = None
                for run in runs:
                    one = self.spark.read.schema(schema).parquet(*(s.path for s in run)).coalesce(1)
                    whole = one if whole is None else whole.union(one)
                return self._write(whole)

            jobs = [todo[k : k + RUNS_PER_JOB] for k in range(0, len(todo), RUNS_PER_JOB)]
            with ThreadPoolExecutor(JOBS) as pool:
                made = list(pool.map(inheritable_thread_target(self.spark)(merge), jobs))
            gone = [s for run in todo for s in run]
            self._commit(schema, [s for m in made for s in m], gone)
            merged += len(gone)

    def vacuum(self, versions: int = 1, spared: float = SPARED) -> int:
        """Delete data files that none of the newest `versions` manifests lists, unless they were
        written within the last `spared` seconds (a commit under way may list them yet)."""
        newest = self.version()
        listed = {s.path.split("/data/")[-1] for v in range(max(1, newest - versions + 1), newest + 1) for s in self.manifest(v)[1]}
        before, gone = (time.time() - spared) * 1000, 0
        fs, folder = hadoop_path(self.spark, f"{self.root}/data")
        for d in fs.listStatus(folder) if fs.exists(folder) else []:
            for f in fs.listStatus(d.getPath()):
                name = f.getPath().getName()
                if name.endswith(".parquet") and f"{d.getPath().getName()}/{name}" not in listed and f.getModificationTime() <= before:
                    gone += fs.delete(f.getPath(), False)
        return gone


def file_waves(spark: SparkSession, path: str, waves: int = WAVES) -> list[DataFrame]:
    """The Parquet files under path, dealt into at most `waves` arrivals; each file is in one."""
    docs = spark.read.parquet(path)
    files = sorted(docs.inputFiles())
    if not files:
        return [docs]
    each = -(-len(files) // waves)
    return [spark.read.schema(docs.schema).parquet(*files[k : k + each]) for k in range(0, len(files), each)]


def shard_report(*arrivals: DataFrame) -> DataFrame:
    """Take arrivals in as small shards, compact them and return every row from the manifest.

    doc_id, lang, source, n_chars (null where the arrivals have no such column), n_bytes and
    text_sha256 (null text: empty). Rows come from the arrivals as they are, whatever their plan;
    repeated rows stay repeated, an empty table gives no rows, other columns are kept in the
    store but not reported. The store is this call's own, so its replaced files go at once.
    """
    spark = arrivals[0].sparkSession
    store = ShardStore(spark, shared_dir(spark, "shards"))
    for arrival in arrivals:
        store.append(arrival)
        store.compact()
        store.vacuum(spared=0)
    rows = store.read()
    plain = [F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    return rows.select(*plain, F.octet_length(text_of()).cast("long").alias("n_bytes"), F.sha2(text_of().cast("binary"), 256).alias("text_sha256"))

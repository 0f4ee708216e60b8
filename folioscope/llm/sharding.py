"""Size-tiered shard store [native].

Arrivals are appended as small immutable parquet shards. Compaction merges
shards of similar size (the same tier: powers of ``fan_in`` above ``base_bytes``)
into files of about ``target_bytes``; a shard of half the target or more is full
and never rewritten, so a row is rewritten at most once per tier. A version of
the table is a manifest file that lists its shards; it appears by one rename
that fails if another writer took the number first. HDFS, local file systems and
stores with a hierarchical namespace rename in one step; plain object stores do
not, and need a commit service in place of `FileStore.publish`.

No step shuffles: an append writes the partitions it is given, and a merge reads
small shards and coalesces them. Only file names and sizes reach the driver.
`vacuum` removes what no kept version lists, also what appends, merges and drafts
left behind that died before their commit, once it is older than any that runs.

Defined cases: nulls, repeated rows, ties, very long texts and any column names
are stored as they are (the store adds no column); an empty arrival commits
nothing; an empty store reads as an empty table of the first schema that was
appended or given, and without one as a table without columns.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import FileStore, unused

#: Versions that stay readable, and hours after which an uncommitted file is left over.
KEEP, LEFT_OVER_HOURS = 2, 24.0


class CommitConflict(RuntimeError):
    """Another writer changed what this commit builds on."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: StructType | None = None, target_bytes: int = 128 << 20, base_bytes: int = 1 << 20, fan_in: int = 4):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target_bytes, self.base_bytes, self.fan_in = target_bytes, base_bytes, fan_in
        self.files = FileStore(spark, self.root)

    # -- versions ---------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(p.rsplit("/", 1)[1][:-5]) for p, _ in self.files.list("manifests") if p.endswith(".json") and "/." not in p]

    def manifest(self, version: int | None = None) -> dict:
        """Version 0 is the empty table."""
        found = self.versions()
        version = (found[-1] if found else 0) if version is None else version
        if not version:
            return {"version": 0, "shards": [], "schema": self.schema.jsonValue() if self.schema else None}
        return json.loads(self.files.read(f"manifests/{version:012d}.json"))

    def _commit(self, base: dict, removed: set[str], added: list[dict], schema: StructType, attempts: int = 20) -> dict:
        """Add and remove shards in one step, on top of whatever was committed meanwhile."""
        for _ in range(attempts):
            here = {s["path"] for s in base["shards"]}
            if not removed <= here:
                raise CommitConflict("merged shards are no longer in the table")
            new = {"version": base["version"] + 1, "schema": schema.jsonValue(), "shards": [s for s in base["shards"] if s["path"] not in removed] + added}
            draft = f"manifests/.draft-{uuid.uuid4().hex}"
            self.files.write(draft, json.dumps(new))
            if self.files.publish(draft, f"manifests/{new['version']:012d}.json"):
                return new
            self.files.delete(draft)
            base = self.manifest()
        raise CommitConflict("too many concurrent commits")

    # -- writing ----------------------------------------------------------

    def tier(self, size: int) -> int | None:
        """None: a full shard."""
        if 2 * size >= self.target_bytes:
            return None
        return max(0, math.floor(math.log(max(size, 1) / self.base_bytes, self.fan_in)) + 1)

    def _written(self, df: DataFrame) -> list[dict]:
        run = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{run}")
        return [{"path": path, "bytes": size} for path, size in self.files.list(run) if path.rsplit("/", 1)[1].startswith("part-")]

    def append(self, arrival: DataFrame) -> dict:
        """Store one arrival as immutable shards, one per partition of it."""
        if self.schema is None:
            known = self.manifest()["schema"]
            self.schema = StructType.fromJson(known) if known else arrival.schema
        shards = self._written(arrival)
        if not shards:
            return self.manifest()
        return self._commit(self.manifest(), set(), shards, self.schema)

    def plan(self) -> list[list[dict]]:
        """Groups of similarly sized shards that are due for a merge."""
        tiers = defaultdict(list)
        for shard in self.manifest()["shards"]:
            tiers[self.tier(shard["bytes"])].append(shard)
        tiers.pop(None, None)
        return [group for _, group in sorted(tiers.items()) if len(group) >= self.fan_in]

    def compact(self) -> int:
        """Merge until no tier has fan_in shards. The number of merges."""
        merges = 0
        while groups := self.plan():
            group = groups[0]
            total = sum(s["bytes"] for s in group)
            files = max(1, min(math.ceil(total / self.target_bytes), len(group) // 2))
            source = self._read(group)
            added = self._written(source.coalesce(files))
            before = source.count()
            after = self._read(added).count() if added else 0
            if before != after:
                raise RuntimeError(f"a merge of {before} rows wrote {after}")
            self._commit(self.manifest(), {s["path"] for s in group}, added, self.schema or StructType.fromJson(self.manifest()["schema"]))
            merges += 1
        return merges

    def vacuum(self, keep: int = KEEP, left_over_hours: float = LEFT_OVER_HOURS) -> int:
        """Delete the files that none of the newest ``keep`` versions lists, and older manifests. The number of shards deleted.

        Files that no version lists may belong to a write that runs, so they go only when they are old.
        """
        found = self.versions()
        live = {s["path"] for v in found[-keep:] for s in self.manifest(v)["shards"]}
        known = {s["path"] for v in found for s in self.manifest(v)["shards"]}
        before = (time.time() - 3600 * left_over_hours) * 1000
        lost = [path for path, changed in self.files.below("data") if path not in known and changed < before]
        lost += [path for path, changed in self.files.below("manifests") if "/.draft-" in path and changed < before]
        for path in sorted(known - live) + lost:
            self.files.delete(path)
        for version in found[:-keep]:
            self.files.delete(f"manifests/{version:012d}.json")
        return len(known - live)

    # -- reading ----------------------------------------------------------

    def _read(self, shards: list[dict]) -> DataFrame:
        known = self.schema or self.manifest()["schema"] or StructType()
        schema = known if isinstance(known, StructType) else StructType.fromJson(known)
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s["path"] for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version)["shards"])


def ingest(table: DataFrame, root: str, arrivals: int = 8, **options) -> ShardStore:
    """Store a table as ``arrivals`` successive arrivals, compacting after each.

    One pass lays the table out by arrival; then each is appended as it would come.
    Old shards go as soon as a merge is committed, but for those of the version before.
    """
    store = ShardStore(table.sparkSession, root, schema=table.schema, **options)
    name = unused(table, "arrival")
    table.withColumn(name, F.monotonically_increasing_id() % arrivals).write.partitionBy(name).parquet(f"{store.root}/landing")
    for k in range(arrivals):
        path = f"landing/{name}={k}"
        if store.files.below(path):
            _arrive(store, table.sparkSession.read.schema(table.schema).parquet(f"{store.root}/{path}"))
            store.files.delete(path)
    store.files.delete("landing")
    return store


def ingest_files(spark: SparkSession, files: list[str], schema: StructType, root: str, arrivals: int = 8, **options) -> ShardStore:
    """The same for parquet files that are there already: they arrive in name order."""
    store = ShardStore(spark, root, schema=schema, **options)
    size = max(1, math.ceil(len(files) / arrivals))
    for k in range(0, len(files), size):
        _arrive(store, spark.read.schema(schema).parquet(*sorted(files)[k : k + size]))
    return store


def _arrive(store: ShardStore, rows: DataFrame) -> None:
    store.append(rows)
    if store.compact():
        store.vacuum()

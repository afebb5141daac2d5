"""Sharded storage with size-tiered compaction and a versioned manifest.

A store is a folder on shared storage. An append writes arrivals as small immutable Parquet shards, one for each writing
task. Compaction looks at shards in tiers (each FANIN times as large as the one below): a tier of FANIN shards or more is
merged into files of about the target size, so a row is rewritten at most once per tier. Nothing is changed in place:
a commit writes the next manifest, which lists the live shards, under a temporary name and renames it to its version;
the rename fails if that version exists, so of two writers one commits and the other starts again from the new version.
Readers take one manifest and see exactly its shards. Files that no manifest lists (a lost attempt) are never read;
vacuum() removes them, and old versions, once they are older than a limit.

Manifests are layered: an append's lists only the shards that it adds; that of a compaction, and every FULL_EVERY-th, lists
all. So an append reads one header and writes its own shards' lines, however many shards there are; a reader goes back to the last
full manifest. Files grow with the store: beyond MOST_SHARDS files of the target size, the target is the volume's share.

The manifest keeps the schema of every shard. A version is read with the union of its shards' columns, so no file decides
which columns there are; an append whose column has another type than before is refused before it is written.

The manifest, sizes and row counts (from the files' footers) are all that the driver holds: one short line for each shard,
none for rows. Merging coalesces the tier's own splits, so no row is shuffled.

Defined cases: an append without rows commits a version without new shards (files without rows are not listed); nulls,
repeated rows and extra columns are stored as they are; columns that a shard lacks read as null, before and after
compaction; names that differ in case alone are one column; a store without shards reads as an error.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.storage import CommitConflict, Versions

TARGET_BYTES, FANIN = 64 << 20, 4
#: Versions from one full manifest to the next; files that a store of any volume aims at, at most.
FULL_EVERY, MOST_SHARDS = 32, 100_000


class SchemaConflict(ValueError):
    """A column has another type than in the shards that are there."""


@dataclass(frozen=True)
class Shard:
    path: str
    n_bytes: int
    n_rows: int
    schema: str


def union_type(a: T.DataType, b: T.DataType, name: str = "") -> T.DataType:
    """A type that holds both: fields of structs are united, everything else must be equal."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name.lower(): f for f in a}
        for f in b:
            own = fields.get(f.name.lower())
            fields[f.name.lower()] = f if own is None else T.StructField(own.name, union_type(own.dataType, f.dataType, own.name))
        return T.StructType([T.StructField(f.name, f.dataType) for f in fields.values()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(union_type(a.elementType, b.elementType, name))
    if a != b:
        raise SchemaConflict(f"{name}: {a.simpleString()} and {b.simpleString()}")
    return a


def union_schema(schemas: Iterable[str]) -> T.StructType:
    """The union of schemas in JSON."""
    distinct = dict.fromkeys(schemas)
    return reduce(union_type, (T.StructType.fromJson(json.loads(x)) for x in distinct), T.StructType())


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanin: int = FANIN):
        self.spark, self.root, self.target, self.fanin = spark, root.rstrip("/"), target_bytes, fanin
        self.manifests = Versions(spark, f"{self.root}/manifests")
        self._files, self._path = self.manifests.files, self.manifests.path

    def versions(self) -> list[int]:
        return self.manifests.all()

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.manifests.latest() if version is None else version
        live: dict[str, Shard] = {}
        if version:
            for v in range(self._header(version)["full"], version + 1):
                header, *lines = map(json.loads, self.manifests.read(v))
                for path in header["removed"]:
                    live.pop(path)
                live |= {path: Shard(path, n_bytes, n_rows, header["schemas"][schema]) for path, n_bytes, n_rows, schema in lines}
        return list(live.values())

    def _header(self, version: int) -> dict:
        """Of a manifest: the version of the full manifest that it builds on, all schemas so far, and the paths it removes."""
        return json.loads(self.manifests.first_line(version)) if version else {"full": 0, "schemas": [], "removed": []}

    def _commit(self, base: int, added: list[Shard], removed: Iterable[Shard] = (), whole: bool = False) -> int:
        """Makes version base + 1 of version base with some shards more and some less, or raises CommitConflict."""
        before, gone = self._header(base), {s.path for s in removed}
        full = before["full"]
        if whole or not base or base + 1 - full >= FULL_EVERY:
            full, added, gone = base + 1, [*[s for s in self.shards(base) if s.path not in gone], *added], set()
        schemas = list(dict.fromkeys([*before["schemas"], *[s.schema for s in added]]))
        lines = [{"full": full, "schemas": schemas, "removed": sorted(gone)}, *([s.path, s.n_bytes, s.n_rows, schemas.index(s.schema)] for s in added)]
        self.manifests.commit(base + 1, map(json.dumps, lines))
        return base + 1

    def _written(self, df: DataFrame) -> list[Shard]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        counted = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n"))
        n_rows, schema = dict(map(tuple, counted.collect())), df.schema.json()
        files = [(f.getPath(), f.getLen()) for f in self._files.listStatus(self._path(folder))]
        return [Shard(p.toString(), size, n_rows[p.getName()], schema) for p, size in files if p.getName() in n_rows]

    def append(self, df: DataFrame) -> int:
        """Stores df's rows as new small shards; returns the version that has them."""
        union_type(union_schema(self._header(self.manifests.latest())["schemas"]), df.schema)  # refused before it is written
        new = self._written(df)
        while True:
            base = self.manifests.latest()
            union_schema([*self._header(base)["schemas"], *[s.schema for s in new]])
            try:
                return self._commit(base, new)
            except CommitConflict:
                continue

    def tier(self, shard: Shard, target: int | None = None) -> int:
        """0 for shards of the target size or more; otherwise how many times FANIN they are below it."""
        n, size = 0, max(1, shard.n_bytes)
        while size < (target or self.target) * 3 // 4 and n < 16:
            size, n = size * self.fanin, n + 1
        return n

    def compact(self) -> int | None:
        """Merges every tier that has a run of FANIN shards or more; returns the new version, or None if no tier has."""
        base = self.manifests.latest()
        live = self.shards(base)
        target = max(self.target, sum(s.n_bytes for s in live) // MOST_SHARDS)
        tiers: dict[int, list[Shard]] = {}
        for shard in live:
            tiers.setdefault(self.tier(shard, target), []).append(shard)
        gone: set[Shard] = set()
        made: list[Shard] = []
        for n, run in sorted(tiers.items(), reverse=True):
            if n and len(run) >= self.fanin:
                files = max(1, ceil(sum(s.n_bytes for s in run) / target))
                made += self._written(self._rows(run).coalesce(files))
                gone |= set(run)
        if not made:
            return None
        return self._commit(base, made, gone, whole=True)

    def compact_fully(self) -> int:
        """Compacts until no tier has a run left, starting again after another writer's commit."""
        while True:
            try:
                if self.compact() is None:
                    return self.manifests.latest()
            except CommitConflict:
                continue

    def _rows(self, shards: list[Shard]) -> DataFrame:
        """The shards' rows with the union of their columns."""
        return self.spark.read.schema(union_schema(s.schema for s in shards)).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        shards = self.shards(version)
        if not shards:
            raise ValueError(f"{self.root} has no shards")
        return self._rows(shards)

    def vacuum(self, keep: int = 1, seconds: float = 7 * 86_400) -> int:
        """Removes all versions but the newest `keep` (and the manifests that those build on), then the files that no kept
        version lists; of both only what is older than `seconds`, since a writer may be about to commit it. Returns how many
        files it removed."""
        before = (time.time() - seconds) * 1000
        written = {v: self._files.getFileStatus(self._path(self.manifests.name(v))).getModificationTime() for v in self.versions()}
        kept = [v for v in written if written[v] >= before or v in self.versions()[-max(1, keep) :]]
        listed = {s.path for v in kept for s in self.shards(v)}
        needed = min((self._header(v)["full"] for v in kept), default=0)  # what kept versions build on stays, to be read with them
        for version in written:
            if version < needed:
                self._files.delete(self._path(self.manifests.name(version)), False)
        removed = 0
        for folder in self._files.listStatus(self._path(f"{self.root}/data")) if self.versions() else ():
            files = self._files.listStatus(folder.getPath())
            gone = [f for f in files if f.getPath().toString() not in listed and f.getModificationTime() < before]
            for f in gone:
                removed += self._files.delete(f.getPath(), False)
            if len(gone) == len(files) and folder.getModificationTime() < before:
                self._files.delete(folder.getPath(), True)
        return removed

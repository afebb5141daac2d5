"""A quad store: batches of Parquet files clustered by subject, predicate and object, with an index of the files, buffered
inserts, commits and real removal."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.quads import COLUMNS, SCHEMA, Graph, Part
from quadrille.storage import CommitConflict, Versions, checkpointed
from quadrille.terms import as_key

#: The clusterings of a batch: the leading column of each, with the columns that follow it.
CLUSTERS = {"s": ["s", "p", "o"], "p": ["p", "o", "s"], "o": ["o", "s", "p"]}
#: Quads of a file, about.
FILE_QUADS = 1_000_000
#: Quads that a task sorts, at least; it may write many files. The driver's sample for the ranges grows with the tasks.
TASK_QUADS = 200_000
#: The index's Bloom filters: bits for each distinct key of a file, hashes of a key, and bits of a page.
KEY_BITS, SEEDS, PAGE_BITS = 16, (1, 2), 1 << 15
_FILES = "cluster string, file string, least string, most string, n_quads bigint, pages bigint"
_BLOOMS = "file string, page bigint, bits binary"


def _place(key: Column, pages: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), pages * PAGE_BITS)


@dataclass(frozen=True)
class QuadStore:
    """Reads see what is stored and what is pending. `context` is the named graph that reads and writes are limited to.

    Every commit writes a new batch: inserted quads, or removed ones. A quad is present if its latest batch inserts it,
    so commits append files and never rewrite them; compact() writes the present quads as one batch. A manifest lists the
    batches of each version. It is committed by a rename that fails if the version exists: of two writers one commits, and
    the other writes its batch again under the next number. Readers see the batches of one manifest.

    A batch holds its quads three times, sorted by subject, by predicate and by object over files of about `file_quads`.
    Beside them stands an index: each file's least and greatest key and a Bloom filter of its keys. A read with a bound
    subject, object or predicate asks the index of each batch, as a Spark job over a row for each file, and opens only
    files that may hold the key; the sort within files lets Parquet skip row groups. A key with many quads, as a common
    predicate, has several files of its own.
    """

    spark: SparkSession
    path: str
    context: str | None = None
    pending: Graph | None = None
    removed: Graph | None = field(default=None)
    file_quads: int = FILE_QUADS

    @property
    def _versions(self) -> Versions:
        return Versions(self.spark, f"{self.path.rstrip('/')}/manifests")

    def versions(self) -> list[int]:
        return self._versions.all()

    def _batches(self, version: int) -> list[dict]:
        """What the manifest says of each batch: its name, whether it removes quads, and what streams have reached."""
        return [json.loads(line) for line in self._versions.read(version)] if version else []

    def _folder(self, batch: str) -> str:
        return f"{self.path.rstrip('/')}/data/batch={batch}"

    def files(self, s: Part = None, p: Part = None, o: Part = None, version: int | None = None) -> list[str]:
        """The files that a read with these parts opens: those of one clustering that may hold the key."""
        batches = self._batches(self._versions.latest() if version is None else version)
        cluster, part = next(((c, x) for c, x in (("s", s), ("o", o), ("p", p)) if x is not None), ("s", None))
        if not batches:
            return []
        index = self.spark.read.schema(_FILES).parquet(*[f"{self._folder(b['batch'])}/index/files" for b in batches])
        index = index.where(F.col("cluster") == cluster)
        if part is not None:
            key = F.lit(as_key(part))
            index = index.where((F.col("least") <= key) & (F.col("most") >= key))
            blooms = self.spark.read.schema(_BLOOMS).parquet(*[f"{self._folder(b['batch'])}/index/blooms" for b in batches])
            for i, seed in enumerate(SEEDS):
                place = _place(key, F.col("pages"), seed)
                asked = index.select("*", F.floor(place / PAGE_BITS).cast("long").alias("page"), (place % PAGE_BITS).cast("int").alias("bit"))
                byte = F.conv(F.hex(F.substr("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
                set_ = F.pmod(F.floor(byte / F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), F.col("bit") % 8 + 1)), F.lit(2)) == 1
                index = asked.join(blooms, ["file", "page"]).where(set_).select(*index.columns)
        return sorted(r["file"] for r in index.select("file").collect())

    def _log(self, s: Part, p: Part, o: Part, version: int) -> DataFrame | None:
        found = self.files(s, p, o, version)
        return self.spark.read.schema(f"{SCHEMA}, inserts boolean, number long").parquet(*found) if found else None

    def stored(self, s: Part = None, p: Part = None, o: Part = None, version: int | None = None) -> Graph:
        """The quads of a version (default: the newest) with these parts; only files that may hold them are opened."""
        version = self._versions.latest() if version is None else version
        log = self._log(s, p, o, version)
        if log is None:
            return Graph.empty(self.spark)
        bound = [F.col(c) == as_key(x) for c, x in (("s", s), ("p", p), ("o", o)) if x is not None]
        log = reduce(DataFrame.where, bound, log)
        batches = self._batches(version)
        if len(batches) > 1 or batches[0].get("removes"):
            log = log.groupBy(*COLUMNS).agg(F.max_by("inserts", "number").alias("present")).where("present")
        latest = log.select(*COLUMNS)
        return Graph(latest if self.context is None else latest.where(F.col("g") == self.context))

    def graph(self, s: Part = None, p: Part = None, o: Part = None) -> Graph:
        found = self.stored(s, p, o)
        found = found if self.removed is None else found - self.removed
        return found if self.pending is None else found | self.pending

    def get(self, s: Part = None, p: Part = None, o: Part = None) -> Graph:
        return self.graph(s, p, o).get(s, p, o)

    def has(self, s: Part = None, p: Part = None, o: Part = None) -> bool:
        return self.graph(s, p, o).has(s, p, o)

    def contains(self, s: Part, p: Part, o: Part) -> bool:
        return self.has(s, p, o)

    def _own(self, triples: Sequence[Sequence] | Graph) -> Graph:
        given = triples if isinstance(triples, Graph) else Graph.of(self.spark, triples)
        return given if self.context is None else Graph.from_triples(given.df, self.context)

    def add(self, *triples: Sequence, graph: Graph | None = None) -> QuadStore:
        new = self._own(graph or triples)
        return replace(self, pending=new if self.pending is None else self.pending | new, removed=self.removed and self.removed - new)

    def remove(self, *triples: Sequence, graph: Graph | None = None) -> QuadStore:
        gone = self._own(graph or triples)
        return replace(self, removed=gone if self.removed is None else self.removed | gone, pending=self.pending and self.pending - gone)

    def _write(self, rows: DataFrame, number: int) -> str:
        """A new batch of rows (g, s, p, o, inserts): three clusterings, then the index from what was written."""
        batch = uuid.uuid4().hex
        folder = self._folder(batch)
        staged = checkpointed(rows.withColumn("number", F.lit(number).cast("long")), "batch")
        ranges = -(-staged.count() // max(self.file_quads, TASK_QUADS)) or 1
        for cluster, order in CLUSTERS.items():
            ordered = staged.repartitionByRange(ranges, *order, "g").sortWithinPartitions(*order, "g")
            ordered.write.option("maxRecordsPerFile", self.file_quads if self.file_quads < TASK_QUADS else 0).parquet(f"{folder}/{cluster}")
        keys = [
            self.spark.read.schema(staged.schema).parquet(f"{folder}/{c}").select(F.lit(c).alias("cluster"), F.col("_metadata.file_path").alias("file"), F.col(c).alias("key")) for c in CLUSTERS
        ]
        every = reduce(DataFrame.union, keys)
        # A key's quads come together in its files, so its count of distinct keys is exact after the partial aggregation.
        counted = every.groupBy("cluster", "file", "key").agg(F.count("*").alias("n"))
        pages = F.ceil(F.count("*") * KEY_BITS / PAGE_BITS).cast("long").alias("pages")
        files = counted.groupBy("cluster", "file").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.sum("n").alias("n_quads"), pages)
        files.write.parquet(f"{folder}/index/files")  # a row for each file
        sized = self.spark.read.schema(_FILES).parquet(f"{folder}/index/files").select("file", "pages")
        placed = counted.join(F.broadcast(sized), "file").select("file", F.explode(F.array(*[_place(F.col("key"), F.col("pages"), s) for s in SEEDS])).alias("place"))
        pages = placed.groupBy("file", F.floor(F.col("place") / PAGE_BITS).cast("long").alias("page"))
        pages.agg(F.bitmap_construct_agg((F.col("place") % PAGE_BITS).cast("int")).alias("bits")).write.parquet(f"{folder}/index/blooms")
        return batch

    def commit(self, stream: str | None = None, epoch: int = 0) -> QuadStore:
        """Stores what is pending as one batch after all others. With the name of a stream and the number of its batch, the
        number is kept in the manifest, and a batch that is already there (a repeated one) commits nothing."""
        parts = [x.df.select(*COLUMNS, F.lit(inserts).alias("inserts")) for x, inserts in ((self.removed, False), (self.pending, True)) if x is not None]
        while parts:
            base = self._versions.latest()
            before = self._batches(base)
            if stream is not None and reached(before, stream) >= epoch:
                break
            line = {"batch": self._write(parts[0] if len(parts) == 1 else parts[0].union(parts[1]), base + 1), "removes": self.removed is not None}
            line |= {} if stream is None else {"epochs": {stream: epoch}}
            try:
                self._versions.commit(base + 1, map(json.dumps, [*before, line]))
                break
            except CommitConflict:
                continue
        return replace(self, pending=None, removed=None)

    def compact(self, path: str | None = None) -> QuadStore:
        """The present quads as one batch: of the next version, or of a store at another path. Older versions stay readable. A
        commit that came between is an error (CommitConflict), and then nothing is changed."""
        base = self._versions.latest()
        whole = replace(self, context=None).stored(version=base).df.select(*COLUMNS, F.lit(True).alias("inserts"))
        target = self if path is None else replace(self, path=path)
        number = 1 + (base if path is None else target._versions.latest())
        before = self._batches(base)
        epochs = {s: reached(before, s) for b in before for s in b.get("epochs", {})}
        target._versions.commit(number, [json.dumps({"batch": target._write(whole, number), "removes": False, "epochs": epochs})])
        return target


def reached(batches: Sequence[dict], stream: str) -> int:
    """The greatest number of a stream's batches that a manifest has, -1 without any."""
    return max((b.get("epochs", {}).get(stream, -1) for b in batches), default=-1)

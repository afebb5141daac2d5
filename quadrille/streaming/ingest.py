"""N-Triples that arrive as files, parsed and matched as a stream with the operators of the batch side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quadrille.operators.quads import Graph
from quadrille.plans.solutions import Solutions
from quadrille.sources.ntriples import statements
from quadrille.sources.store import QuadStore


def quads(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (g, s, p, o) from the N-Triples and N-Quads files that arrive in a folder; bad lines are left out."""
    lines = spark.readStream.text(folder)
    return statements(lines).where("s is not null").select("g", "s", "p", "o")


def matches(stream: DataFrame, s=None, p=None, o=None, graph: str | None = None) -> Solutions:
    """A triple pattern over a stream of quads: a stateless filter and projection."""
    return Graph(stream).pattern(s, p, o, graph)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there to Parquet once, exactly once across restarts with the same checkpoint folder."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_store(stream: DataFrame, store: QuadStore, name: str, checkpoint: str) -> StreamingQuery:
    """Commits all that is there to a store, a version for each batch of the stream. The batch's number goes into the manifest
    under the stream's name, so a batch that is repeated after a failure commits nothing."""

    def add(batch: DataFrame, epoch: int) -> None:
        store.add(graph=Graph(batch.select("g", "s", "p", "o").distinct())).commit(name, epoch)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

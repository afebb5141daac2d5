"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link at 4 or fewer differing bits. Every bit position has a non-zero vector of r + 1 = 5 bits;
table v (a non-zero vector too, so 31 tables) hashes the positions whose vector has an odd inner product with v. For any
4 or fewer differing positions, the 4 equations <vector, v> = 0 in 5 unknowns have a non-zero solution v, and in that
table the two fingerprints agree on every hashed position: every pair within the radius collides in some table.

Copies share a fingerprint and are one node. Buckets of a table are joined without writing out pairs:

* A bucket is compared inside bounded blocks, which keep a spanning forest of its links (at most one edge a node).
* A bucket of more than BLOCK nodes is split by the ball rule instead: its members differ only at positions that the
  table leaves out, and two of them are within 4 bits exactly if changing at most 2 such bits of each can give the same
  value. Each node goes to all values of its ball, and nodes with a common value are linked to the least of them: linear
  in the bucket, exact, and a plain minimum by key.

Components are then found over fingerprints by repeated minimum labels with pointer jumping; each round is written to
shared storage, so lineage stays short.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and is linked like any other;
null keys never represent a component unless all its keys are null; repeated rows each get a row; an empty table gives
an empty table; no column but the key and the text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import materialize, text_or_empty, without

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Largest bucket whose members are compared directly.
BLOCK = 1 << 14
_SHINGLES_AT_ONCE = 1 << 16


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The bits that each table hashes."""
    vectors = [1 + i % ((1 << (radius + 1)) - 1) for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()  # bytes: A-Z and 0x09-0x0D, 0x20 only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n], ends[min(shingle, len(words)) - 1 :][:n]
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, _SHINGLES_AT_ONCE):
        spans = zip(starts[lo : lo + _SHINGLES_AT_ONCE].tolist(), ends[lo : lo + _SHINGLES_AT_ONCE].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(df: DataFrame, *keep: str | Column, text: str = "text") -> DataFrame:
    """(*keep, fp long): the SimHash of every whole text, its 64 bits as a signed number."""
    source = df.select(text_or_empty(text).alias("_text"), *keep)
    names = [*source.columns[1:], "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(str(x.as_py())) for x in batch.column(0)], np.uint64).view(np.int64)
            yield pa.record_batch([*batch.columns[1:], pa.array(values)], names)

    return source.mapInArrow(run, T.StructType([*source.schema.fields[1:], T.StructField("fp", T.LongType())]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket key, nodes of the bucket): edges that join all nodes which links within the bucket join."""
    for batch in batches:
        left, right = [], []
        column = batch.column(0)
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
            nodes = values[lo:hi]
            if hi - lo == 2:
                if int(nodes[0] ^ nodes[1]).bit_count() <= radius:
                    left.append(nodes[0])
                    right.append(nodes[1])
                continue
            waiting = np.arange(hi - lo)
            while len(waiting):  # breadth first from each node that is not reached yet
                front, waiting = waiting[:1], waiting[1:]
                while len(front) and len(waiting):
                    at, front = front[0], front[1:]
                    near = np.bitwise_count(nodes[waiting] ^ nodes[at]) <= radius
                    found = waiting[near]
                    left += [nodes[at]] * len(found)
                    right += nodes[found].tolist()
                    waiting, front = waiting[~near], np.concatenate([front, found])
        if left:
            pair = [np.array(x, np.uint64).view(np.int64) for x in (left, right)]
            yield pa.record_batch([pa.array(x) for x in pair], ["a", "b"])


def links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` whose components are those of all links within the radius."""
    masks = covering_masks(radius)
    keys = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for t, m in enumerate(masks)])
    tables = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.v")
    sizes = tables.groupBy("t", "v").agg(F.count("*").alias("n"), F.min("fp").alias("x"), F.max("fp").alias("y")).where("n > 1")
    sizes = materialize(sizes, "buckets")  # only buckets with company go on
    pairs = sizes.where("n = 2").where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius).select(F.col("x").alias("a"), F.col("y").alias("b"))
    members = tables.join(sizes.where("n > 2").select("t", "v", "n"), ["t", "v"])
    some = members.where(F.col("n") <= block).groupBy("t", "v").agg(F.collect_list("fp").alias("fps")).select("fps")
    forests = some.mapInArrow(lambda rows: _forest(rows, radius), "a long, b long")
    return pairs.unionByName(forests).unionByName(_ball_links(members.where(F.col("n") > block), masks, radius)).distinct()


def _ball_links(members: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links in buckets of any size: nodes whose balls of half the radius, over the positions left out, meet."""
    near, far = radius // 2, radius - radius // 2
    if near != far:
        raise ValueError("the radius must be even")
    changes = [
        [_signed(sum(1 << i for i in bits)) for n in range(near + 1) for bits in combinations([i for i in range(BITS) if not mask >> i & 1], n)] for mask in masks
    ]
    ball = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in changes]), F.col("t").cast("int") + 1)
    values = members.select("t", "v", "fp", F.explode(ball).alias("change")).select("t", "v", "fp", F.col("fp").bitwiseXOR(F.col("change")).alias("value"))
    least = values.groupBy("value").agg(F.min("fp").alias("a"))
    return values.select("fp", "value").join(least, "value").where("fp <> a").select("a", F.col("fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the least fingerprint of each node's component, for the nodes that have edges."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    first = both.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("m"))
    labels = materialize(first.select("fp", F.least("fp", "m").alias("root")), "labels")
    while True:
        offered = both.join(labels, both.b == labels.fp).groupBy("a").agg(F.min("root").alias("offer"))
        hooked = labels.join(offered, labels.fp == offered.a, "left").select("fp", F.col("root").alias("old"), F.least("root", "offer").alias("root"))
        jump = labels.select(F.col("fp").alias("via"), F.col("root").alias("further"))
        moved = hooked.join(jump, hooked.root == jump.via, "left").select("fp", "old", F.least("root", "further").alias("root"))
        moved = materialize(moved, "labels")
        if moved.where("root <> old").isEmpty():
            return moved.select("fp", "root")
        labels = moved.select("fp", "root")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id): every row's fingerprint as 16 hex digits and the least key of its component."""
    prints = materialize(fingerprints(df, key, text=text), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    rooted = materialize(components(links(nodes.select("fp"), radius)).join(nodes, "fp"), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), "named")
    placed = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(materialize(placed, "placed"), "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each near-duplicate group: the one with the least key (a null key comes last), then the least address.

    A row's address is a hash of its key and its text, so that a null key, or a key that stands on several texts, is no
    other row's. Rows that are equal in both are one row. Only addresses are joined back to the rows.
    """
    own = {c: f"_own_{i}" for i, c in enumerate(df.columns)}
    named = F.coalesce(F.concat(F.lit("k"), F.col(own[key]).cast("string")), F.lit("n"))
    address = F.unhex(F.md5(F.concat_ws("\n", named, text_or_empty(own[text])))).alias("_address")
    rows = df.select(*[F.col(c).alias(o) for c, o in own.items()])
    prints = materialize(fingerprints(rows, own[key], address, text=own[text]), "fingerprints")
    rooted = materialize(components(links(prints.select("fp").distinct(), radius)), "rooted")
    place = F.struct(F.col(own[key]).isNull().alias("unnamed"), F.col(own[key]).alias("key"), "_address")
    copies = prints.groupBy("fp", "_address").agg(F.count("*").alias("n"), F.min(place).alias("place"))
    groups = materialize(copies.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "groups")
    first = groups.groupBy("root").agg(F.min("place").alias("first"))
    judged = groups.join(first, "root").select("_address", "n", F.col("place").eqNullSafe(F.col("first")).alias("stays"))
    later = materialize(judged.where("not stays or n > 1").select("_address"), "later")
    repeated = materialize(judged.where("stays and n > 1").select("_address"), "repeated")
    addressed = rows.select("*", address)
    once = without(addressed, "_address", later)
    again = addressed.join(repeated, "_address", "left_semi").dropDuplicates(["_address"])
    return once.unionByName(again).select(*[F.col(o).alias(c) for c, o in own.items()])

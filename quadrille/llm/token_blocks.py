"""Token-ID files in patched frame-of-reference blocks.

A dataset is a folder of Parquet files whose rows are segments. A segment holds whole documents in key order and about
2^18 ids: the documents' keys and first ids, the id count of its shard before it, the byte at which each block starts,
and the payload. A block is 512 ids: their minimum is subtracted, the differences are packed at the width that 95 % of
them need, and those which need more bits are stored whole in an exception list. Blocks are found through the index of
starts, so part of a segment can be read without the rest.

Block layout, little endian: minimum u32, width u8, exceptions u16, packed differences (64 * width bytes; the last block
is filled with its minimum), exception positions u16 each, exception differences u32 each.

Texts are dealt by ranges of keys and encoded there: their ids take as much room as they do (2 bytes for about as many
characters), so that encoding first would move no less and write the ids once more. Rows with equal keys are dealt by a
hash, so that a key on many rows does not end up in one task.

A shard is one writing task, so a lost executor's shard is written again by the same plan. Segments carry their own
order; nothing depends on file names or on how Spark splits the files when reading.

Defined cases: a null text has only its end id; documents with equal keys are ordered by a hash of their texts; null keys
come first; an empty table gives an empty dataset, which reads as an empty table; columns other than key and text are not
read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.bpe import packed_ids
from quadrille.llm.common import text_or_empty
from quadrille.llm.token_counts import load

BLOCK = 512
#: Ids of a segment, about.
SEGMENT = 1 << 18
#: Share of a block's values that the packed width must hold.
PERCENTILE = 0.95


def pack(ids: np.ndarray) -> tuple[list[int], bytes]:
    """Starts of the blocks and the payload."""
    n = len(ids)
    if not n:
        return [], b""
    blocks = np.full((-(-n // BLOCK), BLOCK), 0, np.uint32)
    blocks.ravel()[:n] = ids
    if n % BLOCK:
        blocks[-1, n % BLOCK :] = blocks[-1, : n % BLOCK].min()
    least = blocks.min(1)
    rest = blocks - least[:, None]
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    widths = np.frexp(np.partition(rest, at, 1)[:, at].astype(np.float64))[1].astype(np.int64)  # bits that it needs
    beyond = (rest.astype(np.uint64) >> widths[:, None].astype(np.uint64)) > 0
    packed: list[bytes] = [b""] * len(blocks)
    for width in np.unique(widths):
        if width:
            own = np.flatnonzero(widths == width)
            bits = (rest[own][:, :, None] >> np.arange(width, dtype=np.uint32)).astype(np.uint8) & 1
            for i, row in zip(own, np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little"), strict=True):
                packed[i] = row.tobytes()
    starts, parts, size = [], [], 0
    for i, body in enumerate(packed):
        where = np.flatnonzero(beyond[i])
        block = b"".join(
            [int(least[i]).to_bytes(4, "little"), bytes([int(widths[i])]), len(where).to_bytes(2, "little"), body, where.astype("<u2").tobytes(), rest[i, where].astype("<u4").tobytes()]
        )
        starts.append(size)
        parts.append(block)
        size += len(block)
    return starts, b"".join(parts)


def unpack(payload: bytes, starts: list[int], n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (exclusive; default: all) of a segment of n ids."""
    last = len(starts) if last is None else last
    out = np.empty((max(0, last - first), BLOCK), np.uint32)
    by_width: dict[int, list[int]] = {}
    for i in range(first, last):
        by_width.setdefault(payload[starts[i] + 4], []).append(i)
    raw = np.frombuffer(payload, np.uint8)
    for width, own in by_width.items():
        rows = np.array(own) - first
        out[rows] = 0
        if width:
            body = np.stack([raw[starts[i] + 7 : starts[i] + 7 + BLOCK // 8 * width] for i in own])
            bits = np.unpackbits(body, axis=1, bitorder="little").reshape(len(own), BLOCK, width)
            total = np.zeros((len(own), BLOCK), np.uint32)
            for k in range(width):
                total |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
            out[rows] = total
    for i in range(first, last):
        at = starts[i]
        count = int.from_bytes(payload[at + 5 : at + 7], "little")
        if count:
            body = at + 7 + BLOCK // 8 * payload[at + 4]
            where = np.frombuffer(payload, "<u2", count, body)
            out[i - first, where] = np.frombuffer(payload, "<u4", count, body + 2 * count)
        out[i - first] += np.uint32(int.from_bytes(payload[at : at + 4], "little"))
    return out.ravel()[: n - first * BLOCK]


#: A single space between words: no pre-token reaches across it, so a text may be cut before it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Longest stretch of a text that is encoded at a time, if it has a place to cut.
STRETCH = 1 << 21


def stretches(text: str) -> Iterator[str]:
    lo = 0
    while len(text) - lo > STRETCH and (cut := _CUT.search(text, lo + STRETCH)):
        yield text[lo : cut.start()]
        lo = cut.start()
    yield text[lo:] if lo else text


@lru_cache(maxsize=4)
def check_vocabulary(path: str) -> None:
    """Refuses files whose merges tiktoken would not do in the same order: it merges where two neighbours are a token, the
    least id first. That is the file's order if the ids of its merges rise, and its result if every token comes out of its
    own merges whole."""
    merges, spelled, _ = load(path)
    if (np.diff(merges.made) <= 0).any():
        raise ValueError(f"{path}: the ids do not follow the order of the merges")
    tokens = list(spelled)
    whole = [spelled[t].to_bytes(4, "little") for t in tokens]
    if packed_ids(tokens, merges) != whole:
        raise ValueError(f"{path}: there are tokens that their merges do not make")


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level BPE file as a tiktoken encoding. It gives the ids of the tokenizers library for vocabularies that
    check_vocabulary() lets pass, for less than half of its CPU time."""
    _, spelled, special = load(path)
    with open(path, encoding="utf-8") as file:
        ids = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks={t: i for t, i in spelled.items() if i not in ids.values()}, special_tokens={s: ids[s] for s in special})


#: White space that is too long for tiktoken's regular expressions.
_LONG_SPACE = re.compile(r"\s{100000}")


def _by_tree(text: str, path: str, pattern: str) -> list[int]:
    """A text's ids by this library's own tree of merges, for texts that tiktoken can't split."""
    merges, _, special = load(path)
    split = SpecialSplit(pattern, special)
    with open(path, encoding="utf-8") as file:
        ids = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
    pieces = split.pieces(text)
    found = iter(packed_ids([p.encode() for p in pieces if p not in ids], merges))
    return np.frombuffer(b"".join(ids[p].to_bytes(4, "little") if p in ids else next(found) for p in pieces), "<u4").tolist()


class SpecialSplit:
    """The pre-tokenizer's pattern, with special strings cut out first as pieces of their own."""

    def __init__(self, pattern: str, special: tuple[str, ...]):
        self.pattern = regex.compile(pattern)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def pieces(self, text: str) -> list[str]:
        parts = self.special.split(text) if self.special else [text]
        return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self.pattern.findall(part))]


def encode(text: str, encoding: tiktoken.Encoding, pattern: str) -> np.ndarray:
    """Strings of special tokens inside the text become those tokens, which is the library's default."""
    if len(text) >= 100_000 and _LONG_SPACE.search(text):
        return np.array(_by_tree(text, encoding.name, pattern), np.uint32)
    special = any(s in text for s in encoding.special_tokens_set)
    parts = [encoding.encode(t, allowed_special="all") if special else encoding.encode_ordinary(t) for t in stretches(text)]
    return np.array(parts[0] if len(parts) == 1 else [i for part in parts for i in part], np.uint32)


def write(df: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Writes every text's ids and `end_id`, in ascending key order, as a dataset at `path` on shared storage."""
    check_vocabulary(tokenizer)
    source = df.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    order = {"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()}
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.withColumns(order).repartitionByRange(partitions, "key", *order).sortWithinPartitions("key", *order).select("key", "text")
    kind = source.schema["key"].dataType
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("segment", T.LongType()),
            T.StructField("before", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("keys", T.ArrayType(kind)),
            T.StructField("firsts", T.ArrayType(T.LongType())),
            T.StructField("block_starts", T.ArrayType(T.LongType())),
            T.StructField("payload", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoder(tokenizer, pattern)
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], np.uint32)
        keys: list[pa.Array] = []
        arrays: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(arrays)
            starts, payload = pack(ids)
            firsts = np.cumsum([0, *map(len, arrays[:-1])])
            held = pa.concat_arrays(keys)
            row = [[shard], [segment], [before], [len(ids)], pa.ListArray.from_arrays([0, len(held)], held), [firsts], [starts], [payload]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), None, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([x if k is None else pa.array(x, k) for x, k in zip(row, kinds, strict=True)], schema.names)

        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                keys.append(batch.column(0).slice(i, 1))
                arrays.append(np.append(encode(str(value.as_py()), encoding, pattern), end))
                size += len(arrays[-1])
                if size >= SEGMENT:
                    yield close()
                    segment, before, keys, arrays, size = segment + 1, before + size, [], [], 0
        if arrays:
            yield close()

    ordered.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_le32): every document's ids as little-endian unsigned 32-bit integers, and how many
    ids all documents before it have. Only the totals of shards, one row per writing task, are summed in order."""
    segments = spark.read.parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    offsets = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("offset"))
    placed = segments.join(F.broadcast(offsets), "shard").select(
        (F.col("offset") + F.col("before")).alias("base"), "n_ids", "keys", "firsts", "block_starts", "payload"
    )
    schema = T.StructType(
        [T.StructField(key, segments.schema["keys"].dataType.elementType), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_le32", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                base, n, _, firsts, starts, payload = (batch.column(c)[i].as_py() if c != 2 else None for c in range(6))
                ids = unpack(payload, starts, n).astype("<u4", copy=False)
                texts = [ids[a:b].tobytes() for a, b in pairwise([*firsts, n])]
                counts = np.diff([*firsts, n])
                yield pa.record_batch(
                    [batch.column(2)[i].values, pa.array(np.array(firsts, np.int64) + base), pa.array(counts, pa.int64()), pa.array(texts, pa.binary())], schema.names
                )

    return placed.mapInArrow(run, schema)

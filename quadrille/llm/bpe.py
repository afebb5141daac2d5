"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

Every piece of text that the pre-tokenizer's pattern matches is encoded alone. A segment tree over the piece's byte
positions holds, for each live position, the rank of the pair that it forms with the next live position; inner nodes
hold the minimum of (rank, position), so the root is the leftmost pair of the least rank. A merge rewrites three leaves
(the merged position, its live left neighbour, the position that died) and their ancestors: O(log n) each.

Short pieces are encoded many at a time, one tree per lane of a NumPy array; long ones (a run of a million equal
letters is one piece) use the same tree as plain lists. Encoded pieces are kept in a bounded cache per Python worker.

Defined cases: a null text encodes as the empty text (no ids); null ids decode to empty bytes; repeated rows and null or
repeated keys pass through row by row; an empty table gives an empty table. The operators return the key columns and
their own output and read no other column, so extra columns cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import chunks, text_or_empty

#: No pair: greater than every rank.
NONE = (1 << 31) - 1
#: Pieces up to this many bytes share lanes; longer ones are encoded alone.
LANE_BYTES = 128
#: Array cells of one tree that a block of lanes may hold.
LANE_CELLS = 1 << 19
#: Pieces that a worker keeps; when full, the cache starts anew.
CACHE_PIECES = 100_000
#: Pieces that a single text contributes at a time.
RUN_PIECES = 400_000


@dataclass(frozen=True)
class Merges:
    """Which pairs of ids merge: sorted keys left << 32 | right, with the rank of each; the id that a rank makes."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray

    @staticmethod
    def of(byte_ids: np.ndarray, pairs: dict[tuple[int, int], int], made: np.ndarray) -> Merges:
        keys = np.fromiter(((a << 32) | b for a, b in pairs), np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int64, len(pairs))
        order = np.argsort(keys)
        return Merges(byte_ids, np.append(keys[order], np.int64(1) << 62), np.append(ranks[order], NONE), made)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    @cached_property
    def rank_of(self) -> dict[tuple[int, int], int]:
        return {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(r) for k, r in zip(self.keys[:-1], self.ranks[:-1], strict=True)}


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def merges_of_ranks(path: str) -> Merges:
    """Two neighbouring tokens merge where their bytes together are a token; its id is their rank."""
    ranks = read_ranks(path)
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left, right] = rank
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    return Merges.of(byte_ids, pairs, np.arange(max(ranks.values()) + 1, dtype=np.int32))


def encode_lanes(pieces: list[bytes], size: int, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces of at most `size` bytes (a power of two), one after another, and how many each has."""
    n, depth = len(pieces), size.bit_length() - 1
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    column = np.arange(size)
    live = column < lengths[:, None]
    ids = np.zeros((n, size + 1), np.int32)
    ids[:, :size][live] = merges.byte_ids[flat]
    after = np.minimum(column + 1, lengths[:, None]).astype(np.int32)  # the next live position; its length: none
    before = np.tile((column - 1).astype(np.int32), (n, 1))
    tree = np.full((n, 2 * size), np.int64(NONE) << 32)
    pair = column < (lengths[:, None] - 1)
    leaf = tree[:, size:]
    leaf[pair] = (merges.rank(ids[:, :size][pair], ids[:, 1:][pair]) << 32) | np.broadcast_to(column, (n, size))[pair]
    for level in range(depth - 1, -1, -1):
        lo = 1 << level
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
    ids, after, before, tree, dead = ids.ravel(), after.ravel(), before.ravel(), tree.ravel(), ~live.ravel()
    none = np.int64(NONE) << 32

    def put(tree_row: np.ndarray, at: np.ndarray, value: np.ndarray | np.int64) -> None:
        node = size + at
        tree[tree_row + node] = value
        for _ in range(depth):
            node >>= 1
            both = tree_row + 2 * node
            tree[tree_row + node] = np.minimum(tree[both], tree[both + 1])

    row = np.arange(n)
    while len(row):
        root = tree[row * 2 * size + 1]
        going = root < none
        row, root = row[going], root[going]
        if not len(row):
            break
        at, rank = root & 0xFFFFFFFF, root >> 32
        cells, id_row, tree_row, length = row * size, row * (size + 1), row * 2 * size, lengths[row]
        gone = after[cells + at].astype(np.int64)
        beyond = after[cells + gone].astype(np.int64)
        ids[id_row + at] = merges.made[rank]
        dead[cells + gone] = True
        after[cells + at] = beyond
        has = beyond < length
        before[cells[has] + beyond[has]] = at[has]
        put(tree_row, gone, none)
        fresh = merges.rank(ids[id_row + at], ids[id_row + beyond])
        put(tree_row, at, np.where(has & (fresh < NONE), (fresh << 32) | at, none))
        left = before[cells + at].astype(np.int64)
        has = left >= 0
        left, at, id_row, tree_row = left[has], at[has], id_row[has], tree_row[has]
        fresh = merges.rank(ids[id_row + left], ids[id_row + at])
        put(tree_row, left, np.where(fresh < NONE, (fresh << 32) | left, none))
    alive = ~dead.reshape(n, size)
    return ids.reshape(n, size + 1)[:, :size][alive], alive.sum(1)


def encode_long(piece: bytes, merges: Merges) -> np.ndarray:
    """The same tree for one piece of any length."""
    rank_of = merges.rank_of
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    ids = merges.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    none = NONE * size
    tree = [none] * (2 * size)
    start = merges.rank(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)) if n > 1 else np.array([], np.int64)
    for i, rank in enumerate(start.tolist()):
        tree[size + i] = rank * size + i if rank < NONE else none
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(at: int, value: int) -> None:
        node = size + at
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                return
            tree[node] = least

    def key(left: int, right: int) -> int:
        rank = rank_of.get((ids[left], ids[right]))
        return none if rank is None else rank * size + left

    while tree[1] < none:
        rank, at = divmod(tree[1], size)
        gone = after[at]
        beyond = after[gone]
        ids[at], ids[gone] = int(merges.made[rank]), -1
        after[at] = beyond
        put(gone, none)
        if beyond < n:
            before[beyond] = at
            put(at, key(at, beyond))
        else:
            put(at, none)
        if before[at] >= 0:
            put(before[at], key(before[at], at))
    return np.array([i for i in ids if i >= 0], np.int32)


def encode_pieces(pieces: list[bytes], merges: Merges) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Blocks of the pieces, by the lanes that fit them: which pieces, their ids one after another, how many each has."""
    by_size: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        by_size.setdefault(max(4, 1 << (len(piece) - 1).bit_length()) if piece else 4, []).append(i)
    for size, members in by_size.items():
        if size > LANE_BYTES:
            for i in members:
                ids = encode_long(pieces[i], merges)
                yield [i], ids, np.array([len(ids)])
            continue
        for lo in range(0, len(members), lanes := max(1, LANE_CELLS // size)):
            block = members[lo : lo + lanes]
            yield block, *encode_lanes([pieces[i] for i in block], size, merges)


def packed_ids(pieces: list[bytes], merges: Merges) -> list[bytes]:
    """Every piece's ids as little-endian 32-bit integers."""
    out = [b""] * len(pieces)
    for block, ids, counts in encode_pieces(pieces, merges):
        data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        for i, a, b in zip(block, [0, *ends[:-1]], ends, strict=True):
            out[i] = data[a:b]
    return out


def piece_runs(text: str, pattern: regex.Pattern) -> Iterator[list[str]]:
    """The pieces of a text, in bounded runs where it is very long."""
    if len(text) <= 4 * RUN_PIECES:
        yield pattern.findall(text)
    else:
        found = (m.group() for m in pattern.finditer(text))
        while run := list(islice(found, RUN_PIECES)):
            yield run


class PieceCache(dict):
    """Piece -> what `encode` gives for it; starts anew when it has `most` entries."""

    def __init__(self, encode: Callable[[list[bytes]], Iterable], most: int = CACHE_PIECES, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.encode, self.most, self.fixed = encode, most, fixed or {}

    def learn(self, runs: list[list[str]]) -> None:
        """Encodes all pieces of runs that are not here yet."""
        pieces = set(chain.from_iterable(runs))
        fresh = list(pieces.difference(self))
        if len(self) + len(fresh) > self.most + len(self.fixed):
            self.clear()
            self.update(self.fixed)
            fresh = list(pieces.difference(self))
        if fresh:
            self.update(zip(fresh, self.encode([p.encode() for p in fresh]), strict=True))


def encode_texts(texts: Iterable[str], pattern: regex.Pattern, cache: PieceCache) -> Iterator[np.ndarray]:
    """The ids of each text; cache values are little-endian 32-bit ids."""
    for chunk in chunks(texts):
        if len(chunk) == 1:
            parts = []
            for run in piece_runs(chunk[0], pattern):
                cache.learn([run])
                parts.append(b"".join(map(cache.__getitem__, run)))
            yield np.frombuffer(b"".join(parts), "<u4")
        else:
            runs = [pattern.findall(text) for text in chunk]
            cache.learn(runs)
            for run in runs:
                yield np.frombuffer(b"".join(map(cache.__getitem__, run)), "<u4")


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> tuple[regex.Pattern, PieceCache]:
    ranks, merges = read_ranks(path), merges_of_ranks(path)

    def encode(pieces: list[bytes]) -> list[bytes]:
        whole = [ranks.get(p) for p in pieces]  # a piece that is a token is that token
        rest = iter(packed_ids([p for p, w in zip(pieces, whole, strict=True) if w is None], merges))
        return [next(rest) if w is None else w.to_bytes(4, "little") for w in whole]

    return regex.compile(pattern), PieceCache(encode)


def list_column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays) if arrays else [], kind))


def _encoded(ranks_path: str, pattern: str, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (key, ids) of batches (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, cache = _encoder(ranks_path, pattern)
        for batch in batches:
            lo, size, arrays = 0, 0, []
            for ids in encode_texts(map(str, (x.as_py() for x in batch.column(1))), split, cache):
                arrays.append(ids)
                size += len(ids)
                if size >= 1 << 21:  # bounded output batches
                    yield pa.record_batch([batch.column(0).slice(lo, len(arrays)), list_column(arrays, pa.int32())], [key, "ids"])
                    lo, size, arrays = lo + len(arrays), 0, []
            if arrays:
                yield pa.record_batch([batch.column(0).slice(lo), list_column(arrays, pa.int32())], [key, "ids"])

    return run


def encode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): the byte-level BPE ids of every whole text, each match of `pattern` encoded separately.

    `ranks_path` is a rank file that every executor can open.
    """
    source = df.select(F.col(key), text_or_empty(text).alias("_text"))
    schema = T.StructType([source.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return source.mapInArrow(_encoded(ranks_path, pattern, key), schema)


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each id's bytes, and all the bytes."""
    ranks = read_ranks(path)
    by_id = {i: token for token, i in ranks.items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    lengths = np.array([len(x) for x in tokens], np.int64)
    return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(tokens), np.uint8)


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    starts, lengths, flat = _vocabulary(path)
    out = []
    for lo in range(0, len(ids), 1 << 18):
        part = ids[lo : lo + (1 << 18)]
        n = lengths[part]
        ends = np.cumsum(n)
        out.append(flat[np.repeat(starts[part] - ends + n, n) + np.arange(ends[-1])].tobytes())
    return b"".join(out)


def _decoded(ranks_path: str, keep: list[str], with_ids: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (*keep, decoded) of batches (*keep, ids); with_ids: (*keep, ids, decoded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            null = column.is_null().to_numpy(zero_copy_only=False)
            texts = [b"" if null[i] else decode_ids(values[offsets[i] : offsets[i + 1]], ranks_path) for i in range(batch.num_rows)]
            yield pa.record_batch([*(batch.columns if with_ids else batch.columns[:-1]), pa.array(texts, pa.binary())], [*keep, *(["ids"] if with_ids else []), "decoded"])

    return run


def decode(df: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, decoded binary): the bytes of every row's ids."""
    source = df.select(F.col(key), *keep, F.col(ids).alias("_ids"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("decoded", T.BinaryType())])
    return source.mapInArrow(_decoded(ranks_path, [key, *keep]), schema)


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): encode() and decode() of its ids by one Python worker a task, where two in a row would hold a
    vocabulary, a batch and buffers each."""
    source = df.select(F.col(key), text_or_empty(text).alias("_text"))
    schema = T.StructType([source.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    encoded, decoded = _encoded(ranks_path, pattern, key), _decoded(ranks_path, [key], with_ids=True)
    return source.mapInArrow(lambda batches: decoded(encoded(batches)), schema)


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode() and decode()."""
    return encode_decode(df, ranks_path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Token counts by the whole-token shortcut.

Before any text is read, the driver runs every string of the vocabulary through the merges, once; those that come out as
the one token that they spell are proven whole, and their list (no more than the vocabulary) goes to all executors. A
pre-token among them counts as one token without a merge; all others are merged (once per worker while they stay in a
bounded cache) and counted. Strings of special tokens inside a text count as that token, which is
the tokenizer library's default.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows and null or repeated keys pass through row
by row; an empty table gives an empty table; no column but the key and the text is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.bpe import Merges, PieceCache, encode_pieces, packed_ids, piece_runs
from quadrille.llm.common import chunks, text_or_empty


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies spell printable Latin-1 bytes as themselves, the others as U+0100 and following."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def load(path: str) -> tuple[Merges, dict[bytes, int], tuple[str, ...]]:
    """Merges, vocabulary by bytes, and special strings of a byte-level BPE file; other kinds are refused."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, special = spec["model"], spec["added_tokens"]
    if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("only byte-level BPE without a normalizer or prefix space is supported")
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in special):
        raise ValueError("special tokens that depend on their surroundings are not supported")
    alphabet, vocab = byte_alphabet(), model["vocab"]
    pairs, made = {}, []
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        pairs[vocab[left], vocab[right]] = rank
        made.append(vocab[left + right])
    byte_ids = np.zeros(256, np.int32)
    for letter, byte in alphabet.items():
        byte_ids[byte] = vocab[letter]
    spelled = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if all(c in alphabet for c in token)}
    return Merges.of(byte_ids, pairs, np.array(made, np.int32)), spelled, tuple(x["content"] for x in special)


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary's strings that are proven, by running the merges, to encode alone as one token."""
    merges, spelled, _ = load(path)
    tokens = list(spelled)
    proven = set()
    for token, ids in zip(tokens, packed_ids(tokens, merges), strict=True):
        if ids == spelled[token].to_bytes(4, "little"):
            try:
                proven.add(token.decode())
            except UnicodeDecodeError:
                continue  # part of a character: never a pre-token of its own
    return frozenset(proven)


class Counter:
    """Counts tokens of texts; whole strings are given, the lengths of other pieces are learned."""

    def __init__(self, path: str, pattern: str, whole: frozenset[str]):
        merges, _, special = load(path)

        def lengths(pieces: list[bytes]) -> list[int]:
            out = np.zeros(len(pieces), np.int64)
            for block, _, counts in encode_pieces(pieces, merges):
                out[block] = counts
            return out.tolist()

        self.cache = PieceCache(lengths, fixed=dict.fromkeys(whole, 1))
        self.split = regex.compile(pattern)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def count(self, texts: list[str]) -> Iterator[int]:
        cache, split, special = self.cache, self.split, self.special
        for chunk in chunks(texts):
            plain, extra = chunk, [0] * len(chunk)
            if special is not None and any(special.search(t) for t in chunk):
                extra = [len(special.findall(t)) for t in chunk]
                plain = [special.split(t) if n else t for t, n in zip(chunk, extra, strict=True)]
            if len(chunk) == 1:
                total = extra[0]
                for part in plain[0] if isinstance(plain[0], list) else plain:
                    for run in piece_runs(part, split):
                        cache.learn([run])
                        total += sum(map(cache.__getitem__, run))
                yield total
                continue
            runs = [[p for part in t for p in split.findall(part)] if isinstance(t, list) else split.findall(t) for t in plain]
            cache.learn(runs)
            for run, n in zip(runs, extra, strict=True):
                yield n + sum(map(cache.__getitem__, run))


#: The counters of this worker, so that tasks go on with what earlier ones learned.
_COUNTERS: dict[tuple[str, str], Counter] = {}


def count_tokens(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every whole text, by the byte-level BPE file at `path`."""
    source = df.select(F.col(key), text_or_empty(text).alias("_text"))
    shared = df.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get((path, pattern))
        if counter is None:
            counter = _COUNTERS[path, pattern] = Counter(path, pattern, shared.value)
        for batch in batches:
            texts = [str(x.as_py()) for x in batch.column(1)]
            yield pa.record_batch(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter.count(texts), pa.int64())],
                [key, "n_bytes", "n_tokens"],
            )

    schema = T.StructType([source.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return source.mapInArrow(run, schema)

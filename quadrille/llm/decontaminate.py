"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits, in lower case. A document overlaps an item if, along one alignment, at least
PERCENT of each hundred words in some window of MIN_OVERLAP words of the item are equal, or of the whole item if it is shorter;
words beyond the document's ends count as replaced. Items under 5 words must thus be there word for word.

A seed looks at a window of a few words under fixed masks that ignore some of its positions, by their residue. The masks
find every such overlap (see seed_of): in a window of 20 words with 4 replaced, one half of 10 has 2 replaced at most, and
of the 10 masks that ignore two residues mod 5, one ignores both. Test and training windows are joined on their masked
hashes, and the words around each hit are compared.

As a Spark job: the items become rows of windows, (item, place, words around it, masked hashes). A Bloom filter of the
items' hashes goes to all executors; documents pass through it, and only windows with a hash in it become rows. The two
tables are joined on the hash, on narrow rows of distinct surroundings; the words around both sides come back and are
compared once for each pair of surroundings, and only then texts and items are named. Nothing of a document or an item
passes through the driver, which sees the filter alone (at most MAX_BITS bits). A benchmark of more than PART_HASHES hashes
takes a pass over the documents for each part, so the filter stays as selective as it is small.

Documents are addressed by content: equal texts are compared once. Windows of one text that have the same words around
them are compared once too (a repeated word gives a handful, not one for each of its pairs).

Defined cases: items without words and null items match nothing; a null document has no words; the result has a row for
each matching (row of df, item), so repeated rows and null or repeated keys repeat it; repeated items each match; empty
tables give an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import chunks, materialize, text_or_empty, without

#: At least PERCENT of the words of a window of MIN_OVERLAP item words must be equal.
MIN_OVERLAP, PERCENT = 20, 80
#: Words on each side of a seed's window that a window of MIN_OVERLAP words around it can reach.
REACH = 12
#: The Bloom filter: bits for each hash, rounded up to a power of two; probes; its greatest size; hashes of one pass.
BITS_EACH, PROBES, MIN_BITS, MAX_BITS, PART_HASHES = 64, 4, 1 << 16, 1 << 28, 1 << 22
#: Windows that are looked at together, and windows whose surroundings are held at a time.
SLICE, HELD = 1 << 17, 1 << 13
#: Characters whose words are hashed at a time, and the hash's base.
CHARACTERS, _BASE = 1 << 19, 0x9E3779B97F4A7C15
#: What stands beyond the ends of a document and of an item: words that neither has, and that differ.
_NO_WORD, _NO_ITEM = np.uint64((1 << 64) - 1), np.uint64(0)
#: Words beyond a document between it and the next one: the surroundings of no window reach across.
_GAP = REACH + 4
#: Odd multipliers by position: powers of the 64-bit golden ratio.
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(MIN_OVERLAP + 2 * REACH)], np.uint64)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which code points are letters or digits; powers of the hash's base and of its inverse modulo 2^64."""
    in_word = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    both = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(CHARACTERS, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return in_word, *both


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text: polynomials in the word's code points, from prefix sums over all texts at
    once, CHARACTERS at a time. A word that goes on beyond such a stretch is carried over."""
    in_word, power, inverse = _tables()
    lower = [text.lower() for text in texts]
    joined = "\n".join([*lower, ""])
    lengths = np.fromiter(map(len, lower), np.int64, len(lower)) + 1
    hashes, begins, open_word = [], [], None  # (sum, length, begin) of a word that is not over
    for lo in range(0, len(joined), CHARACTERS):
        codes = np.frombuffer(joined[lo : lo + CHARACTERS].encode("utf-32-le"), "<u4")
        edges = np.diff(in_word[codes].view(np.int8), prepend=0, append=0)
        first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        value = (codes + np.uint64(1)) * _WEIGHTS[0]
        value ^= value >> np.uint64(29)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[: len(codes)])])
        own, begin = (total[end] - total[first]) * inverse[first], first + lo
        if open_word:
            done, length, start = open_word
            if len(first) and first[0] == 0:
                own[0] = np.uint64((done + int(own[0]) * pow(_BASE, length, 1 << 64)) % (1 << 64))
                begin[0] = start
            else:
                own, begin = np.append(np.uint64(done), own), np.append(start, begin)
            open_word = None
        if len(end) and end[-1] == len(codes):
            open_word = int(own[-1]), lo + len(codes) - int(begin[-1]), int(begin[-1])
            own, begin = own[:-1], begin[:-1]
        hashes.append(own)
        begins.append(begin)
    words, begin = (np.concatenate(x) if x else np.empty(0, k) for x, k in ((hashes, np.uint64), (begins, np.int64)))
    words = _mixed(words)
    return np.split(words, np.searchsorted(begin, np.cumsum(lengths)[:-1])) if texts else []


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _WEIGHTS[0]
    return values ^ (values >> np.uint64(29))


def needed(n_words: int) -> int:
    """How many words must be equal in a window of an item of so many words."""
    return ceil(PERCENT * min(n_words, MIN_OVERLAP) / 100)


@dataclass(frozen=True)
class Seed:
    """A window of `span` words under the masks that ignore `ignored` of the residues mod `period`."""

    span: int
    period: int
    ignored: int

    def hashes(self, words: np.ndarray) -> Iterator[np.ndarray]:
        """For each mask, the hash of every window of the words."""
        n = max(0, len(words) - self.span + 1)
        residues = [sum((words[p : p + n] * _WEIGHTS[p] for p in range(r, self.span, self.period)), np.zeros(n, np.uint64)) for r in range(self.period)]
        for mask, free in enumerate(combinations(range(self.period), self.ignored)):
            salt = np.uint64(xxhash.xxh64_intdigest(repr((self, mask)).encode()))
            total = sum((residues[r] for r in range(self.period) if r not in free), np.full(n, salt, np.uint64))
            yield _mixed(total)


def seed_of(n_words: int) -> Seed:
    """The seed that finds every accepted overlap of an item of so many words.

    20 and more: 4 of 20 words may be replaced, so at most 2 in one half. 10 to 14: at most 2 in all. 15 to 19: at most 3,
    so at most 1 in the first or the second 7 words. 5 to 9: at most 1. Under 5: none.
    """
    if n_words >= MIN_OVERLAP or 10 <= n_words < 15:
        return Seed(10, 5, 2)
    if n_words >= 15:
        return Seed(7, 3, 1)
    return Seed(n_words, 3, 1) if n_words >= 5 else Seed(n_words, 1, 0)


def _around(words: np.ndarray, span: int) -> np.ndarray:
    """Row i: the words of the window at i - REACH of `words` (which has REACH words of padding), with REACH on each side."""
    return np.lib.stride_tricks.sliding_window_view(words, span + 2 * REACH)


def _new(around: np.ndarray, owner: np.ndarray, seen: dict[int, set[int]]) -> np.ndarray:
    """Which rows have surroundings that their owner did not have before."""
    keys = (around * _WEIGHTS[: around.shape[1]]).sum(1)
    keys ^= keys >> np.uint64(31)
    fresh = np.zeros(len(keys), bool)
    for i, (k, o) in enumerate(zip(keys.tolist(), owner.tolist(), strict=True)):
        known = seen.setdefault(o, set())
        if k not in known:
            known.add(k)
            fresh[i] = True
    return fresh


class Bloom:
    """Bits that are set for every hash of the benchmark; probes are stretches of the hash's own bits."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def _has(self, hashes: np.ndarray, probe: int) -> np.ndarray:
        at = (hashes >> np.uint64(12 * probe)) & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def places(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self._has(hashes, 0))
        for probe in range(1, PROBES):
            at = at[self._has(hashes[at], probe)]
        return at


def probes(hashed: Column, n_bits: int) -> Column:
    """The bits of one hash (a signed 64-bit column), from 1, as Bloom reads them."""
    return F.array(*[F.shiftrightunsigned(hashed, 12 * k).bitwiseAND(F.lit(n_bits - 1).cast("long")) + 1 for k in range(PROBES)])


#: A row for each place of a window: its owner's surroundings and masked hashes there.
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]


def found_windows(texts: list[np.ndarray], seed: Seed, bloom: Bloom) -> Iterator[Rows]:
    """(owner, place, surroundings, hashes in the filter) of the windows of documents that have such hashes, in parts."""
    lengths = np.array([len(w) for w in texts], np.int64)
    starts = _GAP + np.cumsum(lengths + _GAP) - lengths - _GAP
    words = np.full(int(lengths.sum()) + _GAP * (len(texts) + 1), _NO_WORD, np.uint64)
    for own, at in zip(texts, starts.tolist(), strict=True):
        words[at : at + len(own)] = own
    around, seen = _around(words, seed.span), {}
    # Windows begin up to 2 words before a document: what is beyond its end may stand where a mask does not look.
    for lo in range(_GAP - 2, len(words) - seed.span - REACH, SLICE):
        part = words[lo : min(lo + SLICE, len(words) - seed.span - REACH) + seed.span - 1]
        places, hashes = [], []
        for h in seed.hashes(part):
            places.append(bloom.places(h))
            hashes.append(h[places[-1]])
        at, hashed = np.concatenate(places), np.concatenate(hashes)
        order = np.argsort(at, kind="stable")
        at, hashed = at[order], hashed[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        groups = np.split(hashed, first[1:]) if len(first) else []
        at = at[first] + lo
        for some in range(0, len(at), HELD):
            here = at[some : some + HELD]
            rows, owner = around[here - REACH], np.searchsorted(starts - 2, here, "right") - 1
            keep = _new(rows, owner, seen)
            if keep.any():
                yield owner[keep], (here - starts[owner])[keep], rows[keep], [groups[some + i] for i in np.flatnonzero(keep)]


def item_windows(words: np.ndarray) -> Iterator[Rows]:
    """The same for one item, of its own seed."""
    seed = seed_of(len(words))
    room = np.full(REACH, _NO_ITEM, np.uint64)
    around, seen = _around(np.concatenate([room, words, room]), seed.span), {}
    for lo in range(0, len(words) - seed.span + 1, HELD):
        hashes = np.stack(list(seed.hashes(words[lo : lo + HELD + seed.span - 1])), axis=1)
        place = np.arange(lo, lo + len(hashes))
        rows, owner = around[place], np.zeros(len(place), np.int64)
        keep = _new(rows, owner, seen)
        yield owner[keep], place[keep], rows[keep], list(hashes[keep])


def verify(document: np.ndarray, item: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of surroundings, one of each side: whether some window has enough equal words, how many the best one has,
    and the first and last equal word of the accepted windows, as places in the row."""
    equal = document == item
    n, length = equal.shape
    best, first, last, ok = (np.zeros(n, np.int64) for _ in range(4))
    for size in np.unique(np.minimum(n_words, MIN_OVERLAP)).tolist():
        rows = np.flatnonzero(np.minimum(n_words, MIN_OVERLAP) == size)
        own = equal[rows]
        total = np.concatenate([np.zeros((len(rows), 1), np.int64), np.cumsum(own, axis=1, dtype=np.int64)], axis=1)
        count = total[:, size:] - total[:, :-size]
        good = count >= needed(size)
        ok[rows], best[rows] = good.any(1), count.max(1)
        covered = np.zeros_like(own)
        for i in range(size):
            covered[:, i : i + good.shape[1]] |= good
        covered &= own
        first[rows], last[rows] = covered.argmax(1), length - 1 - covered[:, ::-1].argmax(1)
    return ok.astype(bool), best, first, last


_WINDOW = "place long, span int, around binary, hashes array<long>"
_KINDS = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]


def _columns(places: np.ndarray, span: int, around: np.ndarray, hashes: list[np.ndarray]) -> list[pa.Array]:
    rows = [places.tolist(), [span] * len(places), [r.tobytes() for r in around], [h.view(np.int64) for h in hashes]]
    return [pa.array(c, k) for c, k in zip(rows, _KINDS, strict=True)]


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(item_id, n_words, place, span, around, hashes) of items (item_id, text): a row for each window that has its own
    surroundings."""
    schema = T.StructType([items.schema["item_id"], T.StructField("n_words", T.IntegerType()), *T._parse_datatype_string(_WINDOW).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                (words,) = word_hashes([str(text.as_py())])
                for _, place, around, hashes in item_windows(words) if len(words) else ():
                    owner = batch.column(0).take(pa.array(np.full(len(place), i)))
                    n = pa.array(np.full(len(place), len(words)), pa.int32())
                    yield pa.record_batch([owner, n, *_columns(place, seed_of(len(words)).span, around, hashes)], names)

    return items.mapInArrow(run, schema)


def _bloom(hashes: DataFrame) -> Bloom:
    """The filter of the hashes in column `h`. Spark builds its pages; at most MAX_BITS bits come to the driver."""
    n_bits = min(MAX_BITS, max(MIN_BITS, 1 << (BITS_EACH * hashes.count()).bit_length()))
    bit = hashes.select(F.explode(probes(F.col("h"), n_bits)).alias("b"))
    pages = bit.groupBy(F.bitmap_bucket_number("b").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    bits = np.zeros(n_bits // 8, np.uint8)
    for page, own in pages:
        lo = (page - 1) * len(own)
        bits[lo : lo + len(own)] = np.frombuffer(own, np.uint8)[: len(bits) - lo]
    return Bloom(bits)


def document_windows(texts: DataFrame, seeds: list[Seed], bloom: Bloom) -> DataFrame:
    """(text_id, place, span, around, hashes) of the windows of texts (text_id, text) that have hashes in the filter."""
    shared = texts.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for chunk in chunks(str(x.as_py()) for x in batch.column(1)):
                words = word_hashes(chunk)
                for seed in seeds:
                    for owner, place, around, hashes in found_windows(words, seed, shared.value):
                        yield pa.record_batch([batch.column(0).take(pa.array(owner + at)), *_columns(place, seed.span, around, hashes)], names)
                at += len(chunk)

    schema = T.StructType([texts.schema["text_id"], *T._parse_datatype_string(_WINDOW).fields])
    names = schema.names
    return texts.mapInArrow(run, schema)


def _addressed(text: str) -> Column:
    return F.unhex(F.md5(text_or_empty(text)))


def matches(df: DataFrame, benchmark: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(own, other, first, last, equal) of the surroundings of windows that overlap; where surroundings `own` stand in texts
    (text_id, at), and `other` in items (item_id, place). Equal surroundings are compared once: neither a passage that many
    documents share nor a phrase that many items share makes pairs of them."""
    items = benchmark.select(_addressed("text").alias("item_id"), text_or_empty("text").alias("text")).dropDuplicates(["item_id"])
    window = F.least("n_words", F.lit(MIN_OVERLAP)).alias("window")
    items = benchmark_windows(items).select("item_id", "place", "span", window, "around", "hashes", F.md5(F.concat(F.col("around"), window.cast("string").cast("binary"))).alias("other"))
    items = materialize(items, "benchmark")
    texts = df.select(_addressed(text).alias("text_id"), text_or_empty(text).alias("text"))
    lengths = items.select("window").distinct().collect()  # MIN_OVERLAP rows at most
    seeds = sorted({seed_of(n) for (n,) in lengths}, key=lambda s: (s.span, s.period))
    test = items.select("other", "window", "span", F.explode("hashes").alias("h")).distinct()
    n_parts = max(1, -(-test.count() // PART_HASHES))
    part = F.pmod(F.xxhash64("h"), F.lit(n_parts))
    passes = [document_windows(texts, seeds, _bloom(test.where(part == p).select("h").distinct())) for p in range(n_parts)]
    found = materialize(reduce(DataFrame.unionByName, passes).select("text_id", F.col("place").alias("at"), "around", "hashes", F.md5("around").alias("own")), "windows")
    hits = found.select("own", F.explode("hashes").alias("h")).distinct().join(test, "h").select("own", "other", "window", "span").distinct()
    sides = [side.groupBy(name).agg(F.first("around").alias(f"{name}_words")) for side, name in ((found, "own"), (items, "other"))]
    pairs = hits.join(sides[0], "own").join(sides[1], "other").select("own", "other", "window", "span", "own_words", "other_words")
    return materialize(_verified(pairs), "matches"), found.select("own", "text_id", "at"), items.select("other", "item_id", "place")


def _verified(pairs: DataFrame) -> DataFrame:
    """(own, other, first, last, equal) of the pairs of surroundings that have enough equal words."""
    names = ["own", "other", "first", "last", "equal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            window, span = (batch.column(c).to_numpy() for c in (2, 3))
            for size in np.unique(span).tolist():
                rows = np.flatnonzero(span == size)
                sides = [np.frombuffer(b"".join(batch.column(c).take(pa.array(rows)).to_pylist()), np.uint64).reshape(len(rows), -1) for c in (4, 5)]
                ok, equal, first, last = verify(*sides, window[rows])
                kept = pa.array(rows[ok])
                yield pa.record_batch([*[batch.column(c).take(kept) for c in (0, 1)], *[pa.array(x[ok], pa.int64()) for x in (first, last, equal)]], names)

    return pairs.mapInArrow(run, "own string, other string, first long, last long, equal long")


def overlaps(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(text_id, item_id, first_word, end_word, n_matched): a row for each distinct text of df and of the benchmark's
    column `text` with a verified overlap: from the first to the last accepted window along one alignment (the longest
    such stretch), and the equal words of its best window. Ids are MD5 of the texts."""
    verified, own, other = matches(df, benchmark, text)
    lo = F.col("at") - REACH
    placed = verified.join(own, "own").join(other, "other").select(
        "text_id", "item_id", (F.col("at") - F.col("place")).alias("shift"), (lo + F.col("first")).alias("first"), (lo + F.col("last") + 1).alias("end"), "equal"
    )
    by_line = placed.groupBy("text_id", "item_id", "shift").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.max("equal").alias("equal"))
    best = F.max_by(F.struct("first", "end", "equal"), F.struct(F.col("end") - F.col("first"), "equal", -F.col("shift")))
    return by_line.groupBy("text_id", "item_id").agg(best.alias("b")).select(
        "text_id", "item_id", F.col("b.first").alias("first_word"), F.col("b.end").alias("end_word"), F.col("b.equal").alias("n_matched")
    )


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, item, first_word, end_word, n_matched): a row for every row of df and of the benchmark with a verified overlap."""
    found = materialize(overlaps(df, benchmark, text), "overlaps")
    rows = df.select(F.col(key).alias("_key"), _addressed(text).alias("text_id"))
    items = benchmark.select(F.col(item).alias("_item"), _addressed("text").alias("item_id"))
    joined = found.join(items, "item_id").join(rows, "text_id")
    return joined.select(F.col("_key").alias(key), F.col("_item").alias(item), "first_word", "end_word", "n_matched")


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df without a verified overlap, with all their columns; texts that are surely clean do not move."""
    verified, places, _ = matches(df, benchmark, text)
    found = places.join(verified.select("own").distinct(), "own", "left_semi").select(F.col("text_id").alias("_address")).distinct()
    own = [F.col(c).alias(f"_own_{i}") for i, c in enumerate(df.columns)]
    kept = without(df.select(*own, _addressed(text).alias("_address")), "_address", materialize(found, "contaminated"))
    return kept.select(*[F.col(f"_own_{i}").alias(c) for i, c in enumerate(df.columns)])

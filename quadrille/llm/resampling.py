"""Target-distribution importance resampling with hashed word features, in two Arrow passes.

The features of a text are its runs of 1 to `longest` consecutive words, each hashed to one of `buckets` buckets by CRC-32.
The first pass counts buckets: np.bincount gives one vector for each partition, treeReduce merges the vectors, so one vector
of `buckets` numbers reaches the driver, whatever the rows. A bucket's gain is the scaled log ratio of its smoothed share in
the target to that in the raw texts. The gains, again one number for each bucket, are broadcast; the second pass sums them
over each document by np.bincount with weights. Gumbel noise, seeded by the document's key, makes the highest scores a draw
without replacement; the draw's ranks come from ranges of the score (plans.ordering), so nothing is sorted in one task.

Texts are cut into pieces of about PIECE bytes at white space between words, so a text of any length is read whole in
bounded memory, and runs of words go on over the cuts.

Defined cases: a null or empty text has no words, weight 0, and is not drawn; a null key is hashed as the empty text; of rows
with equal keys each is a document of its own, and equal rows are ranked in some order; an empty corpus gives an empty table
and an empty target gives gains from the smoothing alone; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import text_or_empty
from quadrille.plans.ordering import ordered

BUCKETS, LONGEST, SEED, SCALE = 10_000, 1, 2024, 1000
#: A draw takes from documents of so many words at least, and this share of them in percent.
LEAST_WORDS, PERCENT = 20, 10
#: Bytes of a piece of text, and words whose buckets a worker remembers.
PIECE, REMEMBERED = 1 << 20, 1 << 18

#: Bytes of a text with A-Z in lower case and every byte that is in no word as a space. Words are runs of 0-9, a-z and all
#: characters beyond ASCII, whose bytes in UTF-8 are 0x80 and more.
_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).translate(bytes(range(256)).lower())


class Buckets(dict):
    """The bucket of a feature, computed once while it is remembered."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.n
        return bucket


def word_pieces(text: str) -> Iterator[list[bytes]]:
    """The words of a text, in pieces."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    lo = 0
    while lo < len(data):
        hi = data.find(b" ", lo + PIECE)
        hi = len(data) if hi < 0 else hi
        yield data[lo:hi].split()
        lo = hi


def features(text: str, longest: int = LONGEST) -> Iterator[tuple[int, list[bytes]]]:
    """For each piece of a text: how many words it adds, and the features that end in it."""
    before: list[bytes] = []
    for own in word_pieces(text):
        if longest == 1:
            yield len(own), own
            continue
        words = before + own
        runs = [b" ".join(words[e - n : e]) for e in range(len(before) + 1, len(words) + 1) for n in range(1, min(longest, e) + 1)]
        yield len(own), runs
        before = words[-(longest - 1) :]


@dataclass(frozen=True)
class Counts:
    """Features of each bucket in all texts of a table."""

    by_bucket: np.ndarray

    @property
    def total(self) -> int:
        return int(self.by_bucket.sum())


def _bucketed(texts: Iterable[str | None], buckets: Buckets, longest: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(place of the text, words, buckets of features) of each piece of each text."""
    for i, text in enumerate(texts):
        for n_words, found in features(text or "", longest):
            yield i, n_words, np.fromiter(map(buckets.__getitem__, found), np.int64, len(found))


def count_features(df: DataFrame, text: str = "text", n_buckets: int = BUCKETS, longest: int = LONGEST) -> Counts:
    """First pass: the counts of all buckets over all rows."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, buckets = np.zeros(n_buckets, np.int64), Buckets(n_buckets)
        for batch in batches:
            for _, _, found in _bucketed((x.as_py() for x in batch.column(0)), buckets, longest):
                counts += np.bincount(found, minlength=n_buckets)
        yield pa.record_batch([pa.array([counts.tobytes()], pa.binary())], ["counts"])

    parts = df.select(text_or_empty(text).alias("text")).mapInArrow(vectors, "counts binary")
    zero = df.sparkSession.sparkContext.parallelize([np.zeros(n_buckets, np.int64)], 1)
    merged = parts.rdd.map(lambda row: np.frombuffer(row[0], np.int64)).union(zero).treeReduce(np.add)
    return Counts(merged)


def gains(raw: Counts, target: Counts) -> np.ndarray:
    """floor(SCALE * ln) of the ratio of each bucket's smoothed share in the target to that in the raw texts."""
    n = len(raw.by_bucket)
    s_all, t_all = raw.total + n, target.total + n
    ratios = ((t + 1) * s_all / ((s + 1) * t_all) for s, t in zip(raw.by_bucket.tolist(), target.by_bucket.tolist(), strict=True))
    return np.array([math.floor(SCALE * math.log(r)) for r in ratios], np.int64)


def noise(key: object, seed: int = SEED) -> int:
    """floor(SCALE * g) with g from a Gumbel distribution, by a hash of the seed and the key."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(df: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """Second pass: (key, n_words, n_features, weight, score) of every row."""
    source = df.select(F.col(key), text_or_empty(text).alias("_text"))
    shared = df.sparkSession.sparkContext.broadcast(gain)
    names = [key, "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, buckets = shared.value, Buckets(len(shared.value))
        for batch in batches:
            n = batch.num_rows
            words, sizes, sums = (np.zeros(n, np.int64) for _ in range(3))
            held: list[tuple[int, np.ndarray]] = []
            n_held = 0

            def add() -> None:
                places = np.repeat([i for i, _ in held], [len(f) for _, f in held])
                weights = gain[np.concatenate([f for _, f in held])]
                # Sums of whole numbers far below 2^53: exact in doubles.
                sums[:] += np.bincount(places, weights, n).astype(np.int64)
                sizes[:] += np.bincount(places, minlength=n)

            for i, n_words, found in _bucketed((x.as_py() for x in batch.column(1)), buckets, longest):
                words[i] += n_words
                held.append((i, found))
                n_held += len(found)
                if n_held >= PIECE:
                    add()
                    held, n_held = [], 0
            if held:
                add()
            weight = np.where(sizes > 0, sums // np.maximum(sizes, 1), 0)
            score = weight + np.array([noise(k.as_py(), seed) for k in batch.column(0)], np.int64)
            yield pa.record_batch([batch.column(0), *map(pa.array, (words, sizes, weight, score))], names)

    schema = T.StructType([source.schema[key], *[T.StructField(c, T.LongType()) for c in names[1:]]])
    return source.mapInArrow(run, schema)


def draw(weighed: DataFrame, key: str = "doc_id", least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """weighed with `rank`: 1, 2, 3 ... over the drawn rows, the highest scores among those of enough words; null elsewhere."""
    enough: Column = F.col("n_words") >= least_words
    laid = ordered(weighed.withColumn("_enough", enough), F.col("_enough").desc(), F.col("score").desc(), F.col(key).asc_nulls_last())
    n = laid.rows.where("_enough").count()
    place = laid.numbered("_place")
    return place.withColumn("rank", F.when(F.col("_place") < percent * n // 100, F.col("_place") + 1)).drop("_place", "_enough")


def resample(
    df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n_buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of df; the drawn rows, those with a rank, follow the
    target's distribution of features."""
    gain = gains(count_features(df, text, n_buckets, longest), count_features(target, target_text, n_buckets, longest))
    return draw(weigh(df, gain, key, text, longest, seed), key, least_words, percent)


def drawn(df: DataFrame, resampled: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of df that were drawn: the sample itself, with all its columns."""
    return df.join(resampled.where("rank is not null").select(key), key, "left_semi").select(*df.columns)

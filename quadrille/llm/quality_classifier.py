"""Quality classifier by compression: a zstandard dictionary built from good texts and one from bad texts.

A text that resembles the good texts gets shorter with their dictionary. The difference of its two compressed sizes,
divided by its own size, is calibrated to a probability by a logistic curve that is fitted on labelled rows which neither
dictionary has seen.

Learning uses labelled rows with crc32(key as text) mod 3 other than 1, and of these a bounded sample: the SAMPLE keys of
each class that come first by their hash, whatever the lengths of their texts. The keys are chosen from the labels alone;
at most 2 * SAMPLE of them are sent to the scan of the texts. Half of them train the dictionaries: their texts, cut into
pieces of PIECE characters, are drawn by hash, SAMPLE / 2 pieces a class, so that the driver holds a bounded sample however
long a text is. The other half calibrate the curve by the differences of their whole texts, which executors compute.
Scoring compresses every whole text. Labels, language, source and key are never inputs of a score.

Defined cases: null and empty texts have difference 0 and so the curve's score at 0; without labelled rows of both
classes every score is the smoothed share of good rows; a key labelled twice counts as good only if all its labels are;
a key that stands on several rows counts with each of them; rows with a null key are scored, not held out; an empty table
gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import materialize, text_or_empty

#: Labelled keys of each class that learning takes at most, and characters of a piece of their texts.
SAMPLE, PIECE = 2500, 1 << 15
DICTIONARY_BYTES, LEVEL = 112_640, 3
FOLDS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class Model:
    """Dictionaries (none: a constant score), and the curve 1 / (1 + exp(-(slope * difference + offset)))."""

    good: bytes
    bad: bytes
    slope: float
    offset: float


def fold(key: str) -> F.Column:
    return F.crc32(F.col(key).cast("string")) % FOLDS


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    out = []
    for data in (good, bad):
        dictionary = zstandard.ZstdCompressionDict(data)
        dictionary.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=dictionary, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def differences(texts: list[str], good: bytes, bad: bytes) -> np.ndarray:
    """(size with the bad dictionary - size with the good one) / size, of each text."""
    by_good, by_bad = _compressors(good, bad)
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        if data := text.encode():
            out[i] = (len(by_bad.compress(data)) - len(by_good.compress(data))) / len(data)
    return out


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, lightly regularized; the slope is not negative."""
    scale = float(x.std()) or 1.0
    design, weights = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (p - y) + 1e-2 * weights * [1, 0]
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        weights -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, weights[0] / scale), float(weights[1])


def _dictionary(texts: list[str]) -> bytes:
    data = [t.encode() for t in texts]
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, data)) // 4))
    try:
        return zstandard.train_dictionary(size, data, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples to train on: their bytes are the dictionary
        return b"".join(data)[:DICTIONARY_BYTES]


def _pieces(rows: DataFrame) -> DataFrame:
    """(good, order, piece): the texts of rows (_id, good, text) in pieces, with the order in which they are drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2)):
                whole = str(text.as_py())
                pieces = [whole[lo : lo + PIECE] for lo in range(0, len(whole), PIECE)]
                if pieces:
                    same = [batch.column(c).take(pa.array([i] * len(pieces))) for c in (0, 1)]
                    yield pa.record_batch([*same, pa.array(range(len(pieces)), pa.int64()), pa.array(pieces)], names)

    names = ["_id", "good", "at", "piece"]
    schema = T.StructType([rows.schema["_id"], rows.schema["good"], T.StructField("at", T.LongType()), T.StructField("piece", T.StringType())])
    return rows.select("_id", "good", "text").mapInArrow(run, schema).select("good", F.xxhash64("_id", "at").alias("order"), "piece")


def _differences(rows: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """(good, order, x): the difference of every whole text of rows (order, good, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = differences([str(t.as_py()) for t in batch.column(2)], good, bad)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(x, pa.float64())], ["good", "order", "x"])

    schema = T.StructType([rows.schema["good"], rows.schema["order"], T.StructField("x", T.DoubleType())])
    return rows.select("good", "order", "text").mapInArrow(run, schema)


def _drawn(df: DataFrame, n: int, *order: str) -> list[list]:
    """The first n rows of each class, in that order: good ones, then bad ones."""
    return [df.where(F.col("good") == good).orderBy(*order).limit(n).collect() for good in (True, False)]


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") == 1).alias("good"))
    marks = marks.where(fold("_id") != HELD_OUT).withColumn("order", F.xxhash64("_id", F.lit("sample")))
    first = [marks.where(F.col("good") == good).orderBy("order", "_id").limit(SAMPLE) for good in (True, False)]
    source = df.select(F.col(key).alias("_id"), text_or_empty(text).alias("text")).where(F.col("text") != "")
    rows = materialize(source.join(F.broadcast(first[0].union(first[1])), "_id"), "sample")  # at most 2 * SAMPLE keys
    learn, check = (rows.where(F.col("order") % 2 == 0), rows.where(F.col("order") % 2 != 0))
    texts = [[r["piece"] for r in own] for own in _drawn(_pieces(learn), SAMPLE // 2, "order", "piece")]
    held = {r["good"]: r["n"] for r in check.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if not all(texts) or len(held) < 2:
        n_good, n = rows.where("good").count(), rows.count()
        share = (n_good + 1) / (n + 2)
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    good, bad = map(_dictionary, texts)
    drawn = _drawn(_differences(check, good, bad), SAMPLE, "order", "x")
    x, y = zip(*((r["x"], float(r["good"])) for own in drawn for r in own), strict=True)
    return Model(good, bad, *_curve(np.array(x), np.array(y)))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every whole text."""
    source = df.select(F.col(key), F.coalesce(fold(key) == HELD_OUT, F.lit(False)).alias("held_out"), text_or_empty(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [str(x.as_py()) for x in batch.column(2)]
            x = differences(texts, model.good, model.bad) if model.good else np.zeros(len(texts))
            scores = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -40, 40)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], [key, "held_out", "score"])

    schema = T.StructType([source.schema[key], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

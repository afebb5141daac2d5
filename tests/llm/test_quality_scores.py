"""The quality classifier recomputed plainly: which texts it learns from, its curve, and every score."""

import math
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from quadrille.llm import quality_classifier as qc
from quadrille.llm.common import table

SF = "/root/testdata/sf0.001"


def sizes(text, dictionary):
    data = zstandard.ZstdCompressionDict(dictionary)
    return len(zstandard.ZstdCompressor(dict_data=data, level=qc.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text.encode()))


def difference(text, model):
    return (sizes(text, model.bad) - sizes(text, model.good)) / len(text.encode()) if text else 0.0


def test_scores_against_a_plain_version(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = qc.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = {r["doc_id"]: r for r in qc.score(docs, model).collect()}
    assert set(rows) == set(texts)
    for key, text in texts.items():
        expected = 1 / (1 + math.exp(-(model.slope * difference(text, model) + model.offset)))
        assert rows[key]["score"] == pytest.approx(expected, abs=1e-9) and rows[key]["predicted"] == int(expected >= 0.5)
        assert rows[key]["held_out"] == (zlib.crc32(str(key).encode()) % 3 == 1)
    # The curve is least in the penalized loss over the labelled texts that may be learned from and are not in the dictionaries.
    order = {r["doc_id"]: r["o"] for r in labels.select("doc_id", F.xxhash64("doc_id", F.lit("sample")).alias("o")).distinct().collect()}
    quality = {}
    for r in labels.collect():
        quality[r["doc_id"]] = min(quality.get(r["doc_id"], 1), r["quality"])
    sample = [(difference(texts[k], model), q) for k, q in quality.items() if zlib.crc32(str(k).encode()) % 3 != 1 and order[k] % 2 and texts.get(k)]
    assert len({q for _, q in sample}) == 2
    mean = sum(x for x, _ in sample) / len(sample)
    scale = math.sqrt(sum((x - mean) ** 2 for x, _ in sample) / len(sample))

    def loss(slope, offset):
        z = [slope * x + offset for x, _ in sample]
        return sum(math.log1p(math.exp(-abs(v))) + max(v, 0) - q * v for v, (_, q) in zip(z, sample)) + 0.5e-2 * (slope * scale) ** 2

    best = loss(model.slope, model.offset)
    for ds, do in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)):
        assert loss(model.slope + ds / scale, model.offset + do) >= best - 1e-9

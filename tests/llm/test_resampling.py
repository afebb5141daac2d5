"""Importance resampling against a plain version, and on its defined cases."""

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quadrille.llm import resampling
from quadrille.llm.queries import op11_importance_resampling
from quadrille.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, words int, rank string, weight int, _text string"


def plain(docs, target, longest=1, buckets=10_000, least=20):
    def feats(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    own = [(k, *feats(t)) for k, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, fs in own:
        for f in fs:
            s[f] += 1
    for text in target:
        for f in feats(text)[1]:
            t[f] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows, enough = [], []
    for k, n, fs in own:
        w = sum(gain[f] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([k, len(fs), w, score, None])
        if n >= least:
            enough.append(rows[-1])
    enough.sort(key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for i, r in enumerate(enough[: 10 * len(enough) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, rows), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_on_whole_tables(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    items = [r[0] for r in table(spark, SF, "benchmark").select("text").collect()]
    expected = plain(docs, items)
    assert found(op11_importance_resampling(spark, SF)) == expected
    assert sum(r[4] is not None for r in expected) > 5


TEXTS = [None, "", "  ", "a b c", "A1 é_x Ünder\tS-t\x00q\x7fz 漢字 B" * 9, "of the " * 40_000, "x" * 300_000, "one two three " * 30]


@pytest.mark.parametrize("longest", [1, 3])
@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_defined_cases(spark, monkeypatch, longest, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    texts = [t[:900] if piece == 7 and t else t for t in TEXTS] + [f"word{i} the of and {i} " * 8 for i in range(40)]
    rows = [(i if i else None, t, 1, "r", 2, "u") for i, t in enumerate(texts)]
    rows += rows[-3:]
    docs, target = spark.createDataFrame(rows, SCHEMA).repartition(3), ["one two, the of", None, ""]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    result = resampling.resample(docs, items, longest=longest)
    assert found(result) == plain([r[:2] for r in rows], target, longest)
    kept = resampling.drawn(docs, result)
    assert kept.columns == docs.columns and kept.count() >= 4


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b " * 20, 1, "", 1, "")], SCHEMA)
    assert found(resampling.resample(docs, items.limit(0))) == plain([(1, "a b " * 20)], [])


def test_draw_follows_the_target(spark):
    texts = [("target words here " if i % 4 == 0 else "other stuff there ") * 10 for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([("target words here " * 50,)], "text string")
    ranked = resampling.resample(docs, items).where("rank is not null")
    assert ranked.count() == 40 and ranked.where(F.col("doc_id") % 4 == 0).count() >= 38

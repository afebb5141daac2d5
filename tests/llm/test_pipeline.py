"""The pipeline against a plain version of its five stages, on the smallest tables."""

import hashlib
import os
import re

import duckdb
import pytest
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import bpe
from tests.llm.test_llm import ASSIGN, brute_fingerprint, brute_measures

SF = "/root/testdata/sf0.001"


def masked(text):
    spans = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}", text)]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_pipeline(spark):
    documents = duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet' order by 1").fetchall()
    items = [t for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    kept = [(i, t) for i, t in documents if not brute_measures(t)[-1]]  # too few labels here for further cutoffs
    prints = [brute_fingerprint(t) for _, t in kept]
    group = list(range(len(kept)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(kept)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                group[y] = x
    kept = [kept[i] for i in range(len(kept)) if find(i) == i]
    kept = [(i, masked(t)) for i, t in kept if not any(x in t for x in items)]
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {i: hashlib.sha256(" ".join(map(str, encoding.encode_ordinary(t))).encode()).hexdigest() for i, t in kept}
    found = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert found == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scans", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns


def tables(spark, folder, labels=(), items=()):
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def text(k, n=60):
    return " ".join(f"w{k}x{i}" for i in range(n))


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _found string, _blob string, _later string, _own_0 string, blob_id string, n_words string, text_id string"


def test_defined_cases_of_every_stage(spark, tmp_path):
    passage = text("item", 30)
    rows = [
        (1, text("a")), (2, text("a") + " tail"), (None, text("a") + " tail"), (None, text("b")), (3, None), (4, ""), (5, text("c")), (5, text("d")), (6, text("e")), (6, text("e")),
        (7, f"{text('f')} {passage} {text('g')}"), (8, f"{text('h')} token=abcdefgh1 é"), (9, text("i", 60_000)), (10, f"{text('h')} token=abcdefgh1 é"),
    ]
    docs = spark.createDataFrame([(k, t, None if k == 8 else "en", "s", len(t or ""), *["own"] * 8) for k, t in rows], EXTRA)
    folder = tables(spark, tmp_path / "in", [(1, 1, 0), (1, 0, 0), (None, 1, 0)], [(1, passage), (2, None), (None, "x")])
    want = {
        "quality_rules": [(k, t) for k, t in rows if t],
        "near_duplicates": [(1, text("a")), (None, text("b")), (3, None), (5, text("c")), (5, text("d")), (6, text("e")), rows[10], rows[11], rows[12]],
        "decontamination": [r for r in rows if r[0] != 7],
        "secret_scans": [(k, t and t.replace("token=abcdefgh1", "[SECRET]")) for k, t in rows],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        found = out.collect()
        assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(want[name], key=str), name
        assert all(r[5:] == ("own",) * 8 for r in found)
        assert stage(spark, docs.limit(0), folder).count() == 0
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(encoded) == len(rows) and sorted(r.n_tokens for r in encoded)[:2] == [0, 0]
    none = tables(spark, tmp_path / "none")
    assert corpus_pipeline.quality(spark, docs, none).count() == 12 and corpus_pipeline.benchmark_overlap(spark, docs, none).count() == len(rows)


def test_a_ledger_that_outlives_a_run(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token=abcdefgh1"), (2, "clean")], "doc_id long, text string").withColumn("n_chars", F.lit(0).cast("long"))
    spark.conf.set(corpus_pipeline.LEDGER, f"{tmp_path}/ledger")
    try:
        for rows in (docs, docs.unionByName(docs.withColumn("text", F.lit("new")))):
            out = corpus_pipeline.mask_secrets(spark, rows, "").collect()
            assert next(r for r in out if r.doc_id == 1).text in ("[SECRET]", "new") and len(out) == rows.count()
        assert spark.read.parquet(f"{tmp_path}/ledger/scanned").count() == 3
    finally:
        spark.conf.unset(corpus_pipeline.LEDGER)

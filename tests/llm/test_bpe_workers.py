"""One Python worker a task encodes and decodes."""

import public_tokenizers

from quadrille.llm import bpe


def test_one_pass_gives_what_two_give(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.createDataFrame([(1, "Hello, world: grüße 12345"), (2, ""), (3, None), (3, "a" * 500), (None, "x")], "doc_id long, text string")
    two = bpe.decode(bpe.encode(docs, path, pattern), path, keep=("ids",)).select("doc_id", "ids", "decoded")
    one = bpe.encode_decode(docs, path, pattern)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert bpe.digests(docs, path, pattern)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1

"""The corpus pipeline: five stages over documents, each a training-data operator, each written and read again.

Quality rules drop what they reject; near-duplicate groups keep one document, the one of the least id; documents that
overlap the benchmark are dropped; secrets are masked in the text (and n_chars counts the masked text); the last stage
encodes what is left. A stage sees all that its predecessor kept.

Secrets are looked up in the ledger at the session's setting LEDGER, so that a later run scans only texts that no run has
seen; without the setting each run has a ledger of its own.

Defined cases, for every stage: columns beyond those of documents pass through whatever their names are; a null text is
empty (quality rules drop it); a null language is a language of its own; rows with null or repeated ids are judged by
themselves, and of rows equal in id and text one is kept; without labels only the base rule judges, without benchmark items
nothing is dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import bpe, decontaminate, quality_rules, secrets, simhash
from quadrille.llm.common import materialize, scratch, table


#: Setting of the session: the folder of a ledger of scanned texts, on shared storage, that outlives a run.
LEDGER = "spark.quadrille.ledger"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def benchmark_overlap(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs, spark.conf.get(LEDGER, None) or scratch(spark, "ledger"))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_overlap),
    ("secret_scans", mask_secrets),
    ("byte_bpe", encode),
]

#: Stages 2, 3 and 5 are beyond SQL; tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

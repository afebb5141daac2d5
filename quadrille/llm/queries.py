"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import bpe, decontaminate, hard_negatives, html_extract, pii, quality_classifier, quality_rules, resampling, secrets, simhash, token_blocks, token_counts
from quadrille.llm.common import scratch, table, text_or_empty
from quadrille.llm.sharding import ShardStore


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_classifier.score(documents, quality_classifier.fit(documents, table(spark, sf_dir, "labels")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-blocks")
    token_blocks.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return token_blocks.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids_le32").alias("ids_crc32"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The documents arrive in so many batches.
ARRIVALS = 4


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends all documents in batches, compacts, and reads the committed version back."""
    store = ShardStore(spark, scratch(spark, "shards"))
    documents = table(spark, sf_dir, "documents")
    arrival = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(ARRIVALS))
    for batch in range(ARRIVALS):
        store.append(documents.where(arrival == batch))
    stored = store.read(store.compact_fully())
    return stored.select("doc_id", F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes"), F.sha2(text_or_empty("text"), 256).alias("text_sha256"), "lang", "source", "n_chars")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents"), scratch(spark, "ledger")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", turned), F.col("vec_id") % 100 == 0)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.report(pii.find_pii(documents, pii.fit(documents)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [
        op1_byte_bpe,
        op2_quality_classifier,
        op3_simhash,
        op4_token_counts,
        op5_token_blocks,
        op6_html_extract,
        op7_quality_rules,
        op8_sharding,
        op9_secret_scans,
        op10_decontaminate,
        op11_importance_resampling,
        op12_hard_negatives,
        op13_pii,
    ]
    return {f.__name__: f for f in every}


def _spans_sql(rank: int, rule: secrets.Rule) -> str:
    """DuckDB: (doc, kind, start, end) of a rule, from the lengths of what stands between and in its matches. DuckDB's
    expressions cannot look behind: there a match takes the character before it too, which does not count."""
    pattern = (f"(?:^|[^{rule.apart}])" if rule.apart else "") + rule.pattern.replace("'", "''")
    before = f" + (regexp_matches(found[i], '^[^{rule.apart}]'))::int" if rule.apart else ""
    sums = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
    matches = f"""select doc, string_split_regex(body, '{pattern}') as gaps, regexp_extract_all(body, '{pattern}', 0) as found, regexp_extract_all(body, '{pattern}', {rule.group}) as part
        from d where regexp_matches(body, '{pattern}')"""
    return f"""select doc, {rank} as rank, '{rule.kind}' as kind, {sums.format("gaps[1:i]")} + {sums.format("found[1:i-1]")}{before} as s, {sums.format("gaps[1:i]")} + {sums.format("found[1:i]")} as e
        from (select *, unnest(range(1, len(found) + 1)) as i from ({matches})) where length(part[i]) >= {rule.least}"""


def _secrets_sql() -> str:
    base = ", ".join(f"'{r.kind}'" for r in secrets.RULES if r.base)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secrets.RULES if r.base)
    listed = "coalesce(string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, rank){0}, '')"
    return f"""with d as (select row_number() over () as doc, doc_id, coalesce(text, '') as body from documents),
        spans as ({" union all ".join(_spans_sql(i, r) for i, r in enumerate(secrets.RULES))})
        select any_value(doc_id) as doc_id, {counts}, sha256({listed.format(f" filter (kind in ({base}))")}) as base_sha256, {listed.format("")} as spans
        from d left join spans using (doc) group by doc"""


_NEGATIVES_SQL = """with e as materialized (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
        where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (select a.r as anchor, a.vec_id as anchor_id, b.vec_id, b.r, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
        from e a join e b on a.vec_id % 100 = 0 and a.r <> b.r),
    positives as (select * from scored where same qualify row_number() over (partition by anchor order by score desc, vec_id, r) <= 5)
    select p.anchor_id, p.vec_id as positive_id, (row_number() over (partition by p.anchor, p.r order by n.score desc, n.vec_id, n.r))::int as rank, n.vec_id as negative_id,
        p.score as positive_score, n.score as negative_score
    from positives p join scored n on p.anchor = n.anchor and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
    qualify row_number() over (partition by p.anchor, p.r order by n.score desc, n.vec_id, n.r) <= 10"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; tests hold the others against brute force."""
    return {
        "op8_sharding": "select doc_id, strlen(coalesce(text, '')) as n_bytes, sha256(coalesce(text, '')) as text_sha256, lang, source, n_chars from documents",
        "op9_secret_scans": _secrets_sql(),
        "op12_hard_negatives": _NEGATIVES_SQL,
    }

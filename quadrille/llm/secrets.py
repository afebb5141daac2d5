"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of a text is addressed by the SHA-256 of its content. The ledger is a folder on shared storage with two
tables: `scanned` (blob_id, rule versions that it was scanned with) and `findings` (blob_id, rule version, span). A scan
drops the (blob, rule version) pairs that the ledger has, runs only the rest, appends to the ledger, and joins findings back
to every path that has the blob. Findings are written before `scanned`: after a crash between the two the blob is scanned
again, and equal findings count once.

Texts are scanned where they are: a bitmap of the ledger's blobs tells most new ones at once, and only texts that the ledger
knows but that newer rules have not seen are joined with it. Copies within one batch give equal findings, which are made one
before the shuffle. Every rule reads a text in time linear in its length.

Matches are leftmost and not overlapping, per rule; a match whose measured part is too short is dropped after matching.
Positions are code points, end exclusive: the lengths of the stretches between matches and of the matches, summed in
order (a window over one blob's matches, so linear however many there are). The ledger keeps positions in bytes as well,
with which redaction cuts a text without counting its characters again for each span.

Defined cases: a null text is scanned as the empty text; equal texts are scanned once and reported for every row; null
and repeated keys pass through row by row; an empty table gives an empty table; extra columns are not read, and redact()
returns them whatever their names are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quadrille.llm.common import marked, materialize, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A pattern; matches count if the given group has at least so many characters. No character of the class `apart`, in
    which the match begins, stands directly before a match. A new version is a new rule to the ledger."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = False
    version: int = 1
    apart: str = ""

    @property
    def bounded(self) -> str:
        return f"(?<![{self.apart}]){self.pattern}" if self.apart else self.pattern

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed values of the base rules, in their order; after them, rules that the method adds.
RULES = (
    Rule("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, base=True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, base=True),  # the runs of [0-9a-f]+ that are long enough
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, version=2, apart="A-Za-z0-9_-"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)


def _exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _matches(text: Column, rule: Rule) -> Column:
    """array<struct<gap, length, measured, gap_bytes, length_bytes>>: the lengths of what stands before each match, of the
    match, and of its measured part."""
    pattern = F.lit(rule.bounded)
    parts = F.arrays_zip(
        F.split(text, rule.bounded, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"),
    )
    matched = F.filter(parts, lambda x: x["found"].isNotNull())  # the last stretch has no match after it
    sizes = lambda x: F.struct(
        F.length(x["gap"]).alias("gap"),
        F.length(x["found"]).alias("length"),
        F.length(x["part"]).alias("measured"),
        F.octet_length(x["gap"]).alias("gap_bytes"),
        F.octet_length(x["found"]).alias("length_bytes"),
    )
    return F.transform(matched, sizes)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob_id, rule, kind, start, end, first_byte, end_byte) of blobs (blob_id, text, todo array<string> of rule ids), once
    for all rows of a blob."""
    text = F.col("text")
    kinds = []
    for rule in rules:
        due = F.array_contains("todo", rule.id) & text.rlike(rule.bounded)
        kinds.append(F.when(due, F.struct(F.lit(rule.id).alias("rule"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), _matches(text, rule).alias("m"))))
    hit = blobs.select("blob_id", F.explode(F.array_compact(F.array(*kinds))).alias("k"))
    rows = hit.select("blob_id", "k.rule", "k.kind", "k.least", F.posexplode("k.m").alias("i", "m")).dropDuplicates(["blob_id", "rule", "i"])
    upto = Window.partitionBy("blob_id", "rule").orderBy("i")
    ended = F.sum(F.col("m.gap") + F.col("m.length")).over(upto)
    ended_bytes = F.sum(F.col("m.gap_bytes") + F.col("m.length_bytes")).over(upto)
    spans = rows.select("blob_id", "rule", "kind", "least", "m", ended.alias("end"), ended_bytes.alias("end_byte"))
    start, first_byte = F.col("end") - F.col("m.length"), F.col("end_byte") - F.col("m.length_bytes")
    return spans.where(F.col("m.measured") >= F.col("least")).select("blob_id", "rule", "kind", start.alias("start"), "end", first_byte.alias("first_byte"), "end_byte")


def addressed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key), text_or_empty(text).alias("text")).withColumn("blob_id", F.unhex(F.sha2("text", 256)))


def update_ledger(df: DataFrame, ledger: str, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at that path has not seen; returns the ledger's findings (blob_id, kind, start, end,
    first_byte, end_byte) of `rules`."""
    spark = df.sparkSession
    every = F.array(*[F.lit(r.id) for r in rules])
    versions = addressed(df, key, text).select("blob_id", "text")
    scanned = _exists(spark, f"{ledger}/scanned")
    due = versions.withColumn("todo", every)
    if scanned is not None:
        seen = materialize(scanned.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen")), "seen")
        told = marked(versions, "blob_id", seen.select("blob_id"))
        known = told.where("_set").drop("_set")
        todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")
        lacking = known.select("blob_id").distinct().join(seen, "blob_id", "left").select("blob_id", todo).where(F.size("todo") > 0)
        lacking = materialize(lacking, "lacking")
        again = marked(known, "blob_id", lacking.select("blob_id")).where("_set").drop("_set").join(lacking, "blob_id")
        due = told.where("not _set").drop("_set").withColumn("todo", every).unionByName(again)
    scan(due, rules).write.mode("append").parquet(f"{ledger}/findings")
    due.select("blob_id", "todo").distinct().select("blob_id", F.col("todo").alias("rules")).write.mode("append").parquet(f"{ledger}/scanned")
    found = spark.read.parquet(f"{ledger}/findings")
    return found.where(F.col("rule").isin([r.id for r in rules])).drop("rule").distinct()


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(df: DataFrame, ledger: str, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, found array<struct<start, rank, kind, end>>) of every row: its spans by start, then by order of the rules."""
    findings = update_ledger(df, ledger, key, text, rules)
    ranks = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    span = F.struct("start", ranks[F.col("kind")].alias("rank"), "kind", "end")
    by_blob = materialize(findings.groupBy("blob_id").agg(F.sort_array(F.collect_list(span)).alias("found")), "spans")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return addressed(df, key, text).select(key, "blob_id").join(by_blob, "blob_id", "left").select(key, F.coalesce("found", none).alias("found"))


def report(found: DataFrame, key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, count of each base kind, base_sha256, spans) of what find_secrets() gives."""
    base = [r.kind for r in rules if r.base]
    of_kind = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("found", lambda s: s["kind"].isin(base))
    return found.select(key, *map(of_kind, base), F.sha2(_listed(own), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def redact(df: DataFrame, ledger: str, key: str = "doc_id", text: str = "text", mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with every found span of its text replaced by `mask`; overlapping spans become one. Null texts stay null."""
    findings = update_ledger(df, ledger, key, text, rules)
    # What stays before a span: from the end of all spans before it, if that is not beyond its start.
    before = Window.partitionBy("blob_id").orderBy("first_byte", "end_byte", "kind").rowsBetween(Window.unboundedPreceding, -1)
    gaps = findings.withColumn("at", F.coalesce(F.max("end_byte").over(before), F.lit(0)))
    gap = F.when(F.col("first_byte") >= F.col("at"), F.struct("at", (F.col("first_byte") - F.col("at")).alias("n")))
    by_blob = gaps.groupBy("blob_id").agg(F.sort_array(F.collect_list(gap)).alias("gaps"), F.max("end_byte").alias("tail"))
    by_blob = materialize(by_blob, "spans")
    own = {c: f"_own_{i}" for i, c in enumerate(df.columns)}
    body = F.col(own[text])
    data = body.cast("string").cast("binary")
    stretch = lambda at, n: F.substr(data, (at + 1).cast("int"), n.cast("int")).cast("string")
    kept = F.concat(F.transform("gaps", lambda g: stretch(g["at"], g["n"])), F.array(stretch(F.col("tail"), F.octet_length(data) - F.col("tail"))))
    clean = F.when(F.col("gaps").isNull(), body).otherwise(F.array_join(kept, mask))
    rows = df.select(*[F.col(c).alias(o) for c, o in own.items()], F.unhex(F.sha2(text_or_empty(text), 256)).alias("blob_id"))
    # Texts without findings stay where they are.
    told = marked(rows, "blob_id", by_blob.select("blob_id"))
    joined = told.where("_set").drop("_set").join(by_blob, "blob_id", "left").unionByName(told.where("not _set").drop("_set"), allowMissingColumns=True)
    return joined.select(*[(clean if c == text else F.col(o)).alias(c) for c, o in own.items()])

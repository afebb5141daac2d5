"""Turtle files of any size, cut into documents at ends of statements by a parallel scan.

A file is read as lines in as many blocks as Spark splits it into. Only a long string reaches over the end of a line, so a
block's lexical state is one of three, and a block is a function from the state at its start to that at its end: the first
scan works that out for each block by itself, and the functions compose along each file. The second scan knows the state at
its start. It cuts a block behind lines that end a statement, about every SEGMENT characters, and notes the prefixes and bases
that hold at each cut. What stands before a block's first cut goes to the last segment of the block before; only these
fragments move. Prefixes and bases at the start of a block come from all blocks before it, again by composition; written in
front of each segment, they make it a document of its own.

Driver and tasks hold a row for each block, never the text of more than a segment and a line; a statement is as long as its
segment at least.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.storage import checkpointed

#: Characters of a segment, about.
SEGMENT = 1 << 16
#: Lexical states at the start of a line: none, or inside a long string with these quotes.
NORMAL, QUOTES = 0, {1: '"""', 2: "'''"}

_REST = {1: re.compile(r'(?:[^"\\]++|\\.|\\$|"(?!""))*+"""'), 2: re.compile(r"(?:[^'\\]++|\\.|\\$|'(?!''))*+'''")}
#: Tokens as far as ends of statements and directives need them: strings that stay open come after those that end.
_LEX = re.compile(
    r"""(?P<comment>\#.*)|(?P<iri><[^<>"{}|^`\s]*>)|(?:\"{3}(?:[^"\\]++|\\.|"(?!""))*+\"{3})|(?:'{3}(?:[^'\\]++|\\.|'(?!''))*+'{3})|(?P<open1>\"{3}.*)|(?P<open2>'{3}.*)"""
    r"""|"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'|(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:[\w:%](?:[\w.:%-]*[\w:%-])?)?)|(?P<word>@?[^\W\d_](?:[\w.-]*[\w-])?)|_:\w(?:[\w.-]*[\w-])?"""
    r"""|[+-]?(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+|[+-]?\d*\.\d+|(?P<dot>\.)|\S""",
    re.X,
)
_DIRECTIVE = re.compile(r"(?<![\w:])@?(?:prefix|base)\b", re.I)
_ABSOLUTE = re.compile(r"<[A-Za-z][\w+.-]*:")


def after(line: str, state: int) -> int:
    """The state after a line that begins in a state."""
    at = 0
    if state:
        if QUOTES[state] not in line or not (ended := _REST[state].match(line)):
            return state
        at = ended.end()
    if '"""' not in line and "'''" not in line:
        return NORMAL
    for m in _LEX.finditer(line, at):
        if m.lastgroup in ("open1", "open2"):
            return int(m.lastgroup[-1])
    return NORMAL


def tokens(line: str, state: int) -> Iterator[tuple[str, str]]:
    """(group, text) of the tokens of a line that begins in a state."""
    if state:
        ended = _REST[state].match(line)
        if not ended:
            return
        yield "string", ""
        line = line[ended.end() :]
    for m in _LEX.finditer(line):
        if m.lastgroup != "comment":
            yield m.lastgroup or "", m[0]


class Environment:
    """The directives that hold, in order: of each prefix the last one, and the bases."""

    def __init__(self, text: str = ""):
        self.said: list[tuple[str, str]] = []
        self.pending: list[str] = []
        for line in text.splitlines():
            name, iri = line.split(" ", 1)
            self.add(name, iri)

    def add(self, name: str, iri: str) -> None:
        """A prefix (with its colon), or "@base"."""
        if (name, iri) in self.said and _ABSOLUTE.match(iri) and (name != "@base" or [x for x in self.said if x[0] == name][-1][1] == iri):
            return
        self.said = [x for x in self.said if name == "@base" or x[0] != name] + [(name, iri)]
        if name == "@base" and _ABSOLUTE.match(iri) and all(_ABSOLUTE.match(i) for n, i in self.said if n != "@base"):
            self.said = [x for x in self.said if x[0] != name] + [(name, iri)]

    def read(self, line: str, state: int) -> None:
        if self.pending or _DIRECTIVE.search(line):
            for kind, text in tokens(line, state):
                self.take(kind, text)

    def take(self, kind: str, text: str) -> None:
        """The next token; `pending` is a directive so far."""
        if self.pending:
            self.pending.append(text)
            if kind == "iri":
                self.add(self.pending[1] if len(self.pending) == 3 else "@base", text)
                self.pending = []
            elif kind != "name" or len(self.pending) > 2:
                self.pending = []
        elif kind == "word" and text.lower().lstrip("@") in ("prefix", "base"):
            self.pending = [text]

    def text(self) -> str:
        return "\n".join(f"{name} {iri}" for name, iri in self.said)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc, block, value) in the order of the files; lines end with a line feed alone."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str | None]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], list[int]] = {}
    for doc, block, line in _by_block(batches):
        states = found.setdefault((doc, block), [0, 1, 2])
        if '"""' in line or "'''" in line:
            states[:] = [after(line, s) for s in states]
    rows = [(*k, *v) for k, v in found.items()]
    yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), *[pa.int32()] * 3))], ["doc", "block", "s0", "s1", "s2"])


def _starts(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each block of a file."""
    blocks, state, states = blocks.sort_values("block"), NORMAL, []
    for row in blocks.itertuples():
        states.append(state)
        state = (row.s0, row.s1, row.s2)[state]
    return blocks[["doc", "block"]].assign(state=states)


def _chained(blocks: pd.DataFrame) -> pd.DataFrame:
    """What holds at the start of each block of a file, and the segment that the block's first fragment belongs to."""
    blocks, environment, open_, rows = blocks.sort_values("block"), Environment(), None, []
    for row in blocks.itertuples():
        target = open_ or (row.block, 0)
        for token in row.lead.splitlines():  # the end of a directive that began before the block
            if environment.pending:
                environment.take(*token.split(" ", 1))
        rows.append((row.doc, row.block, row.n, environment.text(), *target))
        open_ = (row.block, row.n - 1) if row.n > 1 else target
        environment.pending = row.pending.split() or environment.pending
        for line in row.environment.splitlines():
            environment.add(*line.split(" ", 1))
    return pd.DataFrame(rows, columns=["doc", "block", "n", "before", "to_block", "to_ordinal"])


_PART = "doc string, block bigint, ordinal int, environment string, text string"


def segments(spark: SparkSession, path: str, size: int = SEGMENT) -> DataFrame:
    """(doc, scope, text): documents of whole statements from the files of a path; `scope` is the path."""
    lines = _lines(spark, path)
    functions = checkpointed(lines.mapInArrow(_functions, "doc string, block bigint, s0 int, s1 int, s2 int"), "states")
    starts = functions.groupBy("doc").applyInPandas(_starts, "doc string, block bigint, state int").where("state <> 0")
    inside = {(r["doc"], r["block"]): r["state"] for r in starts.collect()}  # blocks that begin in a long string

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of each block; an ordinal of -1 has the block's own directives, and as text the number of its segments,
        the directive that it leaves unfinished and its first tokens."""
        key, rows = None, []
        schema = pa.schema([("doc", pa.string()), ("block", pa.int64()), ("ordinal", pa.int32()), ("environment", pa.string()), ("text", pa.string())])
        batch = lambda: pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

        def end() -> None:
            if key is not None:
                rows.append((*key, ordinal, noted, "\n".join(held)))
                rows.append((*key, -1, own.text(), "\n".join([str(ordinal + 1), " ".join(own.pending), *lead])))

        for doc, block, line in _by_block(batches):
            if (doc, block) != key:
                end()
                key, state, ordinal, own, noted, held, n, lead = (doc, block), inside.get((doc, block), NORMAL), 0, Environment(), "", [], 0, []
            if len(lead) < 2:
                lead += [f"{kind} {text}" for kind, text in islice(tokens(line, state), 2)]
            held.append(line)
            n += len(line)
            own.read(line, state)
            if (n >= size or not ordinal) and "." in line:
                kinds = [k for k, _ in tokens(line, state)]
                if kinds and kinds[-1] == "dot":
                    rows.append((*key, ordinal, noted, "\n".join(held)))
                    ordinal, noted, held, n = ordinal + 1, own.text(), [], 0
                    if len(rows) >= 64:
                        yield batch()
                        rows = []
            state = after(line, state)
        end()
        yield batch()

    parts = checkpointed(lines.mapInArrow(cut, _PART), "segments")
    said = F.split("text", "\n", 3)
    lead = F.coalesce(F.get(said, 2), F.lit("")).alias("lead")
    sizes = parts.where("ordinal = -1").select("doc", "block", "environment", F.get(said, 0).cast("int").alias("n"), F.get(said, 1).alias("pending"), lead)
    chained = sizes.groupBy("doc").applyInPandas(_chained, "doc string, block bigint, n int, before string, to_block bigint, to_ordinal int")
    placed = parts.where("ordinal >= 0").join(checkpointed(chained, "blocks"), ["doc", "block"])
    first, last = F.col("ordinal") == 0, F.col("ordinal") == F.col("n") - 1
    holds = F.concat_ws("\n", F.nullif("before", F.lit("")), F.nullif("environment", F.lit(""))).alias("holds")
    whole = placed.where(~first & ~last).select("doc", F.col("block").alias("to_block"), F.col("ordinal").alias("to_ordinal"), holds, "text")
    fragments = placed.where(first | last).select(
        "doc", F.when(first, F.col("to_block")).otherwise(F.col("block")).alias("to_block"), F.when(first, F.col("to_ordinal")).otherwise(F.col("ordinal")).alias("to_ordinal"), holds, "block", "ordinal", "text"
    )
    joined = fragments.groupBy("doc", "to_block", "to_ordinal").agg(F.min_by("holds", F.struct("block", "ordinal")).alias("holds"), F.sort_array(F.collect_list(F.struct("block", "ordinal", "text"))).alias("t"))
    every = whole.unionByName(joined.select("doc", "to_block", "to_ordinal", "holds", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text")))
    directives = F.transform(F.filter(F.split("holds", "\n"), lambda x: x != ""), lambda x: F.concat(F.when(~F.startswith(x, F.lit("@base ")), F.lit("@prefix ")).otherwise(""), x, F.lit(" .\n")))
    own = F.concat_ws("#", "doc", "to_block", "to_ordinal").alias("doc")
    return every.select(own, F.lit(path).alias("scope"), F.concat(F.array_join(directives, ""), "text").alias("text"))

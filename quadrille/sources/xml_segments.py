"""RDF/XML files of any size, cut into documents between top-level nodes by a parallel scan.

As for Turtle (segments), a file is read as lines in blocks. A block is a function from the lexical state at its start (in
text, a comment, a tag, a quoted value ...) to the state at its end and a change of depth; the functions compose along each
file. The second scan cuts behind lines that end in text directly below the root, about every SEGMENT characters. The root's
start tag, with all that stands before it, goes in front of each segment and its end tag behind, so that namespaces, entities,
base and language hold in each. Only what stands before a block's first cut moves.

A file whose root is no rdf:RDF is one document, and so is a node of any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.sources.segments import SEGMENT, _by_block, _lines
from quadrille.storage import checkpointed

TEXT, COMMENT, CDATA, INSTRUCTION, OPEN, DOUBLE, SINGLE, CLOSE, DOCTYPE, SUBSET = STATES = range(10)
#: What ends each state but those of tags, and the state after it.
_ENDS = {COMMENT: ("-->", TEXT), CDATA: ("]]>", TEXT), INSTRUCTION: ("?>", TEXT), DOUBLE: ('"', OPEN), SINGLE: ("'", OPEN), CLOSE: (">", TEXT)}
_STARTS = (("<!--", COMMENT), ("<![CDATA[", CDATA), ("<?", INSTRUCTION), ("<!", DOCTYPE), ("</", CLOSE), ("<", OPEN))
_IN_TAG, _IN_DOCTYPE, _SUBSET_END = re.compile("[\"'>]"), re.compile(r"[\[>]"), re.compile(r"\]\s*>")
_ROOT = re.compile(r"<([^\s<>/!?][^\s<>/]*)[^<]*>\Z")


def after(line: str, state: int) -> tuple[int, int, int]:
    """(state, change of depth, place behind the first start tag that opens an element or -1) after a line."""
    at, depth, opened = 0, 0, -1
    while True:
        if state == TEXT:
            at = line.find("<", at)
            if at < 0:
                return state, depth, opened
            mark, state = next(x for x in _STARTS if line.startswith(x[0], at))
            at += len(mark)
        elif state == OPEN:
            if not (m := _IN_TAG.search(line, at)):
                return state, depth, opened
            at = m.end()
            state = {'"': DOUBLE, "'": SINGLE, ">": TEXT}[m[0]]
            if state == TEXT and line[: at - 1][-1:] != "/":
                depth += 1
                opened = at if opened < 0 else opened
        elif state in (DOCTYPE, SUBSET):
            if not (m := (_IN_DOCTYPE if state == DOCTYPE else _SUBSET_END).search(line, at)):
                return state, depth, opened
            at, state = m.end(), SUBSET if m[0] == "[" else TEXT
        else:
            mark, then = _ENDS[state]
            found = line.find(mark, at)
            if found < 0:
                return state, depth, opened
            depth -= state == CLOSE
            at, state = found + len(mark), then


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and state at its start, the state and change of depth at its end."""
    found: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for doc, block, line in _by_block(batches):
        ends = found.setdefault((doc, block), [(s, 0) for s in STATES])
        step = {s: after(line, s) for s in {s for s, _ in ends}}  # states soon become few
        ends[:] = [(step[s][0], d + step[s][1]) for s, d in ends]
    rows = [(*k, [s for s, _ in v], [d for _, d in v]) for k, v in found.items()]
    yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))], ["doc", "block", "ends", "depths"])


def _starts(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state and depth at the start of each block of a file."""
    blocks, state, depth, rows = blocks.sort_values("block"), TEXT, 0, []
    for row in blocks.itertuples():
        rows.append((row.doc, row.block, state, depth))
        state, depth = int(row.ends[state]), depth + int(row.depths[state])
    return pd.DataFrame(rows, columns=["doc", "block", "state", "depth"])


def _chained(blocks: pd.DataFrame) -> pd.DataFrame:
    """The root's start and name, and the segment that the block's first fragment belongs to; all is one segment where the
    root is no rdf:RDF."""
    blocks = blocks.sort_values("block")
    head = blocks["head"].iloc[0] or ""
    root = _ROOT.search(head)
    cut, open_, rows = bool(root) and root[1].split(":")[-1] == "RDF", None, []
    for row in blocks.itertuples():
        target = open_ or (row.block, 0)
        rows.append((row.doc, row.block, row.n, cut, head, root[1] if root else "", *target))
        open_ = (row.block, row.n - 1) if row.n > 1 and cut else target
    return pd.DataFrame(rows, columns=["doc", "block", "n", "cut", "head", "root", "to_block", "to_ordinal"])


_PART = "doc string, block bigint, ordinal int, closed boolean, text string"


def segments(spark: SparkSession, path: str, size: int = SEGMENT) -> DataFrame:
    """(doc, scope, home, text): documents of whole nodes from the files of a path; `scope` is the path, `home` the file."""
    lines = _lines(spark, path)
    functions = checkpointed(lines.mapInArrow(_functions, "doc string, block bigint, ends array<int>, depths array<bigint>"), "states")
    starts = functions.groupBy("doc").applyInPandas(_starts, "doc string, block bigint, state int, depth bigint")
    begins = {(r["doc"], r["block"]): (r["state"], r["depth"]) for r in starts.where("state <> 0 or depth <> 1").collect()}  # others begin below the root

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of each block; an ordinal of -1 has the number of segments in front of the root's start."""
        key, rows = None, []
        schema = pa.schema([("doc", pa.string()), ("block", pa.int64()), ("ordinal", pa.int32()), ("closed", pa.bool_()), ("text", pa.string())])
        batch = lambda: pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

        def end() -> None:
            if key is not None:
                rows.append((*key, ordinal, closed, "\n".join(held)))
                rows.append((*key, -1, False, f"{ordinal + 1} {head}"))

        for doc, block, line in _by_block(batches):
            if (doc, block) != key:
                end()
                key, ordinal, closed, held, n, head, before = (doc, block), 0, False, [], 0, "", []
                state, depth = begins.get(key, (TEXT, 1))
            was = depth
            state, change, opened = after(line, state)
            depth += change
            if block == 0 and not head:
                before.append(line if opened < 0 else line[:opened])
                if opened < 0:
                    held.append(line)
                    continue
                head, line, held, was = "\n".join(before), line[opened:], [], 1
            held.append(line)
            n += len(line)
            closed |= depth == 0 and was > 0
            if state == TEXT and depth == 1 and (n >= size or not ordinal):
                rows.append((*key, ordinal, closed, "\n".join(held)))
                ordinal, closed, held, n = ordinal + 1, False, [], 0
                if len(rows) >= 64:
                    yield batch()
                    rows = []
        end()
        yield batch()

    parts = checkpointed(lines.mapInArrow(cut, _PART), "segments")
    sizes = parts.where("ordinal = -1").select("doc", "block", F.regexp_extract("text", r"^(\d+) ", 1).cast("int").alias("n"), F.regexp_extract("text", r"^\d+ ([\s\S]*)$", 1).alias("head"))
    chained = sizes.groupBy("doc").applyInPandas(_chained, "doc string, block bigint, n int, cut boolean, head string, root string, to_block bigint, to_ordinal int")
    placed = parts.where("ordinal >= 0").join(checkpointed(chained, "blocks"), ["doc", "block"])
    first, inner = (F.col("ordinal") == 0) | ~F.col("cut"), F.col("cut") & (F.col("ordinal") > 0) & (F.col("ordinal") < F.col("n") - 1)
    about = ["head", "root"]
    whole = placed.where(inner).select("doc", F.col("block").alias("to_block"), F.col("ordinal").alias("to_ordinal"), *about, "closed", "text")
    fragments = placed.where(~inner).select(
        "doc", F.when(first, F.col("to_block")).otherwise(F.col("block")).alias("to_block"), F.when(first, F.col("to_ordinal")).otherwise(F.col("ordinal")).alias("to_ordinal"), *about, "closed", "block", "ordinal", "text"
    )
    joined = fragments.groupBy("doc", "to_block", "to_ordinal").agg(*[F.first(c).alias(c) for c in about], F.max("closed").alias("closed"), F.sort_array(F.collect_list(F.struct("block", "ordinal", "text"))).alias("t"))
    every = whole.unionByName(joined.select("doc", "to_block", "to_ordinal", *about, "closed", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text")))
    end_tag = F.when(~F.col("closed") & (F.col("root") != ""), F.concat(F.lit("</"), "root", F.lit(">"))).otherwise("")
    return every.select(F.concat_ws("#", "doc", "to_block", "to_ordinal").alias("doc"), F.lit(path).alias("scope"), F.col("doc").alias("home"), F.concat("head", "text", end_tag).alias("text")).where(F.trim("text") != "")

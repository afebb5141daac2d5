"""Turtle, read and written with DataFrame operations.

Reading turns each document into rows of tokens and finds its structure with windows over the document: the depth of
brackets gives each token its enclosing bracket or statement, semicolons and commas its place there. The grammar's nested
forms (blank nodes in brackets, collections) thus need no recursion. A document is one unit of work; files are cut into many
documents first (segments). The windows' rows take some hundred times a text's room, so documents are dealt, as texts, to
as many tasks as their length asks for; all windows then run where the text is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions.terms import is_blank
from quadrille.operators.collections import cells
from quadrille.operators.quads import Graph
from quadrille.sources.segments import segments
from quadrille.storage import checkpointed, unsent
from quadrille.terms import ESCAPES, RDF, XSD

#: Characters of documents that a task parses, about.
TASK_TEXT = 1 << 20

_NAME = r"(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:[\w:%](?:[\w.:%-]*[\w:%-])?)?"
_IRI = r"<[^<>\"{}|^`\s]*>"
_STRING = r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""|\'\'\'(?:[^\'\\]++|\\[\s\S]|\'(?!\'\'))*+\'\'\'|"(?:[^"\\\n\r]++|\\.)*+"|\'(?:[^\'\\\n\r]++|\\.)*+\''
_TOKEN = (
    rf"#[^\n]*|{_IRI}|(?:{_STRING})(?:@(?!prefix|base)[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^(?:{_IRI}|{_NAME}))?"
    rf"|@prefix\b|@base\b|_:\w(?:[\w.-]*[\w-])?|{_NAME}|[+-]?(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+|[+-]?\d*\.\d+|[+-]?\d+"
    r"|[A-Za-z]+|[\[\]().;,]|\S"
)


def _unescaped(text: Column) -> Column:
    """Turns \\uXXXX and \\UXXXXXXXX into characters; the other escapes are those of term keys, but for \\' \\b \\f."""
    pieces = F.split(text, r"(?=\\u[0-9A-Fa-f]{4})|(?=\\U[0-9A-Fa-f]{8})")

    def decode(piece: Column) -> Column:
        short = piece.rlike(r"^\\u[0-9A-Fa-f]{4}")
        n = F.when(short, 4).otherwise(8)
        code = F.lpad(F.substr(piece, F.lit(3), n), 8, "0")
        character = F.decode(F.unhex(code), "UTF-32")
        return F.when(short | piece.rlike(r"^\\U[0-9A-Fa-f]{8}"), F.concat(character, F.substr(piece, n + 3))).otherwise(piece)

    return F.when(text.rlike(r"\\[uU]"), F.array_join(F.transform(pieces, decode), "")).otherwise(text)


def _literal(token: Column) -> Column:
    """The quoted part of a literal token as the quoted part of a term key."""
    long = r'^("""|\'\'\')'
    quoted = F.regexp_extract(token, rf"^({_STRING})", 1)
    inner = F.when(quoted.rlike(long), F.substr(quoted, F.lit(4), F.length(quoted) - 6)).otherwise(F.substr(quoted, F.lit(2), F.length(quoted) - 2))
    inner = F.regexp_replace(_unescaped(inner), r"\\'", "'")
    for plain, escaped in ESCAPES[1:]:  # raw line ends and quotes of long strings; escaped ones stay
        inner = F.regexp_replace(inner, rf'(?<!\\)((?:\\\\)*){plain}', "$1" + escaped.replace("\\", "\\\\")) if plain == '"' else F.replace(inner, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), inner, F.lit('"'))


def _resolved(text: Column, base: Column) -> Column:
    """An IRI reference against a base: absolute, network, path, query, fragment and relative forms (no dot segments)."""
    root = F.regexp_extract(base, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^?#]*/)", 1)
    return (
        F.when(base.isNull() | text.rlike(r"^[A-Za-z][\w+.-]*:"), text)
        .when(text == "", F.regexp_replace(base, r"#.*$", ""))
        .when(F.startswith(text, F.lit("//")), F.concat(F.regexp_extract(base, r"^([A-Za-z][\w+.-]*:)", 1), text))
        .when(F.startswith(text, F.lit("/")), F.concat(root, text))
        .when(F.startswith(text, F.lit("#")), F.concat(F.regexp_replace(base, r"#.*$", ""), text))
        .when(F.startswith(text, F.lit("?")), F.concat(F.regexp_replace(base, r"[?#].*$", ""), text))
        .otherwise(F.concat(folder, text))
    )


def _with_dots(text: Column, tokens: Column) -> Column:
    """PREFIX and BASE, which end without a dot, as @prefix and @base, which end with one."""
    said = lambda i: F.lower(F.coalesce(F.get(tokens, i), F.lit("")))

    def written(token: Column, i: Column) -> Column:
        word = F.lower(token)
        keyword = word.isin("prefix", "base")
        ends = token.startswith("<") & ((said(i - 1) == "base") | ((said(i - 2) == "prefix") & said(i - 1).endswith(":")))
        return F.when(keyword, F.array(F.concat(F.lit("@"), word))).when(ends, F.array(token, F.lit("."))).otherwise(F.array(token))

    return F.when(text.rlike(r"(?i)(?<![\w@])(?:prefix|base)\s"), F.flatten(F.transform(tokens, written))).otherwise(tokens)


def parse(documents: DataFrame, base: str | None = None) -> DataFrame:
    """(doc, s, p, o) of documents (doc, text). Blank nodes are labelled apart for each document; with a column `scope`, a
    label means one node in all documents of a scope."""
    documents = checkpointed(documents.select("doc", "text", *(["scope"] if "scope" in documents.columns else [F.col("doc").alias("scope")])), "documents")
    length = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    documents = documents.repartition(-(-length // TASK_TEXT) or 1, "doc")
    by_doc = Window.partitionBy("doc").orderBy("i")
    so_far = by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = F.col("tok")
    found = documents.select("doc", "scope", "text", F.filter(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)), lambda x: ~x.startswith("#")).alias("toks"))
    tokens = found.select("doc", "scope", F.posexplode(_with_dots(F.col("text"), F.col("toks"))).alias("i", "tok"))
    step = F.when(t.isin("[", "("), 1).when(t.isin("]", ")"), -1).otherwise(0)
    rows = tokens.select("*", F.lead("tok").over(by_doc).alias("next"), F.sum(step).over(so_far).alias("deep"))
    rows = rows.withColumn("level", F.when(step == 1, F.col("deep") - 1).otherwise(F.col("deep"))).where(step >= 0)
    # The innermost open bracket, or the end of the statement before: the last such mark at the token's own level.
    mark = F.struct((F.col("level") + 1).alias("lv"), F.lit(True).alias("mark"))
    own = F.struct(F.col("level").alias("lv"), (t == ".").alias("mark"))
    rows = rows.select("*", F.explode(F.when(step == 1, F.array(own, mark)).otherwise(F.array(own))).alias("at")).select("*", "at.lv", "at.mark")
    within = Window.partitionBy("doc", "lv").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("mark"), F.struct("i", "tok")), ignorenulls=True).over(within)
    rows = rows.withColumn("open", last).where(F.col("lv") == F.col("level"))
    ctx = F.coalesce(F.col("open.i"), F.lit(-1))
    rows = rows.withColumn("ctx", ctx).withColumn("kind", F.coalesce(F.when(F.col("open.tok") != ".", F.col("open.tok")), F.lit("."))).where(t != ".")
    by_ctx = Window.partitionBy("doc", "ctx", "lv").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.first("tok").over(by_ctx).alias("head"), F.sum((t == ";").cast("int")).over(by_ctx).alias("seg"))
    directive = (F.col("kind") == ".") & F.lower("head").isin("@prefix", "@base")
    # Prefixes and bases hold from where they stand.
    place = F.row_number().over(Window.partitionBy("doc", "ctx", "lv").orderBy("i"))
    rows = rows.withColumn("place", place)
    base_here = F.when(directive & (F.lower("head") == "@base") & (F.col("place") == 2), F.regexp_replace(t, "[<>]", ""))
    rows = rows.withColumn("base", F.coalesce(F.last(base_here, ignorenulls=True).over(so_far), F.lit(base).cast("string")))
    used = F.regexp_extract(t, rf"^(?:(?:{_STRING})\^\^)?({_NAME})$", 1)
    prefix = F.when(t.rlike(rf"^(?:(?:{_STRING})\^\^)?{_NAME}$") & ~t.startswith("_:"), F.regexp_extract(used, r"^([^:]*):", 1))
    named = directive & (F.lower("head") == "@prefix")
    defined = F.when(named & (F.col("place") == 2), _resolved(F.regexp_replace("next", "[<>]", ""), F.col("base")))
    rows = rows.select("*", used.alias("used"), prefix.alias("prefix")).withColumn("defined", defined)
    by_prefix = Window.partitionBy("doc", "prefix").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("space", F.last("defined", ignorenulls=True).over(by_prefix))
    rows = rows.where(~directive & ~t.isin(",", ";"))
    full = F.when(
        F.col("prefix").isNotNull(),
        F.concat(F.coalesce("space", F.raise_error(F.concat(F.lit("undeclared prefix: "), "prefix")).cast("string")), F.regexp_extract("used", r"^[^:]*:([\s\S]*)$", 1)),
    )
    label = lambda i: F.concat(F.lit("_:d"), F.md5(F.col("doc").cast("string")), F.lit("x"), i.cast("string"))
    number = lambda kind: F.concat(F.lit('"'), t, F.lit(f'"^^{XSD[kind]}'))
    tail = F.regexp_extract(t, rf"^(?:{_STRING})([\s\S]*)$", 1)
    typed = F.when(full.isNotNull(), F.concat(F.lit("<"), full, F.lit(">"))).otherwise(F.concat(F.lit("<"), _resolved(F.regexp_extract(tail, r"<(.*)>$", 1), F.col("base")), F.lit(">")))
    term = (
        F.when((t == "(") & (F.col("next") == ")"), F.lit(RDF.nil))
        .when(t.isin("[", "("), label(F.col("i")))
        .when(t.startswith("<"), F.concat(F.lit("<"), _resolved(_unescaped(F.substr(t, F.lit(2), F.length(t) - 2)), F.col("base")), F.lit(">")))
        .when(t.rlike("^[\"']"), F.concat(_literal(t), F.when(tail.startswith("^^"), F.when(typed == XSD.string, "").otherwise(F.concat(F.lit("^^"), typed))).otherwise(tail)))
        .when(t.startswith("_:"), F.concat(F.lit("_:d"), F.md5(F.col("scope").cast("string")), F.lit("n"), F.substr(t, F.lit(3))))
        .when(full.isNotNull(), F.concat(F.lit("<"), full, F.lit(">")))
        .when(t == "a", F.lit(RDF.type))
        .when(t.isin("true", "false"), number("boolean"))
        .when(t.rlike(r"[eE]") & t.rlike(r"^[+-]?[\d.]"), number("double"))
        .when(t.rlike(r"^[+-]?\d*\.\d+$"), number("decimal"))
        .when(t.rlike(r"^[+-]?\d+$"), number("integer"))
        .otherwise(F.raise_error(F.concat(F.lit("not Turtle: "), t)).cast("string"))
    )
    rows = rows.select("doc", "i", "ctx", "lv", "kind", "seg", term.alias("term"))
    n = lambda *keys: F.row_number().over(Window.partitionBy("doc", "ctx", "lv", *keys).orderBy("i"))
    subject = F.first("term").over(Window.partitionBy("doc", "ctx", "lv").orderBy("i"))
    rows = rows.select("*", n().alias("n"), subject.alias("subject"), F.count("*").over(Window.partitionBy("doc", "ctx", "lv")).alias("size")).withColumn("m", n("seg"))
    shift = F.when((F.col("kind") == ".") & (F.col("seg") == 0), 1).otherwise(0)
    predicate = F.max(F.when(F.col("m") == shift + 1, F.col("term"))).over(Window.partitionBy("doc", "ctx", "lv", "seg"))
    rows = rows.select("*", shift.alias("shift"), F.when(F.col("kind") == ".", F.col("subject")).otherwise(label(F.col("ctx"))).alias("s"), predicate.alias("p"))
    plain = F.array(F.struct("s", "p", F.col("term").alias("o")))
    cell = lambda k: F.when(k == 0, label(F.col("ctx"))).when(k == F.col("size"), F.lit(RDF.nil)).otherwise(F.concat(label(F.col("ctx")), F.lit("c"), k.cast("string")))
    chain = F.array(
        F.struct(cell(F.col("n") - 1).alias("s"), F.lit(RDF.first).alias("p"), F.col("term").alias("o")),
        F.struct(cell(F.col("n") - 1).alias("s"), F.lit(RDF.rest).alias("p"), cell(F.col("n")).alias("o")),
    )
    said = F.when(F.col("kind") == "(", chain).when(F.col("m") > F.col("shift") + 1, plain)
    return rows.select("doc", F.inline(said)).distinct()


def read(spark: SparkSession, *paths: str, base: str | None = None) -> Graph:
    """The triples of files of any size. The files of one path are one scope of blank node labels, so that what write()
    spreads over a folder's files stays one node."""
    documents = reduce(DataFrame.union, [segments(spark, path) for path in paths])
    return Graph.from_triples(parse(documents, base).select("s", "p", "o"))


def read_text(spark: SparkSession, text: str, base: str | None = None) -> Graph:
    return Graph.from_triples(parse(spark.createDataFrame([("0", text)], "doc string, text string"), base).select("s", "p", "o"))


def _shortened(key: Column, prefixes: dict[str, str] | None) -> Column:
    """A key as Turtle writes it: with a prefix where that is legal."""
    out = key
    for name, space in (prefixes or {}).items():
        local = F.substr(key, F.lit(len(space) + 2), F.length(key) - len(space) - 2)
        legal = F.startswith(key, F.lit("<" + space)) & local.rlike(r"^(?:[^\W\d]\w*)?$")
        out = F.when(legal, F.concat(F.lit(f"{name}:"), local)).otherwise(out)
    return out


def _bodies(rows: DataFrame, between: str) -> DataFrame:
    """(s, body): the predicates and objects of rows (s, p, pos, t), in order; those of a list (p is null) one after another."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"])
    by_pair = rows.groupBy("s", "p").agg(texts.alias("ts"))
    listed = F.when(F.col("p").isNull(), F.array_join("ts", " ")).otherwise(F.concat("p", F.lit(" "), F.array_join("ts", ", ")))
    by_subject = by_pair.groupBy("s").agg(F.sort_array(F.collect_list(listed)).alias("ps"))
    return by_subject.select("s", F.array_join("ps", between).alias("body"))


def _nested(rows: DataFrame, triples: DataFrame, first: Column) -> DataFrame:
    """rows (s, p, pos, o, t) in which blank nodes that are the object of one triple, and the lists of such nodes, are
    written in place: round by round, innermost first, so that a graph nested d deep takes d rounds. What is part of a
    cycle keeps its label. `first` is how rows write rdf:first."""
    uses = triples.where(is_blank(F.col("o"))).groupBy("o").agg(F.count("*").alias("n"), F.min("p").alias("by"))
    single = checkpointed(uses.where("n = 1").select(F.col("o").alias("s"), "by"))
    count = lambda p: F.sum((F.col("p") == p).cast("int"))
    shape = triples.groupBy("s").agg(F.count("*").alias("n"), count(RDF.first).alias("f"), count(RDF.rest).alias("r"))
    cell = checkpointed(shape.where("n = 2 and f = 1 and r = 1").select("s").join(unsent(single), "s"))
    parts = triples.join(unsent(cell.select("s")), "s", "left_semi")
    reached = cells(Graph.from_triples(parts), cell.where(F.col("by") != RDF.rest).select("s"), check=False)
    ends = parts.where((F.col("p") == RDF.rest) & (F.col("o") == RDF.nil)).select(F.col("s").alias("cell"))
    lists = checkpointed(reached.join(unsent(reached).join(ends, "cell").select("node").distinct(), "node", "left_semi"))
    members = unsent(lists).join(rows.where(F.col("p") == first).select(F.col("s").alias("cell"), "o", "t"), "cell")
    members = members.select(F.col("node").alias("s"), F.lit(None).cast("string").alias("p"), "pos", "o", "t")
    rows = checkpointed(rows.join(unsent(lists.select(F.col("cell").alias("s"))), "s", "left_anti").unionByName(members))
    inner = single.where(F.col("by") != RDF.rest).select("s")
    while True:
        waits = rows.join(unsent(inner.select(F.col("s").alias("o"))), "o", "left_semi").select("s")  # an object of theirs is not written yet
        ready = unsent(inner.join(unsent(waits), "s", "left_anti"))
        bodies = _bodies(rows.join(ready, "s", "left_semi"), " ; ")
        is_list = rows.where("p is null").select("s", F.lit(True).alias("list")).distinct()
        written = unsent(ready.join(bodies, "s", "left")).join(is_list, "s", "left")
        text = F.when(F.col("list"), F.concat(F.lit("( "), "body", F.lit(" )"))).otherwise(F.coalesce(F.concat(F.lit("[ "), "body", F.lit(" ]")), F.lit("[]")))
        written = checkpointed(written.select(F.col("s").alias("w"), text.alias("text")))
        if written.isEmpty():
            return rows
        rows = rows.join(unsent(written.select(F.col("w").alias("s"))), "s", "left_anti").join(unsent(written), rows["o"] == written["w"], "left")
        rows = checkpointed(rows.select("s", "p", "pos", F.when(F.col("w").isNull(), F.col("o")).alias("o"), F.coalesce("text", "t").alias("t")))
        inner = checkpointed(inner.join(unsent(written.select(F.col("w").alias("s"))), "s", "left_anti"))


def _predicate(key: Column, prefixes: dict[str, str] | None) -> Column:
    return F.when(key == RDF.type, F.lit("a")).otherwise(_shortened(key, prefixes))


def blocks(graph: Graph, prefixes: dict[str, str] | None = None, nested: bool = False, indent: int = 4) -> DataFrame:
    """(s, value): one Turtle statement for each subject, predicates and objects in order of their keys, continued lines
    `indent` wide. `prefixes` maps prefixes to IRIs (none: full IRIs); write() puts their header in front. Blank nodes keep
    their labels, or with `nested` are written in brackets, and lists in parentheses, where they are used once."""
    triples = graph.df.select("s", "p", "o").distinct()
    rows = triples.select("s", _predicate(F.col("p"), prefixes).alias("p"), F.lit(0).cast("long").alias("pos"), "o", _shortened(F.col("o"), prefixes).alias("t"))
    if nested:
        rows = _nested(rows, checkpointed(triples), _predicate(F.lit(RDF.first), prefixes))
    whole = _bodies(rows, " ;\n" + " " * indent)
    return whole.select("s", F.concat(_shortened(F.col("s"), prefixes), F.lit(" "), "body", F.lit(" .")).alias("value"))


def header(prefixes: dict[str, str] | None) -> str:
    return "".join(f"@prefix {name}: <{space}> .\n" for name, space in (prefixes or {}).items())


def _lines(head: str, indent: int, objects_a_line: int, spacing: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turtle lines of rows (s, p, o) in order, as they come: only one line is held, whatever the size of a statement. What
    a partition begins is a statement of its own, and its end ends one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, n, before, margin = None, 0, (None, None), " " * indent
        for batch in batches:
            out = [] if line is not None or not batch.num_rows else head.splitlines()
            for s, p, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = (s == before[0]) + ((s, p) == before)
                if same == 2 and n < objects_a_line:
                    line, n = f"{line}, {o}", n + 1
                    continue
                if line is not None:
                    out.append(f"{line} {'.;,'[same]}")
                    out += [""] * (spacing if not same else 0)
                line, n, before = (f"{s} {p} {o}", f"{margin}{p} {o}", f"{margin * 2}{o}")[same], 1, (s, p)
            yield pa.record_batch([pa.array(out, pa.string())], ["value"])
        if line is not None:
            yield pa.record_batch([pa.array([f"{line} ."])], ["value"])

    return run


def write(
    graph: Graph, path: str, prefixes: dict[str, str] | None = None, mode: str = "error", nested: bool = False, indent: int = 4, objects_a_line: int = 8, spacing: int = 0
) -> None:
    """Text files of whole statements, each file a document of its own with the prefixes in front.

    The triples are dealt to files by ranges of subject, predicate and object and sorted there, and a statement is written
    line by line, so a subject may have any number of objects; one that reaches over files has a statement in each.
    `objects_a_line` objects stand on a line, and `spacing` empty lines behind a statement. With `nested`, blank nodes that
    are used once are written in place, and each statement is one row with a header of its own (see blocks)."""
    if nested:
        statements = blocks(graph, prefixes, nested, indent)
        value = F.concat(F.lit(header(prefixes)), F.col("value"), F.lit("\n" * spacing))
        statements.select(value.alias("value")).write.mode(mode).text(path)
        return
    triples = graph.df.select("s", "p", "o").distinct().repartitionByRange("s", "p", "o").sortWithinPartitions("s", "p", "o")
    rows = triples.select(_shortened(F.col("s"), prefixes).alias("s"), _predicate(F.col("p"), prefixes).alias("p"), _shortened(F.col("o"), prefixes).alias("o"))
    rows.mapInArrow(_lines(header(prefixes), indent, objects_a_line, spacing), "value string").write.mode(mode).text(path)

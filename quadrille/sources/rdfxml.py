"""RDF/XML: documents parsed by a small helper on the XML tree, one document a row; files are cut into many documents first
(xml_segments). Written with Spark's functions."""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.terms import is_blank, is_iri, lang, lexical
from quadrille.operators.quads import Graph
from quadrille.sources.ntriples import ParseError
from quadrille.sources.xml_segments import segments
from quadrille.terms import RDF, blank, iri, literal

#: Triples that a task hands on at a time, at least: one document has few.
BATCH = 8192

_R = f"{{{RDF.base}}}"
_XML = "{http://www.w3.org/XML/1998/namespace}"
_ATTRIBUTES = {f"{_R}{n}" for n in ("about", "ID", "nodeID", "resource", "datatype", "parseType")} | {f"{_XML}lang", f"{_XML}base"}


class _Document:
    """The triples of one document, gathered by a walk over its nodes and properties."""

    def __init__(self, name: str, scope: str, base: str):
        self.mark, self.scope = (hashlib.md5(x.encode()).hexdigest() for x in (name, scope))
        self.base, self.count = base, 0
        self.found: list[tuple[str, str, str]] = []

    def fresh(self) -> str:
        self.count += 1
        return blank(f"d{self.mark}x{self.count}")

    def subject(self, x: ET.Element, base: str) -> str:
        if (about := x.get(f"{_R}about")) is not None:
            return iri(urljoin(base, about))
        if (name := x.get(f"{_R}ID")) is not None:
            return iri(urljoin(base, f"#{name}"))
        return blank(f"d{self.scope}n{x.get(f'{_R}nodeID')}") if x.get(f"{_R}nodeID") else self.fresh()

    def node(self, x: ET.Element, base: str, language: str | None) -> str:
        base, language = x.get(f"{_XML}base", base), x.get(f"{_XML}lang", language)
        s = self.subject(x, base)
        if x.tag != f"{_R}Description":
            self.found.append((s, RDF.type, self.name(x.tag)))
        self.attributes(s, x, base, language)
        self.properties(s, x, base, language)
        return s

    def name(self, tag: str) -> str:
        if not tag.startswith("{"):
            raise ParseError(f"a name without a namespace: {tag}")
        return iri(tag[1:].replace("}", "", 1))

    def attributes(self, s: str, x: ET.Element, base: str, language: str | None) -> None:
        for key, value in x.attrib.items():
            if key not in _ATTRIBUTES:
                self.found.append((s, self.name(key), iri(urljoin(base, value)) if key == f"{_R}type" else literal(value, language or None)))

    def properties(self, s: str, x: ET.Element, base: str, language: str | None) -> None:
        member = 0
        for y in x:
            member += y.tag == f"{_R}li"
            p = RDF[f"_{member}"] if y.tag == f"{_R}li" else self.name(y.tag)
            self.found.append((s, p, self.value(y, y.get(f"{_XML}base", base), y.get(f"{_XML}lang", language))))

    def value(self, y: ET.Element, base: str, language: str | None) -> str:
        kind, children = y.get(f"{_R}parseType"), list(y)
        if kind == "Resource":
            o = self.fresh()
            self.properties(o, y, base, language)
        elif kind == "Collection":
            nodes = [self.node(z, base, language) for z in children]
            cells = [*[self.fresh() for _ in nodes], RDF.nil]
            for i, node in enumerate(nodes):
                self.found += [(cells[i], RDF.first, node), (cells[i], RDF.rest, cells[i + 1])]
            o = cells[0]
        elif kind is not None:
            o = literal((y.text or "") + "".join(ET.tostring(z, encoding="unicode") for z in children), datatype=RDF.XMLLiteral)
        elif children:
            if len(children) > 1:
                raise ParseError(f"{y.tag} holds more than one node")
            o = self.node(children[0], base, language)
        elif (resource := y.get(f"{_R}resource")) is not None or y.get(f"{_R}nodeID") or set(y.attrib) - _ATTRIBUTES:
            o = iri(urljoin(base, resource)) if resource is not None else blank(f"d{self.scope}n{y.get(f'{_R}nodeID')}") if y.get(f"{_R}nodeID") else self.fresh()
            self.attributes(o, y, base, language)
        else:
            datatype = y.get(f"{_R}datatype")
            o = literal(y.text or "", None if datatype else language or None, iri(urljoin(base, datatype)) if datatype else None)
        return o


def _triples(name: str, scope: str, home: str, text: str, base: str | None) -> list[tuple[str, str, str]]:
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ParseError(f"{name}: {e}") from e
    document = _Document(name, scope, root.get(f"{_XML}base", base or home))
    for x in root if root.tag == f"{_R}RDF" else [root]:
        document.node(x, document.base, root.get(f"{_XML}lang"))
    return document.found


def parse(documents: DataFrame, base: str | None = None) -> DataFrame:
    """(doc, s, p, o) of documents (doc, text); with a column `scope`, a node id means one node in all documents of a scope;
    with a column `home`, that is the base of documents that name none, instead of `doc`."""
    scope, home = ("scope" if "scope" in documents.columns else "doc"), ("home" if "home" in documents.columns else "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        written = lambda: pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["doc", "s", "p", "o"])
        for batch in batches:
            for doc, own, place, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(doc, *t) for t in _triples(doc, own, place, text, base)]
                if len(rows) >= BATCH:
                    yield written()
                    rows = []
        yield written()

    return documents.select(F.col("doc").cast("string").alias("doc"), F.col(scope).cast("string").alias("scope"), F.col(home).cast("string").alias("home"), "text").mapInArrow(run, "doc string, s string, p string, o string").distinct()


def read(spark: SparkSession, *paths: str, base: str | None = None) -> Graph:
    """The triples of files of any size; the files of one path are one scope of node ids."""
    documents = reduce(DataFrame.union, [segments(spark, path) for path in paths])
    return Graph.from_triples(parse(documents, base).select("s", "p", "o"))


def read_text(spark: SparkSession, text: str, base: str = "http://example.org/") -> Graph:
    return Graph.from_triples(parse(spark.createDataFrame([("0", text)], "doc string, text string"), base).select("s", "p", "o"))


HEADER, FOOTER = f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{RDF.base}">', "</rdf:RDF>"


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _properties(graph: Graph) -> DataFrame:
    """(s, about, line): the property element of each triple, and how its subject is named."""
    space, name = (F.regexp_extract("p", r"^<(.*[^\w.-]|)([^\W\d][\w.-]*)>$", i) for i in (1, 2))
    checked = F.when(name == "", F.raise_error(F.concat(F.lit("no XML name: "), "p"))).otherwise(name)
    o = F.col("o")
    label = lambda key: _escaped(F.regexp_replace(F.substr(key, F.lit(3)), r"[^\w.-]", "_"))
    datatype = F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1)
    value = (
        F.when(is_iri(o), F.concat(F.lit(' rdf:resource="'), _escaped(lexical(o)), F.lit('"/>')))
        .when(is_blank(o), F.concat(F.lit(' rdf:nodeID="'), label(o), F.lit('"/>')))
        .otherwise(
            F.concat(
                F.when(datatype != "", F.concat(F.lit(' rdf:datatype="'), _escaped(datatype), F.lit('"'))).when(lang(o) != "", F.concat(F.lit(' xml:lang="'), lang(o), F.lit('"'))).otherwise(""),
                F.lit(">"),
                _escaped(lexical(o)),
                F.lit("</p:"),
                name,
                F.lit(">"),
            )
        )
    )
    line = F.concat(F.lit("    <p:"), checked, F.lit(' xmlns:p="'), _escaped(space), F.lit('"'), value)
    about = F.when(is_blank(F.col("s")), F.concat(F.lit('rdf:nodeID="'), label(F.col("s")))).otherwise(F.concat(F.lit('rdf:about="'), _escaped(lexical(F.col("s")))))
    return graph.df.select("s", "p", "o").distinct().select("s", F.concat(about, F.lit('"')).alias("about"), line.alias("line"))


def blocks(graph: Graph) -> DataFrame:
    """(s, value): an rdf:Description for each subject. A predicate must end in an XML name, or the row is an error."""
    listed = _properties(graph).groupBy("s", "about").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))
    return listed.select("s", F.concat(F.lit("  <rdf:Description "), "about", F.lit(">\n"), "lines", F.lit("\n  </rdf:Description>")).alias("value"))


def write(graph: Graph, path: str, mode: str = "error") -> None:
    """One document for each partition of the graph: an rdf:Description a triple between header and footer, line by line, so
    that neither a subject nor a file is ever one string and nothing is shuffled for it. read() of the folder gives the
    nodes that its files share."""
    rows = _properties(graph).select(F.concat(F.lit("  <rdf:Description "), "about", F.lit(">"), F.trim("line"), F.lit("</rdf:Description>")).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([HEADER])], ["value"])
        yield from batches
        yield pa.record_batch([pa.array([FOOTER])], ["value"])

    rows.mapInArrow(run, "value string").write.mode(mode).text(path)

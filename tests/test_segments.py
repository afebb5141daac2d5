"""Turtle files read in blocks and segments give what the reader of whole documents gives."""

import random

import pytest

from quadrille.operators.quads import Graph
from quadrille.sources import rdfxml
from quadrille.sources import segments as seg
from quadrille.sources import turtle
from quadrille.sources import xml_segments as xml
from quadrille.storage import whole_files

HEAD = "@prefix ex: <http://e/> .\n@prefix : <http://d/> .\n@base <http://b/c/> .\n"


def some_turtle(n, seed=1):
    """Statements with everything that a cut could get wrong: dots, quotes and keywords in strings, comments and names, strings
    over lines, brackets, prefixes that change, directives over lines."""
    rng, parts = random.Random(seed), [HEAD]
    kinds = [
        lambda i: f"ex:s{i} ex:p ex:o.{i} ; ex:q 1.5, {i}. # ends. here .",
        lambda i: f'ex:s{i} ex:p "a . b # c", """long . \n"x" @prefix ex: <http://no/> .\n still \\""" . {i}\n.\n""" .',
        lambda i: f"ex:s{i} ex:p '''it's\n{i} .\n\"\"\" not the end ''' , 'y\\'s .' ; a :T .",
        lambda i: f"# a comment with \"\"\" and ''' .\n<rel{i}> ex:p <#f{i}> .",
        lambda i: f"ex:s{i}\n  ex:p ( 1 2.0 ex:m{i} ) ;\n  ex:q [ ex:r {i} ; ex:t [ ] ]\n  .",
        lambda i: f"_:n{i % 5} ex:p _:n{(i + 1) % 5} . ex:two ex:in ex:line{i} .",
        lambda i: f"@prefix p{i % 3}: <http://p/{i}/> .\np{i % 3}:x ex:p p{i % 3}:y .",
        lambda i: f"PREFIX ex2: <http://two/{i}/>\nBASE <http://b/{i}/>\nex2:a ex2:b <x{i}> .",
        lambda i: f"@prefix\n  late:\n  <http://late/{i}/>\n.\nlate:a late:b late:c{i} .\nex:prefix ex:base \"prefix x: <y>\" .",
        lambda i: f"ex:s{i} ex:p \"\"\"\"quoted\"\"\" , '' , \"\" , \"\"\"\"\"\" , \"z\"@en , 3 .",
    ]
    return "\n".join([*parts, *[rng.choice(kinds)(i) for i in range(n)], ""])


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "12"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def triples(df):
    return Graph.from_triples(df.select("s", "p", "o"))


@pytest.mark.parametrize("size", [1, 400])
def test_equal_to_the_reader_of_whole_documents(spark, tmp_path, small_blocks, size):
    (tmp_path / "a.ttl").write_text(some_turtle(60, 1))
    (tmp_path / "b.ttl").write_text(some_turtle(5, 2))
    found = seg.segments(spark, str(tmp_path), size)
    cut = found.collect()
    assert len(cut) > 10 and seg._lines(spark, str(tmp_path)).select("doc", "block").distinct().count() > 8
    whole = turtle.parse(whole_files(spark, str(tmp_path)))
    split = turtle.parse(found)
    ground = lambda df: sorted(r[:] for r in (tuple(x) for x in df.select("s", "p", "o").distinct().collect()) if not any(t.startswith("_:") for t in r))
    assert ground(split) == ground(whole)
    named = lambda df: sorted(tuple(t[-2:] if t.startswith("_:") else t for t in x) for x in df.select("s", "p", "o").distinct().collect() if "n" in x[0][-3:] and x[0].startswith("_:"))
    assert split.select("s", "p", "o").distinct().count() == whole.select("s", "p", "o").distinct().count() and named(split) == named(whole)


def test_one_file_of_many_tasks(spark, tmp_path):
    """A file of 60,000 subjects in many blocks."""
    lines = "".join(f'ex:s{i} ex:p ex:o{i % 7} ;\n  ex:q "text . {i}" .\n' for i in range(60_000))
    (tmp_path / "big.ttl").write_text(f"@prefix ex: <http://e/> .\n{lines}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 18))
    try:
        found = seg.segments(spark, f"{tmp_path}/big.ttl")
        assert found.count() > 20 and seg._lines(spark, f"{tmp_path}/big.ttl").rdd.getNumPartitions() > 8
        g = turtle.read(spark, f"{tmp_path}/big.ttl")
        assert g.size() == 120_000 and g.get("<http://e/s59999>").size() == 2 and g.has("<http://e/s31234>", "<http://e/q>", '"text . 31234"')
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(
    ("line", "state", "end"),
    [
        ("a b c .", 0, 0), ('x """open', 0, 1), ("x '''open", 0, 2), ('x """shut""" y', 0, 0), ("no quotes", 1, 1), ('end""" .', 1, 0), ('end\\""" more', 1, 1), ('end""" and """again', 1, 1),
        ("''' inside double", 1, 1), ("it''' .", 2, 0), ('# comment """', 0, 0), ('"str \\""""', 0, 0), ('""""four""" .', 0, 0), ("ends with \\", 1, 1), ('<http://e/"""> .', 0, 1), ("\"''' in short\" .", 0, 0),
    ],
)
def test_states(line, state, end):
    assert seg.after(line, state) == end


def test_environment():
    e = seg.Environment()
    for line in ("@prefix a: <http://a/> .", "PREFIX b: <http://b/>", "@base <http://x/> . @prefix a:", "<rel> .", 'ex:x "@prefix c: <http://c/> ."', "@prefix a: <http://a2/> .", "# @prefix d: <http://d/> ."):
        e.read(line, 0)
    assert e.text() == "b: <http://b/>\n@base <http://x/>\na: <http://a2/>"


def test_empty_and_missing_ends(spark, tmp_path):
    (tmp_path / "empty.ttl").write_text("")
    (tmp_path / "one.ttl").write_text("<http://a/s> <http://a/p> 1 .")
    assert turtle.read(spark, str(tmp_path)).size() == 1
    assert turtle.read(spark, f"{tmp_path}/empty.ttl").size() == 0


def test_a_subject_of_many_objects_is_written_line_by_line(spark, tmp_path):
    """One subject with most triples reaches over files, each a document of its own; lines stay short."""
    hot = spark.range(40_000).selectExpr("'<http://e/hot>' as s", "'<http://e/p>' as p", "concat('\"text ', id, '\"') as o")
    rest = spark.range(300).selectExpr("concat('<http://e/s', id % 50, '>') as s", "concat('<http://e/p', id % 3, '>') as p", "concat('<http://e/o', id, '>') as o")
    g = Graph.from_triples(hot.union(rest))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turtle.write(g, f"{tmp_path}/out", {"": "http://e/"}, objects_a_line=3, spacing=1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = [f.read_text() for f in (tmp_path / "out").glob("part*") if f.stat().st_size]
    assert len(files) > 1 and sum(":hot" in f for f in files) > 1 and all(f.startswith("@prefix : <http://e/> .") for f in files)
    assert max(len(line) for f in files for line in f.splitlines()) < 80 and all(line.count(",") <= 3 for f in files for line in f.splitlines())
    again = turtle.read(spark, f"{tmp_path}/out")
    assert again.size() == g.size() and (again - g).df.isEmpty()


# RDF/XML

XML_HEAD = """<?xml version="1.0"?>
<!-- <rdf:RDF> in a comment -->
<!DOCTYPE rdf:RDF [
  <!ENTITY ex "http://e/">
  <!-- ]> -->
]>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"
  xmlns:ex="http://e/" xml:lang="en"
  xmlns:more="http://m/>">"""


def some_xml(n, seed=1):
    rng = random.Random(seed)
    kinds = [
        lambda i: f'<rdf:Description rdf:about="&ex;s{i}"><ex:p>text &lt;{i}&gt;</ex:p></rdf:Description>',
        lambda i: f'<ex:T\n  rdf:about="s{i}"\n  ex:q="a > b &lt;/ex:T> {i}"\n/>',
        lambda i: f'<!-- comment {i}\n </rdf:RDF>\n "quote -->\n<ex:T rdf:nodeID="n{i % 4}"><ex:p rdf:nodeID="n{(i + 1) % 4}"/></ex:T>',
        lambda i: f'<rdf:Description rdf:about="#s{i}"><ex:p><![CDATA[<not> a\n tag {i} \']]></ex:p><more:p>second\nline</more:p></rdf:Description>',
        lambda i: f'<rdf:Description rdf:about="http://e/d{i}"><ex:p rdf:parseType="Resource"><ex:q>{i}</ex:q></ex:p>\n<ex:list rdf:parseType="Collection"><ex:T rdf:about="x"/>\n<ex:T/></ex:list></rdf:Description>',
        lambda i: f'<?note > < {i}\n?><rdf:Seq rdf:about="&ex;q{i}"><rdf:li>1</rdf:li>\n<rdf:li>2</rdf:li></rdf:Seq>',
    ]
    return "\n".join([XML_HEAD, *[rng.choice(kinds)(i) for i in range(n)], "</rdf:RDF>"])


@pytest.mark.parametrize("size", [1, 500])
def test_xml_equal_to_the_reader_of_whole_documents(spark, tmp_path, small_blocks, size):
    (tmp_path / "a.xml").write_text(some_xml(60, 1))
    (tmp_path / "one.xml").write_text('<ex:T xmlns:ex="http://e/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" rdf:about="http://e/one">\n<ex:p>1</ex:p>\n<ex:p>2</ex:p>\n</ex:T>\n')
    cut = xml.segments(spark, str(tmp_path), size)
    assert cut.count() > 10
    whole, split = rdfxml.parse(whole_files(spark, str(tmp_path))), rdfxml.parse(cut)
    both = [sorted(tuple(x) for x in df.select("s", "p", "o").distinct().collect()) for df in (whole, split)]
    plain = [[t for t in rows if not any(x.startswith("_:") for x in t)] for rows in both]
    assert plain[0] == plain[1] and len(plain[0]) > 60 and len(both[0]) == len(both[1])
    named = [sorted(tuple(x[-2:] if x.startswith("_:") else x for x in t) for t in rows if t[0].startswith("_:") and t[0][-2] == "n") for rows in both]
    assert named[0] == named[1] and named[0]


@pytest.mark.parametrize(
    ("line", "state", "end"),
    [
        ("<a><b/>x</a>", xml.TEXT, (xml.TEXT, 0, 3)), ("<a x='>'", xml.TEXT, (xml.OPEN, 0, -1)), ("/>", xml.OPEN, (xml.TEXT, 0, -1)), (">", xml.OPEN, (xml.TEXT, 1, 1)), ("it's > \" >", xml.DOUBLE, (xml.TEXT, 1, 10)),
        ("--> </a", xml.COMMENT, (xml.CLOSE, 0, -1)), ("> <b>", xml.CLOSE, (xml.TEXT, 0, 5)), ("no end", xml.CDATA, (xml.CDATA, 0, -1)), ("]]><a>", xml.CDATA, (xml.TEXT, 1, 6)), ("<!DOCTYPE a [ <!ENTITY x '>'>", xml.TEXT, (xml.SUBSET, 0, -1)),
    ],
)
def test_xml_states(line, state, end):
    assert xml.after(line, state) == end

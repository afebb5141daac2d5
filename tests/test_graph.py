"""Operators of the graph side on a small golden graph."""

import pytest
from pyspark.sql import functions as F

from quadrille.functions import terms as fn
from quadrille.operators import collections, owl
from quadrille.operators.quads import Graph, View
from quadrille.plans.solutions import Solutions
from quadrille.sources import ntriples, rdfxml, turtle
from quadrille.sources.store import QuadStore
from quadrille.streaming import ingest
from quadrille.terms import OWL, RDF, XSD, Namespace, literal

EX = Namespace("http://example.org/")
TEXT = """
@prefix : <http://example.org/> .
:alice a :Person ; :name "Alice"@en ; :age 42 ; :knows :bob .
:bob   a :Person ; :name "Bob"@de   ; :age 17 .
:carol a :Robot  ; :name "Carol"    ; :knows [ :name "Anon" ] .
:list1 :items ( "x" "y" ) .
"""


@pytest.fixture(scope="module")
def golden(spark):
    return Graph(turtle.read_text(spark, TEXT).df.cache())


def rows(found, *columns):
    df = found.df if isinstance(found, (Solutions, Graph)) else found
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_turtle_reads_the_golden_graph(golden):
    assert golden.pattern("?s", "?p", "?o").df.count() == 16
    assert rows(golden.pattern("?s", RDF.type, EX.Person), "s") == [(EX.alice,), (EX.bob,)]


def test_turtle_forms(spark):
    g = turtle.read_text(
        spark,
        r'''PREFIX p: <http://a/> @base <http://b/c/d> .
        <e> p:x 1.5 , -2e3, 7, true, false, "tab\t\"q\"\u00e9", 'single', """two
lines "quoted" here""", "7"^^<http://www.w3.org/2001/XMLSchema#int>, () ; # a comment
          p:nest [ p:a ( 1 [ p:b "deep" ] ) ; p:c <#f> ] .
        [ p:q _:z ] p:r _:z . @prefix p: <http://later/> . p:s p:t p:u .''',
    )
    values = {o for (o,) in rows(g.get("<http://b/c/e>", "<http://a/x>"), "o")}
    assert values == {
        literal("1.5", datatype=XSD.decimal), literal("-2e3", datatype=XSD.double), literal("7", datatype=XSD.integer), literal("true", datatype=XSD.boolean),
        literal("false", datatype=XSD.boolean), literal('tab\t"q"é'), literal("single"), literal('two\nlines "quoted" here'), literal("7", datatype=XSD.int), RDF.nil,
    }
    assert g.has(None, "<http://a/c>", "<http://b/c/d#f>") and g.has(None, "<http://a/b>", literal("deep"))
    assert g.has("<http://later/s>", "<http://later/t>", "<http://later/u>")
    (q,), (r,) = rows(g.get(None, "<http://a/q>"), "o"), rows(g.get(None, "<http://a/r>"), "o")
    assert q == r


def test_turtle_rejects_an_undeclared_prefix(spark):
    with pytest.raises(Exception, match="undeclared prefix"):
        turtle.read_text(spark, "x:a x:b x:c .").df.collect()


def test_round_trips(spark, golden, tmp_path):
    prefixes = {"": EX.base}
    ntriples.write(golden, f"{tmp_path}/nt")
    assert ntriples.read(spark, f"{tmp_path}/nt").same(golden)
    named = golden.where(~F.startswith("s", F.lit("_:")) & ~F.startswith("o", F.lit("_:")))
    turtle.write(golden, f"{tmp_path}/ttl", prefixes)
    assert (turtle.read(spark, f"{tmp_path}/ttl") & named).same(named)
    rdfxml.write(golden, f"{tmp_path}/xml")
    again = rdfxml.read(spark, f"{tmp_path}/xml")
    assert again.size() == golden.size() and (again & named).same(named)
    many = Graph(golden.df.repartition(8, "s"))
    turtle.write(many, f"{tmp_path}/ttl8", prefixes)
    rdfxml.write(many, f"{tmp_path}/xml8")
    assert len(list((tmp_path / "xml8").glob("*.txt"))) > 2
    for found in (turtle.read(spark, f"{tmp_path}/ttl8"), rdfxml.read(spark, f"{tmp_path}/xml8")):  # nodes that files share
        assert found.size() == golden.size()
        assert found.bgp((EX.carol, EX.knows, "?x"), ("?x", EX.name, "?n")).df.count() == 1
        assert collections.read_lists(found, found.get(EX.list1, EX["items"]).df.select("o")).first()["items"] == [literal("x"), literal("y")]


def test_turtle_nests_what_is_used_once(spark, golden):
    prefixes = {"": EX.base}
    values = {r.s: r.value for r in turtle.blocks(golden, prefixes, nested=True).collect()}
    assert set(values) == {EX.alice, EX.bob, EX.carol, EX.list1}
    assert '[ :name "Anon" ]' in values[EX.carol] and values[EX.list1] == ':list1 :items ( "x" "y" ) .'
    deep = turtle.read_text(
        spark,
        """@prefix : <http://example.org/> . :a :p [ :q ( 1 [ :r "deep" ; :s ( ) ] [ ] ) ] , _:twice . :b :p _:twice . _:twice :v 1 .
        _:x :to _:y . _:y :to _:x . :c :p ( ( 2 ) ) . _:top :p :a . :d :p _:l . _:l <http://www.w3.org/1999/02/22-rdf-syntax-ns#first> 3 .""",
    )
    text = turtle.blocks(deep, prefixes, nested=True, indent=2).collect()
    again = turtle.read_text(spark, turtle.header(prefixes) + "\n".join(r.value for r in text))
    named = lambda g: g.df.where(~F.startswith("s", F.lit("_:")) & ~F.startswith("o", F.lit("_:"))).select("s", "p", "o")
    shape = lambda g: sorted(map(tuple, g.df.groupBy("p", F.when(~F.startswith("o", F.lit("_:")), F.col("o")).alias("o")).count().collect()), key=str)
    assert again.size() == deep.size() and shape(again) == shape(deep) and rows(named(again), "s", "p", "o") == rows(named(deep), "s", "p", "o")
    assert len(text) == 8  # a, b, c, d; the node used twice, one of nobody, and the two of the cycle


def test_bad_text_is_one_error(spark, tmp_path):
    (tmp_path / "a.nt").write_text("nonsense\n")
    for graph in (lambda: turtle.read_text(spark, "x:a x:b x:c ."), lambda: turtle.read_text(spark, "<a> <b> nonsense ."), lambda: rdfxml.read_text(spark, "<a"), lambda: ntriples.read(spark, f"{tmp_path}/a.nt")):
        with pytest.raises(ntriples.ParseError), ntriples.parsing():
            graph().df.collect()
    with pytest.raises(ZeroDivisionError), ntriples.parsing():
        1 / 0


def test_ntriples_rejects_bad_lines(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<http://a> <http://b> "c"^^<http://www.w3.org/2001/XMLSchema#string> <http://g> . # quad\n\n# comment\nnonsense\n')
    assert rows(ntriples.read(spark, f"{tmp_path}/a.nt", strict=False), "g", "o") == [("<http://g>", '"c"')]
    with pytest.raises(Exception, match="not a statement"):
        ntriples.read(spark, f"{tmp_path}/a.nt").df.collect()


def test_rdfxml_forms(spark):
    g = rdfxml.read_text(
        spark,
        """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://example.org/" xmlns:e="http://example.org/" xml:base="http://b/d">
        <City rdf:about="#x" e:name="N"><near rdf:resource="y"/><size rdf:datatype="http://www.w3.org/2001/XMLSchema#int">5</size><label xml:lang="de">L</label>
        <part rdf:parseType="Resource"><name>inner</name></part><all rdf:parseType="Collection"><City rdf:ID="a"/><City rdf:nodeID="b"/></all><x rdf:parseType="Literal">a<b/></x></City></rdf:RDF>""",
    )
    s = "<http://b/d#x>"
    assert g.has(s, RDF.type, EX.City) and g.has(s, EX.name, literal("N")) and g.has(s, EX.near, "<http://b/y>") and g.has(s, EX.size, literal("5", datatype=XSD.int))
    assert g.has(s, EX.label, literal("L", "de")) and g.has(None, EX.name, literal("inner"))
    items = collections.read_lists(g, g.get(s, EX.all).df.select("o")).collect()[0]["items"]
    assert items[0] == "<http://b/d#a>" and len(items) == 2


def test_patterns(golden):
    people = golden.pattern("?s", RDF.type, EX.Person)
    knows = golden.pattern("?s", EX.knows, "?k")
    assert rows(people.optional(knows), "s", "k") == sorted([(EX.alice, EX.bob), (EX.bob, None)], key=str)
    assert rows(people.without(knows), "s") == [(EX.bob,)]
    assert rows(golden.pattern("?s", EX.age, "?a").filter(fn.numeric(F.col("a")) > 18), "s") == [(EX.alice,)]
    names = golden.pattern("?s", EX.name, "?n")
    assert names.df.count() == 4
    assert names.filter(fn.lang_matches(fn.lang(F.col("n")), "en")).df.count() == 1
    assert names.filter(fn.lang_matches(fn.lang(F.col("n")), "*")).df.count() == 2
    assert golden.pattern("?s", "?p", "?o").filter(fn.is_blank(F.col("o"))).df.count() == 3
    assert people.union(golden.pattern("?s", RDF.type, EX.Robot)).df.count() == 3
    assert golden.pattern("?x", "?p", "?x").df.count() == 0
    assert rows(golden.bgp(("?a", EX.knows, "?b"), ("?b", EX.name, "?n")), "a")[0] == (EX.alice,)
    assert golden.pattern(EX.alice, EX.knows, EX.bob).ask().first()[0] and not golden.pattern(EX.bob, EX.knows, "?x").ask().first()[0]


def test_join_on_a_variable_that_may_be_unbound(spark):
    left = Solutions(spark.createDataFrame([(1, "a"), (2, None)], "k int, x string"), maybe=frozenset("x"))
    right = Solutions(spark.createDataFrame([("a", 10), ("b", 20), (None, 30)], "x string, y int"), maybe=frozenset("x"))
    found = sorted(map(tuple, left.join(right).df.select("k", "x", "y").collect()), key=str)
    assert found == sorted([(1, "a", 10), (1, "a", 30), (2, "a", 10), (2, "b", 20), (2, None, 30)], key=str)


def test_optional_on_a_variable_that_may_be_unbound(spark):
    left = Solutions(spark.createDataFrame([(1, "a"), (2, None), (3, "z"), (3, "z")], "k int, x string"), maybe=frozenset("x"))
    right = Solutions(spark.createDataFrame([("a", 10), ("b", 20)], "x string, y int"))
    found = left.optional(right)
    want = [(1, "a", 10), (2, "a", 10), (2, "b", 20), (3, "z", None), (3, "z", None)]
    assert sorted(map(tuple, found.df.select("k", "x", "y").collect()), key=str) == sorted(want, key=str)
    filtered = left.optional(right, F.col("y") > 10).df.select("k", "x", "y").collect()
    none = Solutions(spark.createDataFrame([], "q int"))
    assert left.without(none).df.count() == 4 and left.without(Solutions(spark.range(2).toDF("q"))).df.count() == 0
    assert sorted(map(tuple, filtered), key=str) == sorted([(1, "a", None), (2, "b", 20), (3, "z", None), (3, "z", None)], key=str)


def test_construct_and_describe(spark, golden):
    made = golden.pattern("?s", EX.name, "?n").construct(("?s", EX.called, "?n"), ("_:b", EX.of, "?s"), ("?n", EX.bad, "?s"))
    assert made.where(F.col("p") == EX.called).count() == 4 and made.where(F.col("p") == EX.of).select("s").distinct().count() == 4
    assert made.where(F.col("p") == EX.bad).count() == 0
    with pytest.raises(ValueError, match="triple"):
        golden.pattern("?s", "?p", "?o").construct()
    assert golden.describe(spark.createDataFrame([(EX.carol,)], "s string")).count() == 4
    cycle = Graph.of(spark, [("_:a", EX.to, "_:b"), ("_:b", EX.to, "_:a")])
    assert cycle.describe(spark.createDataFrame([("_:a",)], "s string")).count() == 2


def test_set_operations_and_views(spark):
    a = Graph.of(spark, [(EX.a, EX.p, 1), (EX.a, EX.p, 1), (EX.b, EX.p, 2.5)])
    b = a.add((EX.c, EX.p, True)).remove((EX.a, EX.p, 1))
    assert (a.size(), b.size(), (a | b).size(), (a & b).size(), (a - b).size()) == (2, 2, 3, 1, 1)
    assert a.contains(EX.a, EX.p, 1) and not b.contains(EX.a, EX.p, 1) and Graph.empty(spark).size() == 0
    assert View(a, a).is_exact() and not View(a, b).is_exact() and View(a, b).added_to(a).size() == 3 and View(a, b).removed_from(a).size() == 1
    g = Graph.of(spark, [(EX.g, EX.a, EX.p, 1), (None, EX.a, EX.p, 1), (EX.h, EX.a, EX.p, 2)])
    assert g.default().size() == 1 and g.default(EX.g, EX.h).size() == 2 and g.named().size() == 2 and g.named(EX.h).size() == 1
    assert rows(g.pattern("?s", "?p", "?o", graph="?g"), "g") == [(EX.g,), (EX.h,)]


def test_store(spark, tmp_path):
    store = QuadStore(spark, f"{tmp_path}/quads")
    t = ("<file:test#test>", "<file:test#test>", "<file:test#test>")
    assert not store.has()
    pending = store.add(t)
    assert pending.has(*t) and not store.has(*t)
    pending.commit()
    assert store.has(*t)
    store.remove(t).add((EX.a, EX.p, EX.o)).commit()
    assert not store.has(*t) and store.has(EX.a)
    named = QuadStore(spark, f"{tmp_path}/quads", context=EX.g).add(t).commit()
    assert named.get().size() == 1 and store.get().size() == 2
    assert store.compact(f"{tmp_path}/compact").get().same(store.get())


def test_term_functions(spark):
    keys = [literal("01", datatype=XSD.integer), literal("1.0", datatype=XSD.double), literal("x"), literal("x", "en"), literal("x", datatype=EX.own), literal("y", datatype=EX.own), EX.a, "_:b", None]
    df = spark.createDataFrame([(i, a, b) for i, a in enumerate(keys) for b in keys], "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    found = {(r.a, r.b): (r.e, r.l) for r in df.select("a", "b", fn.equal(a, b).alias("e"), fn.less(a, b).alias("l")).collect()}
    assert found[keys[0], keys[1]] == (True, False) and found[keys[2], keys[3]][0] is False
    assert found[keys[4], keys[5]][0] is None and found[keys[4], keys[4]][0] is True and found[EX.a, "_:b"][0] is False
    one = spark.range(1)
    values = one.select(
        fn.lexical(F.lit(literal('a"\\n\n\t'))).alias("a"), fn.effective_boolean(F.lit(literal("0", datatype=XSD.integer))).alias("b"), fn.effective_boolean(F.lit(EX.a)).alias("c"),
        fn.datatype(F.lit(literal("x"))).alias("d"), fn.datatype(F.lit(literal("x", "en"))).alias("e"), fn.divide(F.lit(1.0), F.lit(0)).alias("f"), fn.lexical(F.lit("_:b")).alias("g"),
    ).first()
    assert tuple(values) == ('a"\\n\n\t', False, None, XSD.string[1:-1], None, float("inf"), None)
    ordered = spark.createDataFrame([(k,) for k in keys], "k string").orderBy(*fn.order_key(F.col("k"))).collect()
    assert [r.k for r in ordered][:3] == [None, "_:b", EX.a]


def test_lists(spark, golden):
    head = golden.get(EX.list1, EX["items"]).df.select("o")
    assert collections.read_lists(golden, head).first()["items"] == [literal("x"), literal("y")]
    long = spark.createDataFrame([("_:long", [literal(str(i)) for i in range(300)]), (RDF.nil, [])], "node string, items array<string>")
    g = Graph.from_triples(collections.build_lists(long))
    found = {r.node: r["items"] for r in collections.read_lists(g, long.select("node")).collect()}
    assert found == {"_:long": [literal(str(i)) for i in range(300)], RDF.nil: []}
    assert collections.list_frame(g, long.select("node")).size() == 600
    for extra, problem in ((("_:long", RDF.first, EX.two), "first"), (("_:x", RDF.rest, literal("z")), "first|literal")):
        with pytest.raises(collections.CollectionError, match=problem):
            collections.read_lists(g.add(extra), long.select("node"))
    cycle = Graph.of(spark, [("_:a", RDF.first, 1), ("_:a", RDF.rest, "_:b"), ("_:b", RDF.first, 2), ("_:b", RDF.rest, "_:a")])
    with pytest.raises(collections.CollectionError, match="cycle"):
        collections.read_lists(cycle, spark.createDataFrame([("_:a",)], "s string"))


def test_containers(spark):
    rows_ = spark.createDataFrame([("_:c", [EX.a, EX.b])], "node string, items array<string>")
    g = Graph.from_triples(collections.build_containers(rows_)).add(("_:gap", RDF._1, EX.a), ("_:gap", RDF._3, EX.c))
    assert {r.node: r["items"] for r in collections.read_containers(g).collect()} == {"_:c": [EX.a, EX.b], "_:gap": [EX.a]}


def test_restrictions_of_every_kind(spark):
    kinds = [f"{side}{q}{c}" for side in ("Object", "Data") for q in ("", "Qualified") for c in ("ExactCardinality", "MinCardinality", "MaxCardinality")]
    kinds += [f"{side}{c}" for side in ("Object", "Data") for c in ("SomeValuesFrom", "AllValuesFrom", "HasValue")] + ["NAryDataSomeValuesFrom", "NAryDataAllValuesFrom"]
    assert len(kinds) == 20
    made = []
    for i, kind in enumerate(kinds):
        data = "Data" in kind
        filler = literal("v") if kind == "DataHasValue" else EX.thing if kind == "ObjectHasValue" else XSD.int if data else EX.City
        counted = "Cardinality" in kind
        made.append((EX[f"r{i}"], kind, None if "NAry" in kind else EX.size if data else EX.near, [EX.size, EX.age] if "NAry" in kind else None, i if counted else None, filler if not counted or "Qualified" in kind else None))
    df = spark.createDataFrame(made, "s string, kind string, property string, properties array<string>, n int, filler string")
    g = Graph.from_triples(owl.make_restrictions(df)).add((EX.near, RDF.type, OWL.ObjectProperty), (EX.size, RDF.type, OWL.DatatypeProperty))
    assert sorted(map(tuple, owl.restrictions(g).select(*df.columns).collect()), key=str) == sorted(made, key=str)


def test_owl_axioms_made_and_read(spark):
    lists = spark.createDataFrame([(EX.U, [EX.A, EX.B])], "s string, items array<string>")
    chars = spark.createDataFrame([(EX.p, n) for n in owl.CHARACTERISTICS.values()], "s string, characteristic string")
    facts = spark.createDataFrame([(EX.a, EX.p, EX.b), (EX.a, EX.p, literal("x"))], "s string, p string, o string")
    made = [owl.make_class(lists, OWL.unionOf), owl.make_characteristics(chars), owl.make_negative_facts(facts), owl.make_group(lists, "AllDifferent")]
    g = Graph.from_triples(made[0].union(made[1]).union(made[2]).union(made[3]))
    assert rows(owl.unions(g), "s", "items") == [(EX.U, [EX.A, EX.B])]
    assert owl.characteristics(g).count() == 7
    assert rows(owl.negative_facts(g), "s", "p", "o") == rows(facts, "s", "p", "o")
    assert owl.disjoint_groups(g).first()["kind"] == "AllDifferent"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text(f"{EX.a} {EX.p} {EX.b} .\nbad\n{EX.a} {EX.q} {EX.b} .\n")
    found = ingest.matches(ingest.quads(spark, f"{tmp_path}/in"), "?s", EX.p, "?o").df
    ingest.append_to(found, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "s", "o") == [(EX.a, EX.b)]


def test_stream_into_a_store(spark, tmp_path):
    """Two files arrive one after the other; each batch is a version, and a query that starts again commits nothing twice."""
    (tmp_path / "in").mkdir()
    store = QuadStore(spark, f"{tmp_path}/store")
    for i, name in enumerate("ab"):
        (tmp_path / "in" / f"{name}.nt").write_text(f"{EX[name]} {EX.p} {EX.o} .\n{EX[name]} {EX.p} {EX.o} .\n")
        ingest.into_store(ingest.quads(spark, f"{tmp_path}/in"), store, "s", f"{tmp_path}/check").awaitTermination()
        assert store.versions() == list(range(1, i + 2)) and store.get().size() == i + 1
    ingest.into_store(ingest.quads(spark, f"{tmp_path}/in"), store, "s", f"{tmp_path}/lost").awaitTermination()
    assert store.get().size() == 2  # a stream that lost its place reads all again under the first number
    assert store.has(EX.a) and store.has(EX.b)

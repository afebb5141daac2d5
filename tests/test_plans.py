"""Plans that matter at scale: what is read, and which partitions."""

import os

import pytest
from pyspark.sql import functions as F

from quadrille.functions import terms as fn
from quadrille.operators import collections, owl
from quadrille.operators.quads import Graph
from quadrille.plans.mapping import TableGraph
from quadrille.sources.store import QuadStore
from quadrille.storage import CommitConflict, Versions, shared_folder
from quadrille.terms import DATATYPES, OWL, RDF, XSD, Namespace, literal

EX = Namespace("http://example.org/")
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_a_constant_predicate_reads_its_column_alone(spark):
    g = TableGraph(spark, SF)
    text = plan(g.pattern("customer", "?c", EX.c_acctbal, "?b").df)
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in text
    assert "ReadSchema: struct<c_custkey:bigint>" in plan(g.pattern("customer", "?c", RDF.type, EX.customer).df)
    with pytest.raises(ValueError, match="no properties"):
        g.triples("customer", "nothing")


def test_the_store_opens_only_files_that_may_hold_the_key(spark):
    """On all customers, a bound subject or object opens less than a twentieth of the files; a plan reads only those."""
    customers = TableGraph(spark, SF).materialize("customer")
    store = QuadStore(spark, shared_folder(spark, "test"), file_quads=10).add(graph=customers).commit()
    every = len(store.files())
    subject, value = customers.df.where(f"p = '{EX.c_name}'").select("s", "o").first()
    for parts in ({"s": subject}, {"o": value}):
        found = store.files(**parts)
        assert every > 60 and 1 <= len(found) < every / 20
        df = store.get(**parts).df
        assert sorted(f.replace('file:///', 'file:/') for f in df.inputFiles()) == found and df.count() == customers.get(**parts).size() > 0
        assert "Aggregate" not in plan(df)  # one batch without removals needs no grouping
    assert store.files(s=EX.nobody) == [] and not store.has(EX.nobody) and not store.has(o=EX.nothing)
    assert len(store.files(p=EX.c_name)) > 2  # a common predicate has several files of its own
    assert store.get(p=EX.c_name).size() == customers.get(p=EX.c_name).size()
    more = store.add((EX.a, EX.c_name, value)).commit()
    assert len(more.files(s=subject)) <= 2 and more.get(o=value).size() == 2 and len(more.files(s=EX.a)) == 1


def test_a_repeated_batch_of_a_stream_commits_nothing(spark):
    store = QuadStore(spark, shared_folder(spark, "test"))
    store.add((EX.a, EX.p, 1)).commit("s", 0)
    store.add((EX.b, EX.p, 1)).commit("s", 0)  # the same batch again
    store.add((EX.c, EX.p, 1)).commit("other", 0)
    assert store.versions() == [1, 2] and store.get().size() == 2
    compacted = store.compact()
    compacted.add((EX.d, EX.p, 1)).commit("s", 0)
    assert compacted.get().size() == 2
    compacted.add((EX.d, EX.p, 1)).commit("s", 1)
    assert compacted.get().size() == 3


def test_two_writers_of_a_store(spark, monkeypatch):
    path = shared_folder(spark, "test")
    first, second = QuadStore(spark, path).add((EX.a, EX.p, 1)), QuadStore(spark, path).add((EX.b, EX.p, 2))
    own = Versions.commit
    raced = []

    def commit(self, version, lines):
        if not raced:  # another writer commits between this one's reading and writing
            raced.append(version)
            second.commit()
        return own(self, version, lines)

    monkeypatch.setattr(Versions, "commit", commit)
    first.commit()
    monkeypatch.undo()
    store = QuadStore(spark, path)
    assert store.get().size() == 2 and store.versions() == [1, 2] and store.stored(version=1).size() == 1
    with pytest.raises(CommitConflict):
        Versions(spark, f"{path}/manifests").commit(2, [])
    assert store.compact().get().size() == 2 and store.stored(version=2).size() == 2


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(Session, "test")


def test_arithmetic_of_terms(spark):
    number = lambda text, kind: F.lit(literal(text, datatype=XSD[kind]))
    two, half, single, double, text = number("2", "int"), number("0.5", "decimal"), number("1.5", "float"), number("2.5", "double"), F.lit(literal("x"))
    values = [
        (fn.add(two, two), literal("4", datatype=XSD.integer)), (fn.add(two, half), literal("2.5", datatype=XSD.decimal)), (fn.multiply(two, half), literal("1", datatype=XSD.decimal)),
        (fn.add(two, single), literal("3.5", datatype=XSD.float)), (fn.subtract(double, single), literal("1.0", datatype=XSD.double)), (fn.divide_terms(two, two), literal("1", datatype=XSD.decimal)),
        (fn.divide_terms(two, number("0", "integer")), None), (fn.divide_terms(double, number("0", "integer")), literal("Infinity", datatype=XSD.double)), (fn.add(two, text), None),
        (fn.negate(half), literal("-0.5", datatype=XSD.decimal)), (fn.positive(text), None), (fn.positive(two), literal("2", datatype=XSD.int)), (fn.add(number("x", "int"), two), None),
        (fn.multiply(number("99999999999999999999", "integer"), two), None), (fn.subtract(number("100", "long"), number("90", "integer")), literal("10", datatype=XSD.integer)),
    ]
    row = spark.range(1).select(*[v.alias(f"v{i}") for i, (v, _) in enumerate(values)]).first()
    assert list(row) == [w for _, w in values]


def test_aggregates_of_terms(spark):
    rows = [("a", literal("10", datatype=XSD.int)), ("a", literal("9", datatype=XSD.int)), ("a", None), ("b", literal("1.5", datatype=XSD.decimal)), ("b", literal("1", datatype=XSD.integer)),
            ("c", literal("x")), ("c", EX.iri), ("d", None), ("e", literal("1", datatype=XSD.double)), ("e", literal("2", datatype=XSD.integer))]
    t = F.col("t")
    found = spark.createDataFrame(rows, "k string, t string").groupBy("k").agg(fn.sum_terms(t), fn.avg_terms(t), fn.min_term(t), fn.max_term(t))
    integer, decimal = (lambda x, kind=kind: literal(x, datatype=XSD[kind]) for kind in ("integer", "decimal"))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {
        "a": (integer("19"), decimal("9.5"), literal("9", datatype=XSD.int), literal("10", datatype=XSD.int)),
        "b": (decimal("2.5"), decimal("1.25"), integer("1"), decimal("1.5")),
        "c": (None, None, EX.iri, literal("x")),
        "d": (integer("0"), integer("0"), None, None),
        "e": (literal("3.0", datatype=XSD.double), literal("1.5", datatype=XSD.double), literal("1", datatype=XSD.double), integer("2")),
    }


def test_long_literals(spark):
    text = 'x" \\ \n' * 50_000
    key = literal(text)
    df = spark.createDataFrame([(key,)], "k string")
    assert df.select(fn.lexical(F.col("k"))).first()[0] == text and df.select(fn.equal(F.col("k"), F.col("k"))).first()[0] is True


def test_containers_with_several_values_at_an_ordinal(spark):
    g = Graph.of(spark, [("_:c", RDF._1, EX.b), ("_:c", RDF._1, EX.a), ("_:c", RDF._2, EX.c), ("_:c", RDF._4, EX.d)])
    assert collections.read_containers(g).first()["items"] == [EX.a, EX.b, EX.c]


def test_list_operations(spark):
    lists = spark.createDataFrame([("_:a", ['"1"', '"2"', '"3"']), ("_:b", ['"9"'])], "node string, items array<string>")
    g, nodes = Graph.from_triples(collections.build_lists(lists)), spark.createDataFrame([("_:a",), ("_:b",), (RDF.nil,)], "node string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(collections.heads(g, nodes)) == {("_:a", '"1"'), ("_:b", '"9"')} and rows(collections.items_at(g, nodes, 2)) == {("_:a", '"3"')}
    assert rows(collections.lengths(g, nodes)) == {("_:a", 3), ("_:b", 1), (RDF.nil, 0)}
    tail = collections.tails(g, nodes)
    assert rows(collections.lengths(g, tail.select("tail"))) == {(next(t for n, t in rows(tail) if n == "_:a"), 2), (RDF.nil, 0)}
    kept = collections.filter_lists(collections.map_lists(lists, lambda x: F.concat(x, F.lit("@en"))), lambda x: x != '"9"@en')
    assert {(r["node"], *r["items"]) for r in kept.collect()} == {("_:a", '"1"@en', '"2"@en', '"3"@en'), (RDF.nil,)}


def test_predefined_names():
    assert OWL.versionIRI in owl.ANNOTATIONS and len(owl.ANNOTATIONS) == 10
    assert len(DATATYPES) == len(set(DATATYPES)) == 42 and XSD.gYear in DATATYPES

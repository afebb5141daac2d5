"""Components, closures and equality of graphs against plain versions."""

import random

import pytest

from quadrille.operators.components import closure, connected, strong
from quadrille.operators.isomorphism import isomorphic
from quadrille.operators.quads import SCHEMA, Graph


def frame(spark, edges):
    return spark.createDataFrame([(str(a), str(b)) for a, b in edges], "a string, b string")


def rows(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_a_long_path_and_a_hub(spark):
    path = [(f"n{i:02}", f"n{i + 1:02}") for i in range(30)] + [("n30", f"x{i}") for i in range(50)]
    assert {r["component"] for r in connected(frame(spark, path)).collect()} == {"n00"}


def plain_reachable(edges):
    nodes = {x for e in edges for x in e}
    out = {n: {b for a, b in edges if a == n} for n in nodes}
    pairs = set()
    for n in nodes:
        todo, seen = list(out[n]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        pairs |= {(n, x) for x in seen}
    return pairs


GRAPHS = {
    "none": [],
    "cycle": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("f", "f"), ("g", "f"), ("m", "k"), ("k", "m"), ("e", "m")],
}


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Loops of small jobs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", GRAPHS)
def test_against_plain(spark, name):
    edges = GRAPHS[name]
    df = frame(spark, [*edges, *edges[:2]])
    pairs = plain_reachable(edges)
    nodes = {x for e in edges for x in e}
    around = plain_reachable(edges + [(b, a) for a, b in edges])
    assert rows(connected(df)) == {(n, min([n, *[m for x, m in around if x == n]])) for n in nodes}
    assert rows(strong(df)) == {(n, max([n, *[m for m in nodes if (n, m) in pairs and (m, n) in pairs]])) for n in nodes}
    assert rows(closure(df, reflexive=True)) == pairs | {(n, n) for n in nodes}


def quads(spark, triples):
    return spark.createDataFrame([(None, *map(str, t)) if len(t) == 3 else tuple(t) for t in triples], SCHEMA)


def renamed(triples, seed):
    rng = random.Random(seed)
    labels = sorted({x for t in triples for x in t if x and x.startswith("_:")})
    fresh = [f"_:z{i}" for i in range(len(labels))]
    rng.shuffle(fresh)
    new = dict(zip(labels, fresh))
    found = [tuple(new.get(x, x) for x in t) for t in triples]
    rng.shuffle(found)
    return found


def cycle(name, n, p="p"):
    return [(f"_:{name}{i}", p, f"_:{name}{(i + 1) % n}") for i in range(n)]


CASES = {
    "list": [("s", "p", "_:l0"), *[t for i in range(3) for t in ((f"_:l{i}", "first", "1"), (f"_:l{i}", "rest", f"_:l{i + 1}" if i < 2 else "nil"))]],
    "copies": [t for k in range(3) for t in ((f"_:a{k}", "p", f"_:b{k}"), (f"_:b{k}", "q", "end"))] + [("_:u", "p", "2"), ("_:v", "p", "2")],
    "cycles": cycle("c", 3) + cycle("d", 3),
    "named": [("_:g", "_:s", "p", "o"), ("_:g", "a", "p", "_:g"), (None, "_:s", "p", "_:g"), ("g", "_:k", "p", "1")],
}


@pytest.mark.parametrize("name", CASES)
def test_equal_up_to_labels(spark, name):
    a = quads(spark, CASES[name])
    assert isomorphic(a, quads(spark, renamed(CASES[name], 1)))
    last = CASES[name][-1]
    assert not isomorphic(a, quads(spark, renamed([*CASES[name][:-1], (*last[:-1], "other")], 2)))


def test_alike_but_not_equal(spark):
    """What colours alone cannot tell apart: one ring of six, two rings of three."""
    assert not isomorphic(quads(spark, cycle("c", 6)), quads(spark, renamed(CASES["cycles"], 1)))


def test_same(spark):
    g = Graph.of(spark, [("_:a", "http://e/p", 1), ("_:a", "http://e/q", "_:b")])
    h = Graph.of(spark, [("_:n", "http://e/p", 1), ("_:n", "http://e/q", "_:m")])
    assert g.same(h) and not g.same(h.remove(("_:n", "http://e/p", 1)))

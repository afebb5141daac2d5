"""Work that grows with the tables: it is dealt to more tasks, and what is computed is computed once."""

from pyspark.sql import functions as F

from quadrille.functions import terms as fn
from quadrille.operators import collections, isomorphism
from quadrille.operators.isomorphism import differing
from quadrille.operators.quads import SCHEMA, Graph
from quadrille.plans import mapping, solutions
from quadrille.plans.solutions import Solutions
from quadrille.sources import rdfxml, turtle
from quadrille.sources.store import QuadStore
from quadrille.storage import shared_folder
from quadrille.terms import XSD, literal


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_turtle_documents_go_to_as_many_tasks_as_their_length_asks(spark, monkeypatch):
    docs = spark.createDataFrame([(str(i), f"<http://e/{i}> <http://e/p> ( 1 2 ), _:b ; <http://e/q> [ <http://e/r> 'x' ] .") for i in range(30)], "doc string, text string")
    whole = {tuple(r) for r in turtle.parse(docs).collect()}
    monkeypatch.setattr(turtle, "TASK_TEXT", 100)
    found = turtle.parse(docs)
    assert found.rdd.getNumPartitions() >= 20
    assert {tuple(r) for r in found.collect()} == whole and len(whole) == 30 * 8


def test_rows_of_one_file_go_to_many_tasks(spark, tmp_path, monkeypatch):
    spark.range(1000).select(F.col("id").alias("p_partkey"), F.col("id").cast("int").alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    g = mapping.TableGraph(spark, str(tmp_path))
    whole = set(g.materialize("part").df.collect())
    monkeypatch.setattr(mapping, "TASK_ROWS", 100)
    df = g.materialize("part").df
    assert df.rdd.getNumPartitions() == 10
    assert set(df.collect()) == whole and len(whole) == 2000


def test_a_computed_key_is_computed_once(spark):
    key = F.concat("once", F.lit(""))
    for column in (fn.numeric(key), fn.less(key, key.substr(1, 9) * 0), fn.add(key, F.lit(literal("1", datatype=XSD.int)))):
        assert str(column).count("once") <= 2
    texts = ['"5"', '" 5\\n"', '"5\\\\n"', '"5\\""', '"x"', '""', '"-1.5E3"', '"NaN"']
    kinds = [XSD.int, XSD.double, XSD.decimal, XSD.string, XSD.date]
    rows = [(f"{t}^^{k}",) for t in texts for k in kinds] + [('"5"',), ('"5"@en',), ("<5>",), ("_:5",), (None,)]
    plain = F.when(fn.datatype(F.col("k")).isin([XSD[n][1:-1] for n in ("int", "double", "decimal")]), fn.lexical(F.col("k")).try_cast("double"))
    found = spark.createDataFrame(rows, "k string").select("k", fn.numeric(F.col("k")).alias("a"), plain.alias("b"))
    assert [r["k"] for r in found.collect() if str(r["a"]) != str(r["b"])] == []
    assert found.where("a is not null").count() == 12


def test_describe_makes_only_what_it_finds_distinct(spark):
    rows = [(None, f"<s{i}>", "<p>", f"<o{i}>") for i in range(5)] * 2 + [(None, "<s1>", "<q>", "_:b"), (None, "_:b", "<p>", "<x>")]
    g = Graph(spark.createDataFrame(rows, SCHEMA))
    found = g.describe(spark.createDataFrame([("<s1>",)], "s string"))
    assert sorted(tuple(r) for r in found.collect()) == [("<s1>", "<p>", "<o1>"), ("<s1>", "<q>", "_:b"), ("_:b", "<p>", "<x>")]
    assert _plan(found).count("Aggregate") == 2  # the resources, and what is found


def test_ground_quads_are_compared_in_one_grouping(spark):
    a = spark.createDataFrame([(None, "<s>", "<p>", "<o>")] * 2 + [("<g>", "<s>", "<p>", "<o>"), (None, "<a>", "<p>", "_:b")], SCHEMA)
    b = spark.createDataFrame([(None, "<s>", "<p>", "<o>"), (None, "<b>", "<p>", "<o>")], SCHEMA)
    assert {(r["g"], r["s"]) for r in differing(a, b).collect()} == {("<g>", "<s>"), (None, "<b>")}
    assert differing(a, a).isEmpty() and "Join" not in _plan(differing(a, b))


def test_rdfxml_triples_come_in_batches(spark):
    text = f"{rdfxml.HEADER}<rdf:Description rdf:about='http://e/s' xmlns:p='http://e/'><p:a>1</p:a><p:b>2</p:b></rdf:Description>{rdfxml.FOOTER}".split("\n", 1)[1]
    found = rdfxml.parse(spark.range(50).select(F.col("id").cast("string").alias("doc"), F.lit(text).alias("text")))
    assert "MapInArrow" in _plan(found) and found.count() == 100


def test_a_task_of_the_store_writes_many_small_files(spark):
    quads = spark.range(300).select(F.lit(None).cast("string").alias("g"), F.format_string("<http://e/%03d>", "id").alias("s"), F.lit("<http://e/p>").alias("p"), F.format_string('"%03d"', "id").alias("o"))
    store = QuadStore(spark, shared_folder(spark, "growth"), file_quads=20).add(graph=Graph(quads)).commit()
    names = store.files()
    assert len(names) == 15 and {n.rsplit("/", 1)[1].split("-")[1] for n in names} == {"00000"}
    assert len(store.files(s="<http://e/007>")) == 1 and store.get(s="<http://e/007>").size() == 1 and store.get().size() == 300


def test_equal_graphs_and_other_neighbours_are_told_without_rounds(spark, monkeypatch):
    a = spark.createDataFrame([(None, f"_:a{i}", "<p>", f"<o{i % 3}>") for i in range(9)] + [(None, "_:a0", "<q>", "_:a1")], SCHEMA)
    changed = spark.createDataFrame([(None, f"_:b{i}", "<p>", f"<o{i % 2}>") for i in range(9)] + [(None, "_:b0", "<q>", "_:b1")], SCHEMA)
    renamed = a.select("g", *[F.regexp_replace(c, "^_:a", "_:c").alias(c) for c in ("s", "p", "o")])
    assert isomorphism.isomorphic(a, renamed)
    monkeypatch.setattr(isomorphism, "_stable", None)  # rounds of colours
    assert not isomorphism.isomorphic(a, changed)
    monkeypatch.setattr(isomorphism, "checkpointed", None)
    assert isomorphism.isomorphic(a, a.union(a.limit(3)))


def test_aggregates_of_terms_over_counted_rows(spark, monkeypatch):
    keys = [literal(v, datatype=k) for v, k in (("5", XSD.int), ("7", XSD.int), ("5", XSD.long), ("1.25", XSD.decimal), ("2.5E0", XSD.double))]
    rows = [(g, k) for g, n in (("a", 3), ("b", 4), ("c", 5)) for i, k in enumerate(keys[:n]) for _ in range(i * 3 + 1)] + [("a", None), ("d", None), ("e", "<x>"), ("e", keys[0])]
    s = Solutions(spark.createDataFrame(rows, "b string, n string").repartition(3))
    n = F.col("n")
    others = [fn.sum_terms(n, distinct=True), fn.min_term(n), fn.max_term(n)]
    plain = s.aggregate(fn.sum_terms(n), fn.avg_terms(n), *others, by=["b"]).df.collect()
    counted = s.counted("n", "b")
    assert counted.df.count() == len(set(rows)) and "Aggregate" in _plan(counted.df)
    for most in (999_999_999, 2):  # the second: what comes up more often has several rows
        monkeypatch.setattr(solutions, "MOST_TIMES", most)
        times = F.col("_times")
        found = s.counted("n", "b").aggregate(fn.sum_terms(n, times=times), fn.avg_terms(n, times), *others, by=["b"]).df.collect()
        assert sorted(map(tuple, found), key=str) == sorted(map(tuple, plain), key=str) and len(found) == 5


def _joins_written(monkeypatch, *modules):
    """The plans of joins that these modules write down, as they come."""
    plans, write = [], collections.checkpointed

    def seen(df, *label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *label)

    for module in modules:
        monkeypatch.setattr(module, "checkpointed", seen)
    return plans


def test_cells_of_lists_are_not_broadcast(spark, monkeypatch):
    lists = spark.range(3).select(F.format_string("_:l%d", "id").alias("node"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: x.cast("string")).alias("items"))
    g = Graph.from_triples(collections.build_lists(lists))
    plans = _joins_written(monkeypatch, collections)
    members = collections.members(g, lists.select("node"))
    plans.append(members._jdf.queryExecution().executedPlan().toString())
    assert members.count() == 30
    assert sum("SortMergeJoin" in p for p in plans) > 4 and not any("BroadcastHashJoin" in p for p in plans)


def test_nested_turtle_is_joined_by_shuffle(spark, monkeypatch):
    rows = [("<s>", "<p>", "_:h")] + [t for i in range(4) for t in ((f"_:k{i}", "<n>", f'"{i}"'), (f"_:k{i}", "<m>", "_:one" if i == 0 else '"x"'))] + [("_:one", "<n>", '"y"')]
    lists = spark.createDataFrame([("_:h", [f"_:k{i}" for i in range(4)])], "node string, items array<string>")
    g = Graph.from_triples(spark.createDataFrame(rows, "s string, p string, o string").union(collections.build_lists(lists)))
    plans = _joins_written(monkeypatch, collections, turtle)
    text = turtle.blocks(g, nested=True).collect()
    assert [r["value"] for r in text] == ['<s> <p> ( [ <m> [ <n> "y" ] ; <n> "0" ] [ <m> "x" ; <n> "1" ] [ <m> "x" ; <n> "2" ] [ <m> "x" ; <n> "3" ] ) .']
    read = [p for p in plans if "FileScan parquet" in p]  # joins of what was written before
    assert len(read) > 10 and sum(p.count("BroadcastHashJoin") for p in read) <= 2  # the heads and ends of lists alone

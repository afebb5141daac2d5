"""Queries on stores, sets of triples, term arithmetic, lists and round trips over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import terms as fn
from quadrille.operators import collections
from quadrille.operators.quads import Graph, View
from quadrille.plans.mapping import BASE, TableGraph
from quadrille.plans.solutions import Solutions
from quadrille.register import EX, number, query, resource
from quadrille.sources import ntriples, rdfxml, turtle
from quadrille.sources.store import QuadStore
from quadrille.storage import checkpointed, shared_folder, unsent
from quadrille.terms import RDF, XSD, literal, literal_column

C = F.col


def _rows(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# Existence and membership


@query(
    "select 'any' as what, count(*) > 0 as there from customer union all select 'subject', count(*) > 0 from customer where c_custkey = 7 union all select 'nobody', count(*) > 0 from customer where c_custkey = -1 "
    "union all select 'segment', count(*) > 0 from customer where c_mktsegment = 'BUILDING' union all select 'triple', count(*) > 0 from customer where c_custkey = 7 and c_mktsegment = 'BUILDING' "
    "union all select 'name', count(*) > 0 from customer where c_custkey = 7 and c_name = 'Customer#000000007'"
)
def triple_has(spark, sf):
    """has() with every mix of bound parts, and contains()."""
    g = TableGraph(spark, sf).materialize("customer")
    segment = literal("BUILDING")
    found = [
        ("any", g.has()),
        ("subject", g.has(EX["customer/7"])),
        ("nobody", g.has(EX["customer/-1"])),
        ("segment", g.has(None, EX.c_mktsegment, segment)),
        ("triple", g.contains(EX["customer/7"], EX.c_mktsegment, segment)),
        ("name", g.has(EX["customer/7"], None, literal("Customer#000000007"))),
    ]
    return _rows(spark, "what string, there boolean", *found)


@query("select count(*) > 0 as answer from customer where c_acctbal > 9000 and c_mktsegment = 'BUILDING'")
def ask_customers(spark, sf):
    return TableGraph(spark, sf).star("customer", c_acctbal="b", c_mktsegment="m").filter((C("b") > 9000) & (C("m") == "BUILDING")).ask()


# The store


def _nations(spark, sf) -> QuadStore:
    return QuadStore(spark, shared_folder(spark, "store")).add(graph=TableGraph(spark, sf).materialize("nation"))


@query(
    "select 'empty' as step, 0::bigint as n union all select 'pending', 3 * count(*) from nation union all select 'stored before the commit', 0 union all select 'stored', 3 * count(*) from nation "
    "union all select 'repeated', 3 * count(*) from nation union all select 'removed', 3 * count(*) from nation where n_regionkey <> 1 union all select 'old version', 3 * count(*) from nation "
    "union all select 'compacted', 3 * count(*) from nation where n_regionkey <> 1"
)
def store_lifecycle(spark, sf):
    """Inserts are pending until the commit; removal is real; repeated quads count once; versions stay readable."""
    store = QuadStore(spark, shared_folder(spark, "store"))
    nation = TableGraph(spark, sf).materialize("nation")
    found = [("empty", store.get().size())]
    pending = store.add(graph=nation)
    found += [("pending", pending.get().size()), ("stored before the commit", store.get().size())]
    pending.commit()
    found += [("stored", store.get().size())]
    store.add(graph=nation).commit()
    found += [("repeated", store.get().size())]
    of_region = nation.get(None, EX.n_regionkey, EX["region/1"]).df.select("s")
    store.remove(graph=Graph(nation.df.join(of_region, "s", "left_semi").select("g", "s", "p", "o"))).commit()
    found += [("removed", store.get().size()), ("old version", store.stored(version=1).size()), ("compacted", store.compact().get().size())]
    return _rows(spark, "step string, n long", *found)


@query("select c_custkey as c, c_mktsegment as segment from customer")
def store_read_predicate(spark, sf):
    """A stored table read by predicate: only files that hold the predicate are opened."""
    store = QuadStore(spark, shared_folder(spark, "store")).add(graph=TableGraph(spark, sf).materialize("customer")).commit()
    return store.get(p=EX.c_mktsegment).df.select(number("s", "c"), fn.lexical(C("o")).alias("segment"))


@query(
    "select 'object' as bound, c_custkey as n from customer where c_nationkey = 7 union all select 'subject', c_nationkey from customer where c_custkey = 3 "
    "union all select 'both', c_custkey from customer where c_nationkey = 8 and c_custkey < 100"
)
def store_lookup(spark, sf):
    """A store of all customers in many small files, read by object and by subject: its index names the few files to open."""
    customers = TableGraph(spark, sf).materialize("customer")
    store = QuadStore(spark, shared_folder(spark, "store"), file_quads=500).add(graph=customers).commit()
    by_object = store.get(p=EX.c_nationkey, o=EX["nation/7"]).df.select(F.lit("object").alias("bound"), number("s", "n"))
    by_subject = store.get(s=EX["customer/3"]).get(p=EX.c_nationkey).df.select(F.lit("subject"), number("o"))
    both = store.get(o=EX["nation/8"]).df.select(F.lit("both"), number("s").alias("n")).where("n < 100")
    return by_object.union(by_subject).union(both)


@query("select 'equal' as pair, true as same union all select 'renamed', true union all select 'changed', (select count(*) from customer where c_custkey = 3) = 0")
def graph_same(spark, sf):
    """Customers as blank nodes, two by two: a graph, the same with other labels, and one with a change."""
    customer = TableGraph(spark, sf).table("customer")
    node = lambda label, key: F.concat(F.lit(f"_:{label}"), F.xxhash64(F.lit(label), key).cast("string"))

    def made(label, changed=-1):
        nation = resource("nation", F.when(C("c_custkey") == changed, C("c_nationkey") + 1).otherwise(C("c_nationkey")))
        lives = customer.select(node(label, C("c_custkey")).alias("s"), F.lit(EX.lives).alias("p"), nation.alias("o"))
        pairs = customer.where("c_custkey % 2 = 1").select(node(label, C("c_custkey")).alias("s"), F.lit(EX.near).alias("p"), node(label, C("c_custkey") + 1).alias("o"))
        return Graph.from_triples(lives.union(pairs))

    first = made("a")
    return _rows(spark, "pair string, same boolean", ("equal", first.same(first)), ("renamed", first.same(made("b"))), ("changed", first.same(made("c", 3))))


@query("select 'named' as context, 3 * count(*) as n from nation union all select 'all', (select 3 * count(*) from nation) + (select 2 * count(*) from region)")
def store_context(spark, sf):
    """A store limited to a named graph sees and writes that graph only."""
    g, path = TableGraph(spark, sf), shared_folder(spark, "store")
    named = QuadStore(spark, path, context=EX["graph/n"]).add(graph=g.materialize("nation")).commit()
    whole = QuadStore(spark, path).add(graph=g.materialize("region")).commit()
    count = lambda store, name: store.get().df.groupBy(F.lit(name).alias("context")).agg(F.count("*").alias("n"))
    return count(named, "named").union(count(whole, "all"))


@query("select count(*) > 0 as there, count(*) > 1 as more from customer where c_custkey = 3")
def store_has(spark, sf):
    store = QuadStore(spark, shared_folder(spark, "store")).add(graph=TableGraph(spark, sf).graph("customer", "c_name")).commit()
    return _rows(spark, "there boolean, more boolean", (store.contains(EX["customer/3"], EX.c_name, literal("Customer#000000003")), store.has(EX["customer/3"], EX.other)))


# Sets of triples


@query("select c_custkey as s from customer where c_custkey <> 1 union all select -1")
def graph_add_remove(spark, sf):
    names = TableGraph(spark, sf).graph("customer", "c_name")
    changed = names.add((EX["customer/none"], EX.c_name, literal("x")), (EX["customer/5"], EX.c_name, literal("Customer#000000005")))
    changed = changed.remove((EX["customer/1"], EX.c_name, literal("Customer#000000001")), (EX["customer/2"], EX.c_name, literal("other")))
    return changed.df.select(F.coalesce(F.regexp_extract("s", r"/(\d+)>$", 1).try_cast("long"), F.lit(-1)).alias("s"))


@query("select c_custkey as c from customer where c_acctbal > 0 or c_mktsegment = 'BUILDING'")
def graph_union_customers(spark, sf):
    a, b = _by_balance(spark, sf)
    return (a | b).df.select(number("s", "c"))


@query("select c_custkey as c from customer where c_acctbal > 0 and c_mktsegment = 'BUILDING'")
def graph_intersect_customers(spark, sf):
    a, b = _by_balance(spark, sf)
    return (a & b).df.select(number("s", "c"))


@query("select c_custkey as c from customer where c_acctbal > 0 and c_mktsegment <> 'BUILDING'")
def graph_difference_customers(spark, sf):
    a, b = _by_balance(spark, sf)
    return (a - b).df.select(number("s", "c"))


def _by_balance(spark, sf) -> tuple[Graph, Graph]:
    """Names of customers with money, and of those who build."""
    rows = TableGraph(spark, sf).table("customer").select(
        F.lit(None).cast("string").alias("g"), resource("customer", C("c_custkey")).alias("s"), F.lit(EX.c_name).alias("p"), literal_column(C("c_name")).alias("o"), "c_acctbal", "c_mktsegment"
    )
    return Graph(rows.where("c_acctbal > 0").select("g", "s", "p", "o")), Graph(rows.where("c_mktsegment = 'BUILDING'").select("g", "s", "p", "o"))


@query(
    "select 'universe' as part, 5 * count(*) as n, false as is_exact from customer union all select 'frame', count(*), true from customer union all select 'added', 5 * count(*) + (select 2 * count(*) from region), false from customer "
    "union all select 'removed', 4 * count(*), false from customer"
)
def view_frames(spark, sf):
    """A view whose frame is one property: its frame added to and removed from graphs, and whether views are exact."""
    g = TableGraph(spark, sf)
    customers = g.materialize("customer")
    view = View(customers, customers.get(None, EX.c_name))
    whole = View(customers, customers)
    found = [
        ("universe", whole.frame.size(), view.is_exact()),
        ("frame", view.frame.size(), View(view.frame, view.frame).is_exact()),
        ("added", whole.added_to(g.materialize("region")).size(), False),
        ("removed", view.removed_from(customers).size(), view.is_exact()),
    ]
    return _rows(spark, "part string, n long, is_exact boolean", *found)


@query("select o_custkey as c, count(distinct o_orderstatus) as n from orders group by o_custkey")
def graph_build(spark, sf):
    """A graph of rows of which many repeat: a set has each triple once."""
    orders = TableGraph(spark, sf).table("orders")
    built = Graph.from_triples(orders.select(resource("customer", C("o_custkey")).alias("s"), F.lit(EX.status).alias("p"), literal_column(C("o_orderstatus")).alias("o")))
    return built.df.groupBy(number("s", "c")).agg(F.count("*").alias("n"))


@query("select c_custkey as c, 5::bigint as n from customer where c_nationkey = 3")
def describe_customers(spark, sf):
    """DESCRIBE of all customers of a nation, with the triples of each."""
    g = TableGraph(spark, sf).materialize("customer")
    found = g.describe(g.pattern("?c", EX.c_nationkey, EX["nation/3"]).df)
    return found.groupBy(number("s", "c")).agg(F.count("*").alias("n"))


# Expressions on term keys


@query("select d.doc_id as doc, l.quality is not null as labelled from documents d left join labels l on d.doc_id = l.doc_id")
def filter_bound(spark, sf):
    g = TableGraph(spark, sf)
    found = g.star("documents", "doc").optional(g.star("labels", "doc", quality="quality"))
    return found.df.select("doc", fn.bound(C("quality")).alias("labelled"))


@query(
    "select c_custkey as c, round(c_acctbal + 1.5, 6) as plus, round(c_acctbal - 10, 6) as minus, round(c_acctbal * 2, 6) as times, round(c_acctbal / 4, 6) as over, -c_acctbal as neg from customer where c_acctbal - 10 > 100"
)
def arith_terms(spark, sf):
    """Arithmetic on literals of doubles, decimals and integers, promoted to double, in values and in a filter."""
    rows = TableGraph(spark, sf).pattern("customer", "?c", EX.c_acctbal, "?b")
    b = C("b")
    integer = lambda n: F.lit(literal(str(n), datatype=XSD.integer))
    minus = fn.subtract(b, integer(10))
    values = {"plus": fn.add(b, F.lit(literal("1.5", datatype=XSD.decimal))), "minus": minus, "times": fn.multiply(integer(2), b), "over": fn.divide_terms(b, integer(4)), "neg": fn.negate(b)}
    found = rows.filter(fn.less(integer(100), minus)).df
    return found.select(number("c"), *[F.round(fn.numeric(v), 6).alias(n) for n, v in values.items()])


@query("select p_partkey as part, cast(p_size + 1 as varchar) as plus, cast(p_size * p_size as varchar) as square, cast(-p_size as varchar) as neg, 'http://www.w3.org/2001/XMLSchema#integer' as kind, 'http://www.w3.org/2001/XMLSchema#decimal' as kind_over from part")
def arith_integers(spark, sf):
    """Integers stay exact; their quotient is a decimal."""
    rows = TableGraph(spark, sf).pattern("part", "?part", EX.p_size, "?n").df
    one = F.lit(literal("1", datatype=XSD.int))
    plus, square, neg = fn.add(C("n"), one), fn.multiply(C("n"), C("n")), fn.negate(C("n"))
    return rows.select(
        number("part"), fn.lexical(plus).alias("plus"), fn.lexical(square).alias("square"), fn.lexical(neg).alias("neg"), fn.datatype(plus).alias("kind"), fn.datatype(fn.divide_terms(C("n"), one)).alias("kind_over")
    )


@query("select p_partkey as part, p_size <> 0 as size, true as name, null::boolean as self from part")
def filter_ebv(spark, sf):
    """Effective boolean values of numbers, texts and IRIs (an error)."""
    rows = TableGraph(spark, sf).graph("part", "p_size", "p_name").bgp(("?part", EX.p_size, "?n"), ("?part", EX.p_name, "?m")).df
    ebv = fn.effective_boolean
    return rows.select(number("part"), ebv(C("n")).alias("size"), ebv(C("m")).alias("name"), ebv(C("part")).alias("self"))


@query("select count(*) as equal_values, sum((a.p_size = b.p_size + 1)::int)::bigint as next from part a join part b on a.p_partkey = b.p_partkey + 1 where a.p_size = b.p_size or a.p_size = b.p_size + 1")
def filter_term_compare(spark, sf):
    """Equality and order of literals by value, across datatypes."""
    sizes = TableGraph(spark, sf).table("part").select(C("p_partkey").alias("k"), literal_column(C("p_size"), datatype=XSD.int).alias("a"), literal_column(C("p_size").cast("double"), datatype=XSD.double).alias("b"))
    pairs = sizes.select("k", "a").join(sizes.select((C("k") + 1).alias("k"), "b"), "k")
    one = F.lit(literal("1", datatype=XSD.integer))
    follows = fn.equal(C("a"), fn.add(C("b"), one))
    return pairs.where(fn.equal(C("a"), C("b")) | follows).agg(F.count("*").alias("equal_values"), F.sum(follows.cast("long")).alias("next"))


# Aggregates of term keys


@query("select p_brand as brand, cast(sum(p_size) as varchar) as total, cast(sum(distinct p_size) as varchar) as values, round(avg(p_size), 6) as mean, cast(min(p_size) as varchar) as least, cast(max(p_size) as varchar) as most from part group by p_brand")
def agg_terms(spark, sf):
    """Aggregates of literals: exact sums of integers, and the least and greatest by value rather than by text."""
    rows = TableGraph(spark, sf).graph("part", "p_size", "p_brand").bgp(("?part", EX.p_size, "?n"), ("?part", EX.p_brand, "?b"))
    n, times = C("n"), C("_times")
    found = rows.counted("n", "b").aggregate(fn.sum_terms(n, times=times).alias("total"), fn.sum_terms(n, distinct=True).alias("values"), fn.avg_terms(n, times).alias("mean"), fn.min_term(n).alias("least"), fn.max_term(n).alias("most"), by=["b"]).df
    text = [fn.lexical(C(c)).alias(c) for c in ("total", "values", "least", "most")]
    return found.select(fn.lexical(C("b")).alias("brand"), *text, F.round(fn.numeric(C("mean")), 6).alias("mean"))


@query("select round(sum(c_acctbal), 2) as total, round(avg(c_acctbal), 2) as mean, min(c_acctbal) as least, max(c_acctbal) as most from customer")
def agg_terms_double(spark, sf):
    rows = TableGraph(spark, sf).pattern("customer", "?c", EX.c_acctbal, "?b")
    b, value = C("b"), lambda agg: fn.numeric(agg)
    found = rows.aggregate(fn.sum_terms(b).alias("total"), fn.avg_terms(b).alias("mean"), fn.min_term(b).alias("least"), fn.max_term(b).alias("most")).df
    return found.select(F.round(value(C("total")), 2).alias("total"), F.round(value(C("mean")), 2).alias("mean"), value(C("least")).alias("least"), value(C("most")).alias("most"))


@query("select count(*) as n, count(distinct (o_orderpriority, o_orderstatus)) as kinds from orders")
def agg_count_distinct_all(spark, sf):
    s = TableGraph(spark, sf).star("orders", o_orderpriority="priority", o_orderstatus="status")
    return s.aggregate(s.count_all().alias("n"), s.count_all(distinct=True).alias("kinds")).df


@query("select c_nationkey as n, true as one_of_them from customer group by c_nationkey")
def agg_sample_member(spark, sf):
    """SAMPLE gives some value of the group."""
    s = TableGraph(spark, sf).star("customer", c_nationkey="n", c_name="name").aggregate(F.any_value("name").alias("name"), by=["n"])
    members = TableGraph(spark, sf).star("customer", c_nationkey="n", c_name="name")
    return s.df.join(members.df.withColumn("one_of_them", F.lit(True)), ["n", "name"], "left").select("n", F.coalesce("one_of_them", F.lit(False)).alias("one_of_them"))


# Lists and containers


def _turns(spark, sf) -> DataFrame:
    """(node, items): each conversation's roles and texts as a list."""
    turns = TableGraph(spark, sf).table("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("turn", "text"))).alias("t"))
    return turns.select(F.concat(F.lit("_:l"), C("conv_id").cast("string")).alias("node"), F.transform("t", lambda x: literal_column(x["text"])).alias("items"))


_TURNS = "(select distinct conv_id, turn, text from conversations)"


def _conv() -> Column:
    return F.regexp_extract("node", r"(\d+)$", 1).cast("long").alias("conv")


@query(
    f"with t as (select *, row_number() over (partition by conv_id order by turn, text) as r, count(*) over (partition by conv_id) as n from {_TURNS}) "
    "select a.conv_id as conv, a.text as head, b.text as second, a.n as length, a.n > 1 as has_tail from t a left join t b on a.conv_id = b.conv_id and b.r = 2 where a.r = 1"
)
def list_parts(spark, sf):
    """Head, tail, a member by position and length of many lists at once."""
    lists = _turns(spark, sf)
    g, nodes = Graph.from_triples(collections.build_lists(lists)), lists.select("node")
    head = collections.heads(g, nodes).select("node", fn.lexical(C("val")).alias("head"))
    second = collections.items_at(g, nodes, 1).select("node", fn.lexical(C("val")).alias("second"))
    tail = collections.tails(g, nodes).select("node", (C("tail") != RDF.nil).alias("has_tail"))
    found = head.join(second, "node", "left").join(tail, "node").join(collections.lengths(g, nodes), "node")
    return found.select(_conv(), "head", "second", C("n").alias("length"), "has_tail")


@query(f"select conv_id as conv, count(*) filter (length(text) > 40) as n, coalesce(sum(length(text) + 1) filter (length(text) > 40), 0)::bigint as characters from {_TURNS} group by conv_id having count(*) filter (length(text) > 40) > 0")
def list_map_filter(spark, sf):
    """Lists changed member by member and filtered, written as lists again and read back."""
    lists = collections.filter_lists(_turns(spark, sf), lambda x: F.length(fn.lexical(x)) > 40)
    changed = collections.map_lists(lists, lambda x: literal_column(F.concat(fn.lexical(x), F.lit("!")))).where(C("node") != RDF.nil)
    read = collections.read_lists(Graph.from_triples(collections.build_lists(changed)), changed.select("node"))
    characters = F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc + F.length(fn.lexical(x)))
    return read.select(_conv(), F.size("items").cast("long").alias("n"), characters.alias("characters"))


@query(f"select count(*) * 2 as frame, (select count(distinct conv_id) from conversations) as lists, true as nil from {_TURNS}")
def list_frames(spark, sf):
    """The triples that lists reach, and the empty list."""
    lists = _turns(spark, sf).withColumn("node", C("node"))
    g = Graph.from_triples(collections.build_lists(lists))
    frame = collections.list_frame(g, lists.select("node")).df.agg(F.count("*").alias("frame"))
    nil = collections.read_lists(g, spark.createDataFrame([(RDF.nil,)], "node string")).select((F.size("items") == 0).alias("nil"))
    return frame.crossJoin(lists.agg(F.count("*").alias("lists"))).crossJoin(nil)


@query("select n_nationkey as n, case n_nationkey % 3 when 0 then 'not exactly one rdf:first' when 1 then 'not exactly one rdf:rest' else 'rdf:rest is a literal' end as problem from nation")
def list_problems(spark, sf):
    """Lists that are not well formed: a second first, a second rest, a literal rest."""
    rows = TableGraph(spark, sf).table("nation").select(F.concat(F.lit("_:n"), C("n_nationkey").cast("string")).alias("node"), F.array(literal_column(C("n_name"))).alias("items"), (C("n_nationkey") % 3).alias("k"))
    good = collections.build_lists(rows)
    literal_rest = rows.where("k = 2").select(C("node").alias("s"), F.lit(RDF.rest).alias("p"), F.lit('"x"').alias("o"))
    first = rows.where("k = 0").select("node", F.lit(RDF.first), F.lit(EX.two))
    rest = rows.where("k = 1").select("node", F.lit(RDF.rest), F.lit(EX.two))
    plain = good.join(rows.where("k = 2").select(C("node").alias("s")), "s", "left_semi").where(C("p") == RDF.first).select("s", "p", "o")
    others = good.join(rows.where("k < 2").select(C("node").alias("s")), "s", "left_semi").select("s", "p", "o")
    g = Graph.from_triples(plain.union(others).union(literal_rest).union(first).union(rest))
    return collections.list_errors(g).select(F.regexp_extract("node", r"(\d+)$", 1).cast("int").alias("n"), "problem")


@query("select vec_id as vec, i - 1 as pos, embedding[i] as val from (select *, unnest(range(1, len(embedding) + 1)) as i from embeddings)")
def container_members(spark, sf):
    """Embeddings as RDF containers, built and read back member by member."""
    vectors = TableGraph(spark, sf).table("embeddings")
    rows = vectors.select(F.concat(F.lit("_:v"), C("vec_id").cast("string")).alias("node"), F.transform("embedding", lambda x: literal_column(x, datatype=XSD.float)).alias("items"))
    read = collections.read_containers(Graph.from_triples(collections.build_containers(rows)))
    return read.select(F.substr("node", F.lit(4)).cast("long").alias("vec"), F.posexplode("items").alias("pos", "key")).select("vec", C("pos").cast("long").alias("pos"), fn.lexical(C("key")).cast("float").alias("val"))


# Round trips


@query(f"select '<{BASE}orders/' || o_orderkey || '>' as s, '<{BASE}customer/' || o_custkey || '>' as o from orders")
def ntriples_roundtrip(spark, sf):
    """Orders written as N-Triples lines to shared storage and read back."""
    path = f"{shared_folder(spark, 'ntriples')}/lines"
    ntriples.write(TableGraph(spark, sf).graph("orders", "o_custkey", "o_orderstatus"), path)
    return ntriples.read(spark, path).get(None, EX.o_custkey).df.select("s", "o")


@query("select count(*) as n from documents where text is not null")
def ntriples_texts(spark, sf):
    """Long texts with line ends and quotes come back from N-Triples as they were."""
    path, g = f"{shared_folder(spark, 'ntriples')}/lines", TableGraph(spark, sf).graph("documents", "text")
    ntriples.write(g, path)
    return (ntriples.read(spark, path) & g).df.agg(F.count("*").alias("n"))


@query("select c_custkey as c, c_custkey % 10 <> 0 as good from customer")
def ntriples_bad_lines(spark, sf):
    """Lines of customers' names, of which every tenth lacks its end: which are statements."""
    customer = TableGraph(spark, sf).table("customer")
    end = F.when(C("c_custkey") % 10 == 0, "").otherwise(" .")
    lines = customer.select(F.concat(resource("customer", C("c_custkey")), F.lit(f" {EX.name} "), literal_column(C("c_name")), end).alias("value"))
    found = ntriples.statements(lines)
    return found.select(F.regexp_extract("line", r"/(\d+)>", 1).cast("long").alias("c"), C("s").isNotNull().alias("good"))


@query("select c_custkey as c, c_custkey % 2 = 1 as blank from customer")
def filter_isblank(spark, sf):
    """Objects that are blank nodes for every other customer, and the customers' IRIs for the others."""
    customer = TableGraph(spark, sf).table("customer")
    o = F.when(C("c_custkey") % 2 == 1, F.concat(F.lit("_:c"), C("c_custkey"))).otherwise(resource("customer", C("c_custkey")))
    g = Graph.from_triples(customer.select(resource("customer", C("c_custkey")).alias("s"), F.lit(EX.same).alias("p"), o.alias("o")))
    blank, iri = (g.pattern("?s", EX.same, "?o").filter(test(C("o"))).df for test in (fn.is_blank, fn.is_iri))
    return blank.select(number("s", "c"), F.lit(True).alias("blank")).union(iri.select(number("s"), F.lit(False)))


@query("select c_nationkey as nation, row_number() over (partition by c_nationkey order by c_custkey) - 1 as pos, c_name as name, c_acctbal as balance from customer")
def turtle_nested(spark, sf):
    """Lists of blank nodes (every nation's customers), written nested as one Turtle statement a nation, and read again."""
    t = TableGraph(spark, sf).table("customer")
    node = F.concat(F.lit("_:k"), C("c_custkey").cast("string"))
    said = lambda p, o: t.select(node.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    listed = t.groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_custkey")).alias("k"))
    head = F.concat(F.lit("_:h"), C("c_nationkey").cast("string"))
    lists = listed.select(resource("nation", C("c_nationkey")).alias("s"), head.alias("node"), F.transform("k", lambda x: F.concat(F.lit("_:k"), x.cast("string"))).alias("items"))
    triples = collections.build_lists(lists.select("node", "items")).union(lists.select("s", F.lit(EX.customers), "node"))
    triples = triples.union(said(EX.name, literal_column(C("c_name")))).union(said(EX.balance, literal_column(C("c_acctbal"), datatype=XSD.double)))
    text = turtle.blocks(Graph.from_triples(triples), {"": BASE}, nested=True)
    parsed = turtle.parse(text.select(C("s").alias("doc"), F.concat(F.lit(turtle.header({"": BASE})), "value").alias("text")))
    read = Graph(unsent(checkpointed(Graph.from_triples(parsed.select("s", "p", "o")).df)))  # parsed once for all that reads it
    heads = read.pattern("?nation", EX.customers, "?list").df
    members = collections.members(read, heads.select("list")).withColumnsRenamed({"node": "list", "val": "k"})
    named = read.bgp(("?k", EX.name, "?name"), ("?k", EX.balance, "?balance")).df
    found = heads.join(members, "list").join(unsent(named), "k")
    return found.select(number("nation").cast("int").alias("nation"), "pos", fn.lexical(C("name")).alias("name"), fn.numeric(C("balance")).alias("balance"))


@query("select 'customers' as part, count(*) as n from customer union all select 'nobody', 0")
def pattern_without_variables(spark, sf):
    """A pattern without variables is one empty solution if its triple is there."""
    g = TableGraph(spark, sf).materialize("customer")
    there = g.pattern(EX["customer/0"], RDF.type, EX.customer).join(g.pattern("?c", RDF.type, EX.customer)).df
    nobody = g.pattern(EX["customer/none"], RDF.type, EX.customer).join(Solutions(there.select("c"))).df
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(there, "customers").union(count(nobody, "nobody"))


# Files


@query("select c_custkey as c, 'name' as p, c_name as o from customer union all select c_custkey, 'segment', c_mktsegment from customer union all select c_custkey, 'note', 'Line one. ' || chr(10) || c_name || ' .' from customer")
def turtle_files(spark, sf):
    """All customers written to files of many statements and read back through blocks, segments and documents; long texts
    reach over lines."""
    customer, path = TableGraph(spark, sf).table("customer"), shared_folder(spark, "turtle")
    about = lambda p, o: customer.select(resource("customer", C("c_custkey")).alias("s"), F.lit(p).alias("p"), literal_column(o).alias("o"))
    note = F.concat(F.lit("Line one. \n"), C("c_name"), F.lit(" ."))
    g = Graph.from_triples(about(EX.name, C("c_name")).union(about(EX.segment, C("c_mktsegment"))).union(about(EX.note, note)))
    turtle.write(g, path, {"": BASE})
    found = turtle.read(spark, path).df
    return found.select(number("s", "c"), F.regexp_extract("p", r"([a-z]+)>$", 1).alias("p"), fn.lexical(C("o")).alias("o"))


@query("select c_custkey as c, c_name as name from customer")
def rdfxml_files(spark, sf):
    """All customers written to RDF/XML files and read back."""
    customer, path = TableGraph(spark, sf).table("customer"), shared_folder(spark, "rdfxml")
    g = Graph.from_triples(customer.select(resource("customer", C("c_custkey")).alias("s"), F.lit(EX.name).alias("p"), literal_column(C("c_name")).alias("o")))
    rdfxml.write(g, path)
    return rdfxml.read(spark, path).df.select(number("s", "c"), fn.lexical(C("o")).alias("name"))

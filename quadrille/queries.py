"""Queries over the driver's tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import registry
from quadrille.functions import terms as fn
from quadrille.operators import collections, owl
from quadrille.operators.quads import Graph
from quadrille.plans.mapping import BASE, TableGraph
from quadrille.plans.ordering import ordered
from quadrille.plans.solutions import Solutions
from quadrille.register import EX, ORACLES, QUERIES, query
from quadrille.sources import rdfxml, turtle
from quadrille.terms import RDF, XSD, literal, literal_column

__all__ = ["ORACLES", "QUERIES"]
C = F.col


def _iri(table: str, column: str) -> str:
    return f"'{BASE}{table}/' || {column}"


# Basic graph patterns


@query("select c_name as name, c_acctbal as balance from customer")
def bgp_single_table(spark, sf):
    return TableGraph(spark, sf).star("customer", c_name="name", c_acctbal="balance").df


@query("select c_name as name, o_totalprice as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_name = 'NATION_2' and o_totalprice > 300000")
def bgp_join_2(spark, sf):
    g = TableGraph(spark, sf)
    orders = g.star("orders", o_custkey="c", o_totalprice="total").filter(C("total") > 300000)
    customers = g.star("customer", "c", c_name="name", c_nationkey="n")
    nations = g.star("nation", "n", n_name="nation").filter(C("nation") == "NATION_2")
    return orders.join(customers).join(nations).select("name", "total").df


@query(
    f"select {_iri('orders', 'o_orderkey')} as o, c_name as customer, n_name as nation, l_quantity as quantity from lineitem join orders on l_orderkey = o_orderkey "
    "join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where l_quantity >= 49"
)
def bgp_path_4(spark, sf):
    g = TableGraph(spark, sf)
    lines = g.star("lineitem", l_orderkey="o", l_quantity="quantity").filter(C("quantity") >= 49)
    path = lines.join(g.star("orders", "o", o_custkey="c")).join(g.star("customer", "c", c_name="customer", c_nationkey="n")).join(g.star("nation", "n", n_name="nation"))
    return path.select("o", "customer", "nation", "quantity").rendered().df


@query("select l_quantity as quantity, l_extendedprice as price, l_discount as discount, l_returnflag as flag from lineitem")
def bgp_star_lineitem(spark, sf):
    return TableGraph(spark, sf).star("lineitem", l_quantity="quantity", l_extendedprice="price", l_discount="discount", l_returnflag="flag").df


@query("select r_name, n_name from region cross join nation")
def cross_product(spark, sf):
    g = TableGraph(spark, sf)
    return g.star("region", r_name="r_name").join(g.star("nation", n_name="n_name")).df


# Filters and expressions


@query("select p_name as name, p_retailprice as price from part where p_retailprice > 950 and p_size <= 10")
def filter_numeric(spark, sf):
    return TableGraph(spark, sf).star("part", p_name="name", p_retailprice="price", p_size="size").filter((C("price") > 950) & (C("size") <= 10)).select("name", "price").df


@query(f"select {_iri('customer', 'c_custkey')} as c from customer where c_mktsegment = 'BUILDING'")
def filter_string_eq(spark, sf):
    return TableGraph(spark, sf).star("customer", "c", c_mktsegment="segment").filter(C("segment") == "BUILDING").select("c").rendered().df


@query("select s_name as name from supplier where (s_acctbal > 5000 or s_nationkey = 3) and not (s_acctbal > 9000)")
def filter_and_or_not(spark, sf):
    s = TableGraph(spark, sf).star("supplier", s_name="name", s_acctbal="balance", s_nationkey="n")
    return s.filter(((C("balance") > 5000) | (C("n") == 3)) & ~(C("balance") > 9000)).select("name").df


@query("select l_extendedprice as price, l_discount as discount from lineitem where l_extendedprice * (1 - l_discount) - l_tax * 100 > 90000 and l_quantity / 2 > 20")
def filter_arith(spark, sf):
    s = TableGraph(spark, sf).star("lineitem", l_extendedprice="price", l_discount="discount", l_tax="tax", l_quantity="quantity")
    return s.filter((C("price") * (1 - C("discount")) - C("tax") * 100 > 90000) & (fn.divide(C("quantity"), F.lit(2)) > 20)).select("price", "discount").df


@query("select p_name as name from part where regexp_matches(p_name, '^(red|blue).*(bolt|ring)$')")
def filter_regex(spark, sf):
    return TableGraph(spark, sf).star("part", p_name="name").filter(fn.regex(C("name"), "^(red|blue).*(bolt|ring)$")).df


@query("select c_name as name, c_mktsegment as segment from customer where regexp_matches(c_mktsegment, '^auto', 'i')")
def filter_regex_flags(spark, sf):
    return TableGraph(spark, sf).star("customer", c_name="name", c_mktsegment="segment").filter(fn.regex(C("segment"), "^auto", "i")).df


def _tagged(spark, sf) -> DataFrame:
    """Document ids and their text's language tag, through the text's literal key."""
    triples = TableGraph(spark, sf).triples("documents", "text").df
    number = F.regexp_extract("s", r"/(\d+)>$", 1).cast("long")
    return triples.select(number.alias("doc"), fn.lang(C("o")).alias("tag"))


@query("select doc_id as doc from documents where lang = 'de'")
def filter_lang(spark, sf):
    return _tagged(spark, sf).where(C("tag") == "de").select("doc")


@query("select doc_id as doc from documents where lang = 'fr' or lang like 'fr-%'")
def filter_langmatches_range(spark, sf):
    return _tagged(spark, sf).where(fn.lang_matches(C("tag"), "FR")).select("doc")


@query("select doc_id as doc, lang as tag from documents where lang <> ''")
def filter_langmatches_star(spark, sf):
    return _tagged(spark, sf).where(fn.lang_matches(C("tag"), "*"))


@query(f"select 'http://www.w3.org/2001/XMLSchema#double' as datatype, count(*) as n from customer union all select 'http://www.w3.org/2001/XMLSchema#string', 2 * count(*) from customer")
def filter_datatype(spark, sf):
    triples = TableGraph(spark, sf).triples("customer").filter(fn.is_literal(C("o"))).df
    return triples.groupBy(fn.datatype(C("o")).alias("datatype")).agg(F.count("*").alias("n"))


@query("select 2 * count(*) as iris, 3 * count(*) as literals, 0::bigint as blanks from customer")
def filter_isiri_isliteral(spark, sf):
    o = C("o")
    count = lambda test: F.sum(test.cast("long"))
    return TableGraph(spark, sf).triples("customer").df.agg(count(fn.is_iri(o)).alias("iris"), count(fn.is_literal(o)).alias("literals"), count(fn.is_blank(o)).alias("blanks"))


@query("select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey = b.n_nationkey")
def filter_sameterm(spark, sf):
    g = TableGraph(spark, sf)
    pairs = g.star("nation", "x", n_name="a", n_regionkey="r").join(g.star("nation", "y", n_name="b", n_regionkey="r"))
    return pairs.filter(fn.same_term(C("x"), C("y"))).select("a", "b").df


@query(f"select {_iri('nation', 'n_nationkey')} as iri from nation where n_nationkey < 10")
def filter_str_iri(spark, sf):
    keys = TableGraph(spark, sf).pattern("nation", "?n", RDF.type, EX.nation)
    return keys.filter(fn.regex(fn.lexical(C("n")), "/[0-9]$")).df.select(fn.lexical(C("n")).alias("iri"))


@query("select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey where a.n_nationkey <> b.n_nationkey")
def filter_theta_join(spark, sf):
    g = TableGraph(spark, sf)
    pairs = g.star("nation", "x", n_name="a", n_regionkey="r").join(g.star("nation", "y", n_name="b", n_regionkey="r"))
    return pairs.filter(C("x") != C("y")).select("a", "b").df


@query("select p_partkey as part, p_retailprice / (p_size - 10) as ratio from part where p_size <> 10")
def filter_division(spark, sf):
    parts = TableGraph(spark, sf).star("part", "part", p_retailprice="price", p_size="size").filter(C("size") != 10)
    return parts.df.select("part", fn.divide(C("price"), C("size") - 10).alias("ratio"))


@query("select c_custkey as c from customer where c_acctbal > 4000")
def filter_dynamic_terms(spark, sf):
    """The same numeric filter on term keys, compared by value."""
    found = TableGraph(spark, sf).pattern("customer", "?c", EX.c_acctbal, "?b").filter(fn.less(F.lit(literal("4000", datatype=XSD.integer)), C("b")))
    return found.df.select(F.regexp_extract("c", r"/(\d+)>$", 1).cast("long").alias("c"))


# Optional, union, nesting


@query("select d.doc_id as doc, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id")
def optional_left_join(spark, sf):
    g = TableGraph(spark, sf)
    return g.star("documents", "doc").optional(g.star("labels", "doc", quality="quality", toxic="toxic")).df


@query("select d.doc_id as doc, n_chars, quality from documents d left join labels l on d.doc_id = l.doc_id and d.n_chars > 1000 and quality = 0")
def optional_with_filter(spark, sf):
    g = TableGraph(spark, sf)
    inner = g.star("labels", "doc", quality="quality")
    return g.star("documents", "doc", n_chars="n_chars").optional(inner, C("n_chars") > 1000, C("quality") == 0).df


@query(
    "select c_custkey as c, x.o_orderkey as o, x.l_quantity as q from customer left join (select o_custkey, o_orderkey, l_quantity from orders left join lineitem on l_orderkey = o_orderkey and l_quantity > 49 "
    "where o_totalprice > 400000) x on o_custkey = c_custkey"
)
def optional_nested(spark, sf):
    g = TableGraph(spark, sf)
    orders = g.star("orders", "o", o_custkey="c", o_totalprice="t").filter(C("t") > 400000).select("o", "c")
    inner = orders.optional(g.star("lineitem", l_orderkey="o", l_quantity="q"), C("q") > 49)
    return g.star("customer", "c").optional(inner).df.select("c", "o", "q")


@query("select doc_id as doc from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def optional_not_bound(spark, sf):
    g = TableGraph(spark, sf)
    return g.star("documents", "doc").without(g.star("labels", "doc")).df


@query("select c_name as name from customer where c_acctbal < 0 union all select s_name from supplier where s_acctbal < 0")
def union_2(spark, sf):
    g = TableGraph(spark, sf)
    customers = g.star("customer", c_name="name", c_acctbal="b").filter(C("b") < 0).select("name")
    return customers.union(g.star("supplier", s_name="name", s_acctbal="b").filter(C("b") < 0).select("name")).df


@query("select r_name, null as n_name from region union all select null, n_name from nation")
def union_disjoint_vars(spark, sf):
    g = TableGraph(spark, sf)
    return g.star("region", r_name="r_name").union(g.star("nation", n_name="n_name")).df


@query(
    "with u as (select c_custkey as k, 'customer' as kind, c_nationkey as n from customer where c_acctbal > 9000 union all select s_suppkey, 'supplier', s_nationkey from supplier where s_acctbal > 5000) "
    "select kind, n_name as nation, count(*) as n from u join nation on n = n_nationkey group by all"
)
def union_then_join(spark, sf):
    g = TableGraph(spark, sf)
    sides = [
        g.star("customer", c_nationkey="n", c_acctbal="b").filter(C("b") > 9000).select("n", F.lit("customer").alias("kind")),
        g.star("supplier", s_nationkey="n", s_acctbal="b").filter(C("b") > 5000).select("n", F.lit("supplier").alias("kind")),
    ]
    found = sides[0].union(sides[1]).join(g.star("nation", "n", n_name="nation"))
    return found.aggregate(F.count("*").alias("n"), by=["kind", "nation"]).df


@query("select d.doc_id as doc, coalesce(l.quality, q) as quality from documents d left join labels l on d.doc_id = l.doc_id join (values (0), (1)) v(q) on l.quality = q or l.quality is null")
def join_on_maybe_unbound(spark, sf):
    """A variable that OPTIONAL may leave unbound joins as compatible mappings do."""
    g = TableGraph(spark, sf)
    values = Solutions(spark.createDataFrame([(0,), (1,)], "quality int"))
    return g.star("documents", "doc").optional(g.star("labels", "doc", quality="quality").select("doc", C("quality").cast("int").alias("quality"))).join(values).df


# Forms, modifiers


@query(f"select {_iri('nation', 'n_nationkey')} as n, n_name as name, {_iri('region', 'n_regionkey')} as r, r_name as region from nation join region on n_regionkey = r_regionkey")
def select_star(spark, sf):
    g = TableGraph(spark, sf)
    return g.star("nation", "n", n_name="name", n_regionkey="r").join(g.star("region", "r", r_name="region")).select_all().rendered().df


@query("select distinct o_orderpriority as priority, o_orderstatus as status from orders")
def select_distinct(spark, sf):
    return TableGraph(spark, sf).star("orders", o_orderpriority="priority", o_orderstatus="status").distinct().df


@query("select distinct p_brand as brand from part")
def select_reduced(spark, sf):
    return TableGraph(spark, sf).star("part", p_brand="brand").reduced().df


@query("select o_orderkey as o, o_totalprice as total from orders order by o_orderkey limit 20")
def order_limit(spark, sf):
    return TableGraph(spark, sf).star("orders", "o", o_totalprice="total").order_by(C("o")).slice(limit=20).df


@query("select c_custkey as c from customer order by c_custkey desc limit 10 offset 30")
def order_desc_offset(spark, sf):
    return TableGraph(spark, sf).star("customer", "c").order_by(C("c").desc_nulls_last()).slice(30, 10).df


@query("select l_orderkey as o, l_extendedprice as price from lineitem order by l_extendedprice desc, l_orderkey limit 1000 offset 40000")
def order_deep_offset(spark, sf):
    lines = TableGraph(spark, sf).star("lineitem", l_orderkey="o", l_extendedprice="price").select("o", "price")
    return lines.order_by(C("price").desc_nulls_last(), C("o")).slice(40_000, 1000).df


@query("select o_orderkey as o, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as position from orders")
def order_positions(spark, sf):
    orders = TableGraph(spark, sf).star("orders", "o", o_totalprice="total").df
    return ordered(orders, C("total").desc_nulls_last(), C("o")).numbered().select("o", "position")


@query("select o_orderkey as o, o_totalprice as total from orders order by o_totalprice desc, o_orderkey limit 10")
def topk_orders(spark, sf):
    return TableGraph(spark, sf).star("orders", "o", o_totalprice="total").order_by(C("total").desc(), C("o")).slice(limit=10).df


@query("select true as answer")
def ask_true(spark, sf):
    return TableGraph(spark, sf).star("nation", n_name="name").filter(C("name") == "NATION_3").ask()


@query("select false as answer")
def ask_false(spark, sf):
    return TableGraph(spark, sf).star("nation", n_name="name").filter(C("name") == "nowhere").ask()


@query(f"select '<{BASE}nation/' || n_nationkey || '>' as s, '<{BASE}within>' as p, '<{BASE}region/' || n_regionkey || '>' as o from nation")
def construct_edges(spark, sf):
    found = TableGraph(spark, sf).star("nation", "n", n_regionkey="r").rendered().df
    keys = Solutions(found.select(F.concat(F.lit("<"), "n", F.lit(">")).alias("n"), F.concat(F.lit("<"), "r", F.lit(">")).alias("r")))
    return keys.construct(("?n", EX.within, "?r"))


@query(
    f"""select '<{BASE}nation/7>' as s, '<{BASE}n_name>' as p, '"' || n_name || '"' as o from nation where n_nationkey = 7
    union all select '<{BASE}nation/7>', '<{BASE}n_regionkey>', '<{BASE}region/' || n_regionkey || '>' from nation where n_nationkey = 7
    union all select '<{BASE}nation/7>', '{RDF.type}', '<{BASE}nation>'"""
)
def describe_nation(spark, sf):
    g = TableGraph(spark, sf).materialize("nation", "region")
    return g.describe(spark.createDataFrame([(EX["nation/7"],)], "s string"))


@query(
    f"""select '<{BASE}n_name>' as p, '"' || n_name || '"' as o from nation union all select '<{BASE}n_regionkey>', '<{BASE}region/' || n_regionkey || '>' from nation
    union all select '{RDF.type}', '<{BASE}nation>' from nation"""
)
def var_predicate(spark, sf):
    return TableGraph(spark, sf).triples("nation").df.select("p", "o")


# Aggregates


@query("select count(*) as n from lineitem")
def agg_count_star(spark, sf):
    return TableGraph(spark, sf).star("lineitem", l_quantity="q").aggregate(F.count("*").alias("n")).df


@query("select count(distinct l_suppkey) as suppliers, count(distinct l_quantity) as quantities from lineitem")
def agg_count_distinct(spark, sf):
    s = TableGraph(spark, sf).star("lineitem", l_suppkey="s", l_quantity="q")
    return s.aggregate(F.countDistinct("s").alias("suppliers"), F.countDistinct("q").alias("quantities")).df


@query("select round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 2) as mean, min(o_totalprice) as least, max(o_totalprice) as most from orders")
def agg_sum_avg_min_max(spark, sf):
    t = C("t")
    s = TableGraph(spark, sf).star("orders", o_totalprice="t")
    return s.aggregate(F.round(F.sum(t), 2).alias("total"), F.round(F.avg(t), 2).alias("mean"), F.min(t).alias("least"), F.max(t).alias("most")).df


@query("select n_name as nation, count(*) as n from customer join nation on c_nationkey = n_nationkey group by n_name")
def agg_implicit_group(spark, sf):
    g = TableGraph(spark, sf)
    return g.star("customer", c_nationkey="n").join(g.star("nation", "n", n_name="nation")).aggregate(F.count("*").alias("n"), by=["nation"]).df


@query("select p_brand as brand, sum(distinct p_size)::bigint as sizes from part group by p_brand")
def agg_sum_distinct(spark, sf):
    return TableGraph(spark, sf).star("part", p_brand="brand", p_size="size").aggregate(F.sum_distinct("size").alias("sizes"), by=["brand"]).df


@query("select r_name as region, string_agg(n_name, ' ' order by n_name) as nations from nation join region on n_regionkey = r_regionkey group by r_name")
def agg_group_concat(spark, sf):
    g = TableGraph(spark, sf)
    s = g.star("nation", n_name="name", n_regionkey="r").join(g.star("region", "r", r_name="region"))
    return s.aggregate(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("nations"), by=["region"]).df


@query("select n_nationkey as n, n_name as name from nation")
def agg_sample(spark, sf):
    return TableGraph(spark, sf).star("nation", "n", n_name="name").aggregate(F.any_value("name").alias("name"), by=["n"]).df


@query("select c_nationkey as n, count(*) as customers from customer group by c_nationkey having count(*) > 50")
def agg_having(spark, sf):
    return TableGraph(spark, sf).star("customer", c_nationkey="n").aggregate(F.count("*").alias("customers"), by=["n"], having=C("customers") > 50).df


# Graphs of quads


@query("select n_name as nation, r_name as region from nation join region on n_regionkey = r_regionkey")
def quads_bgp(spark, sf):
    g = TableGraph(spark, sf).materialize("nation", "region")
    found = g.bgp(("?n", EX.n_name, "?a"), ("?r", EX.r_name, "?b"), ("?n", EX.n_regionkey, "?r"))
    return found.df.select(fn.lexical(C("a")).alias("nation"), fn.lexical(C("b")).alias("region"))


@query("select 'region' as g, count(*) * 2 as n from region union all select 'nation', count(*) * 3 from nation")
def graph_named(spark, sf):
    g = TableGraph(spark, sf).materialize("nation", "region", graphs=True)
    found = g.named().pattern("?s", "?p", "?o", graph="?g").df
    return found.groupBy(F.regexp_extract("g", "/([a-z]+)>$", 1).alias("g")).agg(F.count("*").alias("n"))


@query("select count(*) * 2 as n from region")
def from_default(spark, sf):
    g = TableGraph(spark, sf).materialize("nation", "region", graphs=True)
    return g.default(EX["graph/region"]).pattern("?s", "?p", "?o").aggregate(F.count("*").alias("n")).df


@query("select 'http://example.org/graph/nation' as g, n_name as name from nation")
def from_named_var(spark, sf):
    g = TableGraph(spark, sf).materialize("nation", "region", graphs=True).named(EX["graph/nation"], EX["graph/region"])
    return g.pattern("?s", EX.n_name, "?name", graph="?g").df.select(fn.lexical(C("g")).alias("g"), fn.lexical(C("name")).alias("name"))


@query("select count(*) as n from nation where n_regionkey = 1")
def bnode_pattern(spark, sf):
    g = TableGraph(spark, sf).materialize("nation")
    return g.bgp(("_:x", EX.n_regionkey, EX["region/1"]), ("_:x", RDF.type, EX.nation)).aggregate(F.count("*").alias("n")).df


@query(
    "select 'all' as case, count(*) * 3 as n from nation union all select 's', 3 union all select 'p', count(*) from nation union all select 'o', count(*) from nation where n_regionkey = 2 "
    "union all select 'sp', 1 union all select 'so', 1 union all select 'po', count(*) from nation where n_regionkey = 2 union all select 'spo', 1"
)
def quad_match_spo_cases(spark, sf):
    g = TableGraph(spark, sf).materialize("nation")
    s, p = EX["nation/3"], EX.n_regionkey
    row = g.get(s, p).df.select("o")
    count = lambda case, graph: graph.df.select(F.lit(case).alias("case")).groupBy("case").agg(F.count("*").alias("n"))
    o = EX["region/2"]
    found = count("all", g.get()).union(count("s", g.get(s))).union(count("p", g.get(None, p))).union(count("o", g.get(None, None, o)))
    own = Graph(g.df.join(row, "o", "left_semi").select("g", "s", "p", "o"))
    found = found.union(count("sp", g.get(s, p))).union(count("so", own.get(s))).union(count("po", g.get(None, p, o)))
    return found.union(count("spo", own.get(s, p)))


_EDGE = "select n_nationkey as s, n_regionkey as o from nation"


def _edges(spark, sf) -> tuple[Graph, Graph]:
    edges = TableGraph(spark, sf).materialize("nation").get(None, EX.n_regionkey)
    region = F.regexp_extract("o", r"/(\d+)>$", 1).cast("int")
    return edges.where(region <= 2), edges.where(region >= 2)


def _numbers(graph: Graph) -> DataFrame:
    number = lambda c: F.regexp_extract(c, r"/(\d+)>$", 1).cast("int").alias(c)
    return graph.df.select(number("s"), number("o"))


@query(_EDGE)
def graph_union(spark, sf):
    a, b = _edges(spark, sf)
    return _numbers(a | b)


@query(f"{_EDGE} where n_regionkey < 2")
def graph_difference(spark, sf):
    a, b = _edges(spark, sf)
    return _numbers(a - b)


@query(f"{_EDGE} where n_regionkey = 2")
def graph_intersect(spark, sf):
    a, b = _edges(spark, sf)
    return _numbers(a & b)


_CUSTOMERS = " union all ".join(
    f"select {_iri('customer', 'c_custkey')} as s, '{p}' as p, {o} as o from customer"
    for p, o in {
        "type": f"'{BASE}customer'",
        "c_name": "c_name",
        "c_nationkey": _iri("nation", "c_nationkey"),
        "c_acctbal": "cast(c_acctbal as varchar)",
        "c_mktsegment": "c_mktsegment",
    }.items()
)


@query(_CUSTOMERS)
def turtle_roundtrip(spark, sf):
    """The whole table's triples, written as Turtle and read again: each customer is a document of its own."""
    return _readable(_turtle_returned(TableGraph(spark, sf).materialize("customer")))


@query("select count(*) * 5 as n from customer")
def turtle_roundtrip_all(spark, sf):
    """How many triples come back as they were."""
    g = TableGraph(spark, sf).materialize("customer")
    return (_turtle_returned(g) & g).df.agg(F.count("*").alias("n"))


def _turtle_returned(g: Graph) -> Graph:
    text = turtle.blocks(g, {"": BASE}).select(F.col("s").alias("doc"), F.concat(F.lit(turtle.header({"": BASE})), "value").alias("text"))
    return Graph.from_triples(turtle.parse(text).select("s", "p", "o"))


def _readable(g: Graph) -> DataFrame:
    """Subjects and objects as texts, predicates by their local names; numbers without needless zeros."""
    value = F.when(C("p") == EX.c_acctbal, fn.numeric(C("o")).cast("string")).otherwise(fn.lexical(C("o")))
    return g.df.select(fn.lexical(C("s")).alias("s"), F.regexp_extract("p", r"[#/](\w+)>$", 1).alias("p"), value.alias("o"))


@query(_CUSTOMERS)
def rdfxml_roundtrip(spark, sf):
    """The whole table's triples, written as RDF/XML and read again: each customer is a document of its own."""
    return _readable(_rdfxml_returned(TableGraph(spark, sf).materialize("customer")))


@query("select count(*) * 5 as n from customer")
def rdfxml_roundtrip_all(spark, sf):
    """How many triples come back as they were."""
    g = TableGraph(spark, sf).materialize("customer")
    return (_rdfxml_returned(g) & g).df.agg(F.count("*").alias("n"))


def _rdfxml_returned(g: Graph) -> Graph:
    text = rdfxml.blocks(g).select(F.col("s").alias("doc"), F.concat(F.lit(rdfxml.HEADER), "value", F.lit(rdfxml.FOOTER)).alias("text"))
    return Graph.from_triples(rdfxml.parse(text).select("s", "p", "o"))


@query("select distinct conv_id as conv, turn, text from conversations")
def list_read(spark, sf):
    """Conversations as RDF lists of their turns, built and read back."""
    turns = TableGraph(spark, sf).table("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("turn", "text"))).alias("t"))
    keyed = turns.select(F.concat(F.lit("_:l"), C("conv_id").cast("string")).alias("node"), F.transform("t", lambda x: literal_column(x["text"])).alias("items"))
    g = Graph.from_triples(collections.build_lists(keyed))
    read = collections.read_lists(g, keyed.select("node"))
    return read.select(F.regexp_extract("node", r"(\d+)$", 1).cast("long").alias("conv"), F.posexplode("items").alias("turn", "key")).select("conv", C("turn").cast("long").alias("turn"), fn.lexical(C("key")).alias("text"))


@query("select vec_id as vec, len(embedding) as n from embeddings")
def container_read(spark, sf):
    """Embeddings as RDF containers, built and read back."""
    vectors = TableGraph(spark, sf).table("embeddings")
    rows = vectors.select(F.concat(F.lit("_:v"), C("vec_id").cast("string")).alias("node"), F.transform("embedding", lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('"'))).alias("items"))
    read = collections.read_containers(Graph.from_triples(collections.build_containers(rows)))
    return read.select(F.substr("node", F.lit(4)).cast("long").alias("vec"), F.size("items").cast("long").alias("n"))


@query("select count(*) as n from nation where n_regionkey in (0, 1)")
def collection_pattern(spark, sf):
    """A collection in a pattern: nations whose list is (its region, its name)."""
    base = TableGraph(spark, sf).materialize("nation")
    lists = base.bgp(("?n", EX.n_regionkey, "?r"), ("?n", EX.n_name, "?m")).filter(C("r").isin(EX["region/0"], EX["region/1"])).df
    made = owl.make_list_axioms(lists.select(C("n").alias("s"), F.array("r", "m").alias("items")), EX.pair)
    g = base | Graph.from_triples(made)
    return g.bgp(("?n", EX.pair, "_:h"), *g.list_pattern("_:h", ["?r", "?m"]), ("?n", EX.n_regionkey, "?r")).aggregate(F.count("*").alias("n")).df


# Joins on ranges, cyclic patterns


@query("select a.o_orderkey as o, b.o_orderkey as near, a.o_totalprice as price, b.o_totalprice as near_price from orders a join orders b on b.o_totalprice >= a.o_totalprice - 1 and b.o_totalprice <= a.o_totalprice + 1 and a.o_orderkey < b.o_orderkey")
def filter_band_join(spark, sf):
    """Pairs of orders whose prices differ by at most one."""
    g = TableGraph(spark, sf)
    found = g.star("orders", "o", o_totalprice="price").within(g.star("orders", "near", o_totalprice="near_price"), "price", "near_price", 1.0, 1.0)
    return found.filter(C("o") < C("near")).select("o", "near", "price", "near_price").df


@query(
    "select p, s, o from (select distinct l_partkey as p, l_suppkey as s from lineitem where l_quantity > 10) join (select distinct l_suppkey as s, l_orderkey as o from lineitem) using (s) "
    "join (select distinct l_orderkey as o, l_partkey as p from lineitem where l_discount < 0.05) using (o, p)"
)
def bgp_triangle(spark, sf):
    """Parts, suppliers and orders that are tied two by two, by three lines that need not be the same."""
    g = TableGraph(spark, sf)
    ps = g.star("lineitem", l_partkey="p", l_suppkey="s", l_quantity="q").filter(C("q") > 10).select("p", "s")
    so = g.star("lineitem", l_suppkey="s", l_orderkey="o").select("s", "o")
    op = g.star("lineitem", l_orderkey="o", l_partkey="p", l_discount="d").filter(C("d") < 0.05).select("o", "p")
    return ps.triangle(so, op).select("p", "s", "o").df


# Functions by IRI

registry.register_function(f"{BASE}fn/discounted", lambda price, discount: price * (1 - discount))


@query("select l_orderkey as o, l_extendedprice * (1 - l_discount) as net from lineitem where l_quantity > 45")
def udf_call(spark, sf):
    s = TableGraph(spark, sf).star("lineitem", l_orderkey="o", l_extendedprice="price", l_discount="discount", l_quantity="q").filter(C("q") > 45)
    return s.df.select("o", registry.call(EX["fn/discounted"], C("price"), C("discount")).alias("net"))


@query("select o_orderkey as o, cast(o_orderkey as varchar) as text from orders")
def cast_call(spark, sf):
    s = TableGraph(spark, sf).star("orders", "o")
    return s.df.select("o", registry.call(XSD.string, C("o")).alias("text"))


@query("select p_partkey as part, p_size::decimal(38,0) as whole, cast(p_retailprice as float) as single, p_size > 0 as flag from part")
def cast_call_all(spark, sf):
    """Casts to other types, from the lexical forms of literals."""
    s = TableGraph(spark, sf).star("part", "part", p_size="size", p_retailprice="price")
    text = lambda c: C(c).cast("string")
    flag = registry.call(XSD.boolean, F.when(C("size") > 0, "true").otherwise("false"))
    return s.df.select("part", registry.call(XSD.integer, text("size")).alias("whole"), registry.call(XSD.float, text("price")).alias("single"), flag.alias("flag"))


from quadrille import queries_graph, queries_owl  # noqa: E402, F401  further queries register themselves

"""Queries on ontologies made from the driver's tables: regions and nations as classes, customers as individuals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import terms as fn
from quadrille.operators import owl
from quadrille.operators.quads import Graph
from quadrille.plans.mapping import BASE, TableGraph
from quadrille.register import EX, number, query, resource
from quadrille.terms import OWL, RDF, RDFS, XSD, literal, literal_column

C = F.col


def _said(df: DataFrame, s: Column, p: str, o: Column | str) -> DataFrame:
    return df.select(s.alias("s"), F.lit(p).alias("p"), (F.lit(o) if isinstance(o, str) else o).alias("o"))


def _graph(*triples: DataFrame) -> Graph:
    return Graph.from_triples(reduce(DataFrame.union, triples))


def _key(table: str, column: str, plus: int = 0) -> Column:
    return resource(table, C(column) + plus)


def _nation() -> Column:
    return _key("nation", "n_nationkey")


def _customer() -> Column:
    return _key("customer", "c_custkey")


def _geography(spark, sf) -> Graph:
    """Classes of regions and nations, customers as individuals with a segment and a neighbour, an ontology with a label."""
    t = TableGraph(spark, sf).table
    region, nation, customer = t("region"), t("nation"), t("customer")
    one = spark.range(1)
    return _graph(
        _said(region, _key("region", "r_regionkey"), RDF.type, OWL.Class),
        _said(nation, _nation(), RDF.type, OWL.Class),
        _said(nation, _nation(), RDFS.subClassOf, _key("region", "n_regionkey")),
        _said(nation, _nation(), RDFS.label, literal_column(C("n_name"))),
        _said(customer, _customer(), RDF.type, _key("nation", "c_nationkey")),
        _said(customer, _customer(), EX.segment, literal_column(C("c_mktsegment"))),
        _said(customer, _customer(), EX.follows, _key("customer", "c_custkey", 1)),
        _said(customer, _customer(), EX.remark, literal_column(C("c_name"))),
        _said(one, F.lit(EX.segment), RDF.type, OWL.DatatypeProperty),
        _said(one, F.lit(EX.follows), RDF.type, OWL.ObjectProperty),
        _said(one, F.lit(EX.remark), RDF.type, OWL.AnnotationProperty),
        _said(one, F.lit(EX.geography), RDF.type, OWL.Ontology),
        _said(one, F.lit(EX.geography), RDFS.label, literal("geography")),
        _said(one, F.lit(EX.geography), OWL.versionIRI, EX["geography/1"]),
    )


# Entities and ontologies


@query("select n_nationkey::bigint as n, 3::bigint as n_triples from nation")
def owl_frames(spark, sf):
    """All that is said about each nation."""
    g = _geography(spark, sf)
    nations = TableGraph(spark, sf).table("nation").select(_nation())
    return owl.frame(g, nations).groupBy(number("s", "n")).agg(F.count("*").alias("n_triples"))


@query("select c_custkey as c, c_name as note from customer")
def owl_annotations(spark, sf):
    """Annotations of individuals, with a property that the ontology declares."""
    g = _geography(spark, sf)
    customers = TableGraph(spark, sf).table("customer").select(_customer())
    return owl.annotations(g, customers).select(number("s", "c"), fn.lexical(C("o")).alias("note"))


@query("select 'remark' as p, true as own union all select unnest(['comment', 'isDefinedBy', 'label', 'seeAlso', 'deprecated', 'versionIRI', 'priorVersion', 'backwardCompatibleWith', 'incompatibleWith', 'versionInfo']), false")
def owl_annotation_properties(spark, sf):
    found = owl.annotation_properties(_geography(spark, sf))
    return found.select(F.regexp_extract("s", r"[#/](\w+)>$", 1).alias("p"), F.startswith("s", F.lit(f"<{BASE}")).alias("own"))


@query("select 'label' as p, 'geography' as o union all select 'versionIRI', 'http://example.org/geography/1'")
def owl_ontology_annotations(spark, sf):
    g = _geography(spark, sf)
    return owl.annotations(g, owl.ontologies(g)).select(F.regexp_extract("p", r"#(\w+)>$", 1).alias("p"), fn.lexical(C("o")).alias("o"))


@query(
    "select 'Class' as kind, (select count(*) from nation) + (select count(*) from region) as n union all select 'ObjectProperty', 1 union all select 'DatatypeProperty', 1 union all select 'AnnotationProperty', 1 "
    "union all select 'Individual', count(*) from customer"
)
def owl_entities(spark, sf):
    """The ontology as a set of entities, and its subsets by kind."""
    return owl.entities(_geography(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "select 'before' as step, count(*) as n from customer where c_nationkey = 4 union all select 'removed', 0 union all select 'added', count(*) from customer where c_nationkey = 4 union all select 'others', count(*) from customer where c_nationkey <> 4"
)
def owl_entity_set(spark, sf):
    """Entities taken out of an ontology and put back, and whether it has them."""
    g, customer = _geography(spark, sf), TableGraph(spark, sf).table("customer")
    some, others = (customer.where(f"c_nationkey {op} 4").select(_customer().alias("s")) for op in ("=", "<>"))
    less = owl.remove_entities(g, some)
    more = owl.add_entities(less, owl.frame(g, some))
    count = lambda step, graph, of: owl.contains(graph, of).agg(F.lit(step).alias("step"), F.sum(C("there").cast("long")).alias("n"))
    return reduce(DataFrame.union, [count("before", g, some), count("removed", less, some), count("added", more, some), count("others", less, others)])


# Classes


@query("select n_regionkey as s, n_nationkey::bigint as o from nation")
def owl_sub_classes(spark, sf):
    return owl.sub_classes(_geography(spark, sf)).select(number("s").cast("int").alias("s"), number("o"))


def _pairs(spark, sf, condition: str) -> DataFrame:
    """Pairs of nations (s, o)."""
    nation = TableGraph(spark, sf).table("nation")
    a = nation.select(C("n_nationkey").alias("a"), C("n_regionkey").alias("ra"))
    b = nation.select(C("n_nationkey").alias("b"), C("n_regionkey").alias("rb"))
    return a.join(b, F.expr(condition)).select(resource("nation", C("a")).alias("s"), resource("nation", C("b")).alias("o"))


_PAIRS = "select a.n_nationkey::bigint as s, b.n_nationkey::bigint as o, '{0}' as axiom from nation a join nation b on {1}"


@query(
    " union all ".join(
        [
            _PAIRS.format("equivalent", "a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey"),
            _PAIRS.format("disjoint", "a.n_regionkey = b.n_regionkey and a.n_nationkey > b.n_nationkey"),
            _PAIRS.format("complement", "b.n_nationkey = a.n_nationkey + 1"),
            _PAIRS.format("super", "b.n_nationkey = a.n_nationkey + 2"),
        ]
    )
)
def owl_class_axioms(spark, sf):
    """Class axioms made from pairs and read back."""
    made = [
        owl.make_axioms(_pairs(spark, sf, "ra = rb and a < b"), OWL.equivalentClass),
        owl.make_axioms(_pairs(spark, sf, "ra = rb and a > b"), OWL.disjointWith),
        owl.make_axioms(_pairs(spark, sf, "b = a + 1"), OWL.complementOf),
        owl.make_axioms(_pairs(spark, sf, "b = a + 2"), RDFS.subClassOf),
    ]
    g = _graph(*made)
    readers = {"equivalent": owl.equivalent_classes, "disjoint": owl.disjoint_classes, "complement": owl.complements, "super": owl.super_classes}
    return reduce(DataFrame.union, [read(g).select(number("s"), number("o"), F.lit(name).alias("axiom")) for name, read in readers.items()])


@query("select n_nationkey::bigint as n from nation where n_nationkey % 2 = 0 or n_nationkey % 3 = 0")
def owl_deprecated(spark, sf):
    """Entities deprecated by a statement or by their type; a false statement does not deprecate."""
    nation = TableGraph(spark, sf).table("nation")
    said = _said(nation, _nation(), OWL.deprecated, literal_column(C("n_nationkey") % 2 == 0, datatype=XSD.boolean))
    typed = _said(nation.where("n_nationkey % 3 = 0"), _nation(), RDF.type, OWL.DeprecatedClass)
    return owl.deprecated(_graph(said, typed)).select(number("s", "n"))


def _lists(spark, sf) -> DataFrame:
    """(s, items): each region with its nations in order."""
    nation = TableGraph(spark, sf).table("nation")
    listed = nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("n"))
    return listed.select(_key("region", "n_regionkey").alias("s"), F.transform("n", lambda x: resource("nation", x)).alias("items"))


def _listed(read: DataFrame) -> DataFrame:
    return read.select(number("s"), F.posexplode("items").alias("pos", "item")).select("s", C("pos").cast("long").alias("pos"), number("item"))


_IN_ORDER = "select n_regionkey::bigint as s, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as pos, n_nationkey::bigint as item from nation"


@query(_IN_ORDER)
def owl_intersections(spark, sf):
    return _listed(owl.intersections(_graph(owl.make_class(_lists(spark, sf), OWL.intersectionOf))))


@query(_IN_ORDER)
def owl_unions(spark, sf):
    return _listed(owl.unions(_graph(owl.make_class(_lists(spark, sf), OWL.unionOf))))


@query(_IN_ORDER)
def owl_disjoint_unions(spark, sf):
    return _listed(owl.disjoint_unions(_graph(owl.make_list_axioms(_lists(spark, sf), OWL.disjointUnionOf))))


@query("select c_nationkey::bigint as s, row_number() over (partition by c_nationkey order by c_custkey) - 1 as pos, c_custkey as item from customer")
def owl_enumerations(spark, sf):
    """Classes that list their individuals: every customer of each nation."""
    listed = TableGraph(spark, sf).table("customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_custkey")).alias("c"))
    lists = listed.select(_key("nation", "c_nationkey").alias("s"), F.transform("c", lambda x: resource("customer", x)).alias("items"))
    return _listed(owl.enumerations(_graph(owl.make_class(lists, OWL.oneOf))))


@query("select r_regionkey::bigint as s, kind from region cross join (values ('Intersection'), ('Union'), ('OneOf'), ('Complement'), ('Class'), ('Restriction')) v(kind)")
def owl_class_kinds(spark, sf):
    """Classes recognised by how they are built; each region stands for one of every kind."""
    regions = TableGraph(spark, sf).table("region").select("r_regionkey", F.explode(F.array(*map(F.lit, ["Intersection", "Union", "OneOf", "Complement", "Class", "Restriction"]))).alias("kind"))
    s = F.concat(F.lit(f"<{BASE}"), "kind", F.lit("/"), C("r_regionkey").cast("string"), F.lit(">"))
    built = {"Intersection": OWL.intersectionOf, "Union": OWL.unionOf, "OneOf": OWL.oneOf, "Complement": OWL.complementOf}
    by_list = [_said(regions.where(C("kind") == k), s, p, RDF.nil) for k, p in built.items()]
    by_type = [_said(regions.where(C("kind") == k), s, RDF.type, OWL[k]) for k in ("Class", "Restriction")]
    found = owl.classes(_graph(*by_list, *by_type)).where(F.startswith("s", F.lit(f"<{BASE}")))
    return found.select(number("s"), "kind")


# Properties


def _properties(spark, sf, table: str, key: str, type_: str, value: str) -> Graph:
    """Properties made from a table's rows, with an axiom of every sort: to the next row, the one after it, and so on."""
    rows = TableGraph(spark, sf).table(table).select(C(key).cast("long").alias("k"))
    s = resource(f"{table}-property", C("k"))
    to = lambda plus: resource(f"{table}-property", C("k") + plus)
    domain = resource("domain", C("k"))
    parts = [(RDF.type, F.lit(type_)), (OWL.equivalentProperty, to(1)), (OWL.propertyDisjointWith, to(2)), (OWL.inverseOf, to(3)), (RDFS.subPropertyOf, to(4)), (RDFS.domain, domain), (RDFS.range, F.lit(value))]
    return _graph(*[_said(rows, s, p, o) for p, o in parts])


def _axioms(g: Graph, kind: str) -> DataFrame:
    found = [owl.property_axioms(g, axiom, kind).select(number("s"), "o", F.lit(axiom).alias("axiom")) for axiom in owl.PROPERTY_AXIOMS]
    value = F.coalesce(F.regexp_extract("o", r"/(\d+)>$", 1).try_cast("long"), F.lit(-1))
    return reduce(DataFrame.union, found).select("s", value.alias("o"), "axiom")


def _axioms_sql(table: str, key: str) -> str:
    plus = {"equivalent": 1, "disjoint": 2, "inverse": 3, "super": 4, "domain": 0}
    return " union all ".join([f"select {key}::bigint as s, {key}::bigint + {n} as o, '{a}' as axiom from {table}" for a, n in plus.items()] + [f"select {key}, -1, 'range' from {table}"])


@query(_axioms_sql("nation", "n_nationkey"))
def owl_object_property_axioms(spark, sf):
    return _axioms(_properties(spark, sf, "nation", "n_nationkey", OWL.ObjectProperty, EX.Place), "Object")


@query(_axioms_sql("supplier", "s_suppkey"))
def owl_datatype_property_axioms(spark, sf):
    return _axioms(_properties(spark, sf, "supplier", "s_suppkey", OWL.DatatypeProperty, XSD.int), "Datatype")


@query(_axioms_sql("customer", "c_custkey"))
def owl_annotation_property_axioms(spark, sf):
    return _axioms(_properties(spark, sf, "customer", "c_custkey", OWL.AnnotationProperty, XSD.string), "Annotation")


@query("select n_nationkey::bigint as s, pos, (n_nationkey + pos)::bigint as item from nation cross join (values (0::bigint), (1)) v(pos)")
def owl_property_chains(spark, sf):
    chains = TableGraph(spark, sf).table("nation").select(_nation().alias("s"), F.array(_nation(), _key("nation", "n_nationkey", 1)).alias("items"))
    return _listed(owl.property_chains(_graph(owl.make_list_axioms(chains, OWL.propertyChainAxiom))))


@query("select distinct p_brand as datatype, 41::bigint as known from part")
def owl_datatypes(spark, sf):
    """Datatypes that a graph declares, beside those that every graph knows (and rdfs:Literal, rdf:XMLLiteral)."""
    brands = TableGraph(spark, sf).table("part").select(F.translate("p_brand", "#", "").alias("b")).distinct()
    found = owl.datatypes(_graph(_said(brands, F.concat(F.lit(f"<{BASE}"), "b", F.lit(">")), RDF.type, RDFS.Datatype)))
    known = found.where(F.startswith("s", F.lit(f"<{XSD.base}"))).agg(F.count("*").alias("known"))
    own = found.where(F.startswith("s", F.lit(f"<{BASE}"))).select(F.regexp_replace(F.regexp_extract("s", r"/(\w+)>$", 1), "Brand", "Brand#").alias("datatype"))
    return own.crossJoin(known)


# Individuals


@query(
    "select c_custkey as s, c_nationkey::bigint as o, 'type' as axiom from customer union all select a.c_custkey, b.c_custkey, 'same' from customer a join customer b on b.c_custkey = a.c_custkey + 1 and a.c_nationkey = b.c_nationkey "
    "union all select a.c_custkey, b.c_custkey, 'different' from customer a join customer b on b.c_custkey = a.c_custkey + 1 and a.c_nationkey <> b.c_nationkey"
)
def owl_individual_axioms(spark, sf):
    """Types, sameAs and differentFrom of all customers."""
    customer = TableGraph(spark, sf).table("customer")
    a, b = (customer.select(C("c_custkey").alias(f"{x}k"), C("c_nationkey").alias(f"{x}n")) for x in "ab")
    pairs = a.join(b, C("bk") == C("ak") + 1).select(resource("customer", C("ak")).alias("s"), resource("customer", C("bk")).alias("o"), (C("an") == C("bn")).alias("same"))
    made = [owl.make_axioms(pairs.where("same"), OWL.sameAs), owl.make_axioms(pairs.where("not same"), OWL.differentFrom)]
    g = _geography(spark, sf) | _graph(*made)
    readers = {"type": owl.types, "same": owl.same_as, "different": owl.different_from}
    return reduce(DataFrame.union, [read(g).select(number("s"), number("o"), F.lit(name).alias("axiom")) for name, read in readers.items()])


@query("select c_custkey as s, 'segment' as p, c_mktsegment as o from customer union all select c_custkey, 'follows', 'http://example.org/customer/' || (c_custkey + 1) from customer")
def owl_customer_facts(spark, sf):
    return owl.facts(_geography(spark, sf)).select(number("s"), F.regexp_extract("p", r"/(\w+)>$", 1).alias("p"), fn.lexical(C("o")).alias("o"))


@query("select c_custkey as s, 'segment' as p, c_mktsegment as o from customer where c_acctbal < 0 union all select c_custkey, 'follows', 'http://example.org/customer/' || (c_custkey + 2) from customer where c_acctbal < 0")
def owl_customer_negative_facts(spark, sf):
    poor = TableGraph(spark, sf).table("customer").where("c_acctbal < 0")
    facts = _said(poor, _customer(), EX.segment, literal_column(C("c_mktsegment"))).union(_said(poor, _customer(), EX.follows, _key("customer", "c_custkey", 2)))
    return owl.negative_facts(_graph(owl.make_negative_facts(facts))).select(number("s"), F.regexp_extract("p", r"/(\w+)>$", 1).alias("p"), fn.lexical(C("o")).alias("o"))


@query("select n_regionkey::bigint as s, kind, n_nationkey::bigint as item from nation cross join (values ('AllDisjointClasses'), ('AllDisjointProperties'), ('AllDifferent')) v(kind)")
def owl_groups(spark, sf):
    lists = _lists(spark, sf)
    groups = [owl.make_group(lists.select(F.concat("s", F.lit(f"#{kind}")).alias("s"), "items"), kind) for kind in ("AllDisjointClasses", "AllDisjointProperties", "AllDifferent")]
    found = owl.disjoint_groups(_graph(*groups))
    return found.select(F.regexp_extract("s", r"/(\d+)>", 1).cast("long").alias("s"), "kind", F.explode("items").alias("item")).select("s", "kind", number("item"))


# Restrictions

_CARDINALITIES = [f"{q}{c}" for q in ("", "Qualified") for c in ("ExactCardinality", "MinCardinality", "MaxCardinality")]
_VALUES = ["SomeValuesFrom", "AllValuesFrom", "HasValue"]
_KINDS = [f"{side}{k}" for side in ("Object", "Data") for k in [*_CARDINALITIES, *_VALUES]] + ["NAryDataSomeValuesFrom", "NAryDataAllValuesFrom"]


@query(
    "select n_nationkey::bigint as r, kind, case when kind like 'NAry%' then null when kind like 'Data%' then 'segment' else 'follows' end as property, case when kind like 'NAry%' then 2::bigint end as n_properties, "
    "case when kind like '%Cardinality' then n_nationkey end as n, case when kind like '%Cardinality' and kind not like '%Qualified%' then null when kind = 'DataHasValue' then n_name "
    "when kind like '%Data%' then 'http://www.w3.org/2001/XMLSchema#int' else 'http://example.org/nation/' || n_nationkey end as filler from nation "
    f"cross join (values {', '.join(f"('{k}')" for k in _KINDS)}) v(kind)"
)
def owl_restriction_kinds(spark, sf):
    """Restrictions of all 20 kinds for every nation, made and read back."""
    rows = TableGraph(spark, sf).table("nation").select("n_nationkey", "n_name", F.explode(F.array(*map(F.lit, _KINDS))).alias("kind"))
    kind = C("kind")
    n_ary, data, counted = F.startswith(kind, F.lit("NAry")), F.contains(kind, F.lit("Data")), F.endswith(kind, F.lit("Cardinality"))
    filler = F.when(kind == "DataHasValue", literal_column(C("n_name"))).when(data, F.lit(XSD.int)).otherwise(_nation())
    made = rows.select(
        F.concat(F.lit(f"<{BASE}"), kind, F.lit("/"), C("n_nationkey").cast("string"), F.lit(">")).alias("s"),
        "kind",
        F.when(n_ary, None).when(data, F.lit(EX.segment)).otherwise(F.lit(EX.follows)).alias("property"),
        F.when(n_ary, F.array(F.lit(EX.segment), F.lit(EX.age))).alias("properties"),
        F.when(counted, C("n_nationkey")).alias("n"),
        F.when(~counted | F.contains(kind, F.lit("Qualified")), filler).alias("filler"),
    )
    g = _geography(spark, sf) | Graph.from_triples(owl.make_restrictions(made))
    local = F.regexp_extract("property", r"/(\w+)>$", 1).alias("property")
    return owl.restrictions(g).select(number("s", "r"), "kind", local, F.when(C("properties").isNotNull(), F.size("properties")).cast("long").alias("n_properties"), "n", fn.lexical(C("filler")).alias("filler"))


@query("select n_nationkey::bigint as r, 'follows' as property, n_regionkey::bigint as filler from nation union all select n_nationkey, 'segment', -1 from nation")
def owl_some_values(spark, sf):
    """Existential restrictions of either kind."""
    nation = TableGraph(spark, sf).table("nation")
    made = [_said(nation, s, p, o) for s, prop, value in (
        (resource("o", C("n_nationkey")), EX.follows, _key("region", "n_regionkey")), (resource("d", C("n_nationkey")), EX.segment, F.lit(XSD.string))
    ) for p, o in ((RDF.type, OWL.Restriction), (OWL.onProperty, prop), (OWL.someValuesFrom, value))]
    found = owl.some_values(_geography(spark, sf) | _graph(*made))
    filler = F.coalesce(F.regexp_extract("filler", r"/(\d+)>$", 1).try_cast("long"), F.lit(-1)).alias("filler")
    return found.select(number("s", "r"), F.regexp_extract("property", r"/(\w+)>$", 1).alias("property"), filler)


# Property kinds from tables


@query(
    "select c_custkey as c, case c_custkey % 7 when 0 then 'Functional' when 1 then 'InverseFunctional' when 2 then 'Transitive' when 3 then 'Symmetric' when 4 then 'Asymmetric' when 5 then 'Reflexive' else 'Irreflexive' end as characteristic from customer"
)
def owl_characteristics(spark, sf):
    """A property for each customer, each with one of the seven characteristics."""
    customer = TableGraph(spark, sf).table("customer")
    kinds = ["Functional", "InverseFunctional", "Transitive", "Symmetric", "Asymmetric", "Reflexive", "Irreflexive"]
    named = {name: key for key, name in owl.CHARACTERISTICS.items()}
    kind = F.element_at(F.array(*[F.lit(named[k]) for k in kinds]), (C("c_custkey") % 7 + 1).cast("int"))
    g = _graph(_said(customer, _customer(), RDF.type, kind), _said(customer, _customer(), RDF.type, OWL.ObjectProperty))
    return owl.characteristics(g).select(number("s", "c"), "characteristic")


@query("select c_custkey as c, case when c_custkey % 3 = 0 then 'Datatype' else 'Object' end as kind from customer where c_custkey % 3 < 2")
def owl_properties(spark, sf):
    """A plain rdf:Property for each customer, whose range tells its kind: a datatype, a nation's class, or nothing known."""
    t = TableGraph(spark, sf).table
    customer, nation = t("customer"), t("nation")
    of = F.when(C("c_custkey") % 3 == 0, F.lit(XSD["int"])).when(C("c_custkey") % 3 == 1, _key("nation", "c_nationkey")).otherwise(F.lit(EX.unknown))
    g = _graph(_said(customer, _customer(), RDF.type, RDF.Property), _said(customer, _customer(), RDFS.range, of), _said(nation, _nation(), RDF.type, OWL.Class))
    found = owl.properties(g).where(F.startswith("s", F.lit(f"<{BASE}customer/")))
    return found.select(number("s", "c"), "kind")


# Closures

_PLACES = """e(a, b) as (select 'customer/' || c_custkey, 'nation/' || c_nationkey from customer union all select 'nation/' || n_nationkey, 'region/' || n_regionkey from nation
    union all select 'region/' || r_regionkey, 'region/' || ((r_regionkey + 1) % 3) from region where r_regionkey < 3 union all select 'region/' || r_regionkey, 'place/0' from region)"""


def _local(column: str) -> Column:
    return F.regexp_extract(column, r"([a-z]+/\d+)>$", 1).alias(column)


@query(f"with recursive {_PLACES}, c(a, b) as (select a, b from e union select c.a, e.b from c join e on c.b = e.a) select a as s, b as o from c")
def owl_class_ancestors(spark, sf):
    """All classes above each customer's, nation's and region's class; three regions are above each other in a ring."""
    t = TableGraph(spark, sf).table
    customer, nation, region = t("customer"), t("nation"), t("region")
    above = RDFS.subClassOf
    g = _graph(
        _said(customer, _customer(), above, _key("nation", "c_nationkey")),
        _said(nation, _nation(), above, _key("region", "n_regionkey")),
        _said(region.where("r_regionkey < 3"), _key("region", "r_regionkey"), above, resource("region", (C("r_regionkey") + 1) % 3)),
        _said(region, _key("region", "r_regionkey"), above, EX["place/0"]),
    )
    return owl.class_ancestors(g).select(_local("s"), _local("o"))


@query(
    "with recursive e(a, b) as (select c_custkey, c_custkey + 1 from customer where c_custkey % 7 <> 0 union all select c_custkey + 1, c_custkey from customer where c_custkey % 7 <> 0), "
    "r(a, b) as (select a, a from e union select b, b from e union select r.a, e.b from r join e on r.b = e.a), m as (select a, min('<http://example.org/customer/' || b || '>') as same from r group by a) "
    "select distinct regexp_extract(coalesce(m.same, '<http://example.org/customer/' || c_custkey || '>'), '(\\d+)>', 1)::bigint as c, c_nationkey as nation from customer left join m on a = c_custkey"
)
def owl_merged(spark, sf):
    """Chains of customers that are the same, merged: the nations of each chain under its representative."""
    customer = TableGraph(spark, sf).table("customer")
    g = _graph(
        _said(customer.where("c_custkey % 7 <> 0"), _customer(), OWL.sameAs, _key("customer", "c_custkey", 1)),
        _said(customer, _customer(), EX.lives, _key("nation", "c_nationkey")),
    )
    return owl.merged(g).df.select(number("s", "c"), number("o", "nation"))

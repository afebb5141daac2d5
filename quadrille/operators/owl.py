"""OWL and RDFS views of a graph, as DataFrames: who is a class, property, individual or datatype, and their axioms.

The views are syntactic: they say what the triples say and infer nothing. Every function takes the Graph and returns all
entities at once, one row each or one row per fact, so that a join replaces a loop over entities. Functions named make_*
return the triples (s, p, o) that state an axiom.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.terms import is_iri, is_literal
from quadrille.operators.collections import build_lists, read_lists
from quadrille.operators.components import closure, connected
from quadrille.operators.quads import COLUMNS, Graph
from quadrille.storage import checkpointed
from quadrille.terms import DATATYPES, OWL, RDF, RDFS

#: The predefined annotation properties, and the characteristics of object properties.
ANNOTATIONS = [RDFS.label, RDFS.comment, RDFS.seeAlso, RDFS.isDefinedBy, *(OWL[n] for n in "deprecated versionInfo versionIRI priorVersion backwardCompatibleWith incompatibleWith".split())]
CHARACTERISTICS = {
    OWL[f"{n}Property"]: n for n in "Functional InverseFunctional Reflexive Irreflexive Symmetric Asymmetric Transitive".split()
}
PREDEFINED_CLASSES = [OWL.Thing, OWL.Nothing]
PREDEFINED_PROPERTIES = [OWL.topObjectProperty, OWL.bottomObjectProperty, OWL.topDataProperty, OWL.bottomDataProperty]


def _objects(graph: Graph, p: str | Sequence[str], s: str = "s", o: str = "o") -> DataFrame:
    names = [p] if isinstance(p, str) else list(p)
    return graph.df.where(F.col("p").isin(names)).select(F.col("s").alias(s), F.col("o").alias(o)).distinct()


def _typed(graph: Graph, *types: str) -> DataFrame:
    return graph.df.where((F.col("p") == RDF.type) & F.col("o").isin(list(types))).select("s").distinct()


def _constants(graph: Graph, keys: Sequence[str]) -> DataFrame:
    return graph.df.sparkSession.createDataFrame([(k,) for k in keys], "s string")


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts).distinct()


def axioms(graph: Graph, p: str | Sequence[str], of: DataFrame | None = None) -> DataFrame:
    """(s, o): what the subjects of `of` (any, if None) state with these predicates."""
    found = _objects(graph, p)
    return found if of is None else found.join(of.toDF("s"), "s", "left_semi")


def lists_of(graph: Graph, p: str, of: DataFrame | None = None) -> DataFrame:
    """(s, items): the list that each subject states with this predicate."""
    found = axioms(graph, p, of)
    return found.join(read_lists(graph, found.select("o")).withColumnRenamed("node", "o"), "o").select("s", "items")


# Recognition


def classes(graph: Graph) -> DataFrame:
    """(s, kind): Class, Intersection, Union, OneOf, Complement or Restriction; kinds of constructors come first."""
    built = graph.df.where(F.col("p").isin(OWL.intersectionOf, OWL.unionOf, OWL.oneOf, OWL.complementOf)).select("s", "p")
    ranks = {OWL.intersectionOf: "Intersection", OWL.unionOf: "Union", OWL.oneOf: "OneOf", OWL.complementOf: "Complement"}
    kind = F.coalesce(*[F.when(F.col("p") == p, F.lit(k)) for p, k in ranks.items()])
    named = _typed(graph, OWL.Class, RDFS.Class).select("s", F.lit("Class").alias("kind"))
    restricted = _typed(graph, OWL.Restriction).select("s", F.lit("Restriction").alias("kind"))
    predefined = _constants(graph, PREDEFINED_CLASSES).select("s", F.lit("Class").alias("kind"))
    rows = reduce(DataFrame.union, [built.select("s", kind.alias("kind")), named, restricted, predefined])
    order = F.array_position(F.array(*map(F.lit, ["Restriction", "Intersection", "Union", "OneOf", "Complement", "Class"])), F.col("kind"))
    return rows.groupBy("s").agg(F.min_by("kind", order).alias("kind"))


def datatypes(graph: Graph) -> DataFrame:
    return _union(_typed(graph, RDFS.Datatype), _constants(graph, [*DATATYPES, RDFS.Literal]))


def annotation_properties(graph: Graph) -> DataFrame:
    return _union(_typed(graph, OWL.AnnotationProperty), _constants(graph, ANNOTATIONS))


def properties(graph: Graph) -> DataFrame:
    """(s, kind): Object, Datatype or Annotation; a plain rdf:Property is Datatype if a range of it is, else Object if a
    range is a class. One with several kinds has a row for each."""
    stated = {OWL.ObjectProperty: "Object", OWL.DatatypeProperty: "Datatype", OWL.AnnotationProperty: "Annotation", **dict.fromkeys(CHARACTERISTICS, "Object")}
    stated.pop(OWL.FunctionalProperty)  # datatype properties can be functional too
    rows = graph.df.where((F.col("p") == RDF.type) & F.col("o").isin(list(stated)))
    known = rows.select("s", F.coalesce(*[F.when(F.col("o") == t, F.lit(k)) for t, k in stated.items()]).alias("kind")).distinct()
    annotations = _constants(graph, ANNOTATIONS).select("s", F.lit("Annotation").alias("kind"))
    ranges = _objects(graph, RDFS.range, o="o").join(_typed(graph, RDF.Property), "s", "left_semi")
    by_data = ranges.join(datatypes(graph).withColumnRenamed("s", "o"), "o", "left_semi").select("s", F.lit("Datatype").alias("kind"))
    by_class = ranges.join(classes(graph).select(F.col("s").alias("o")), "o", "left_semi").select("s", F.lit("Object").alias("kind"))
    inferred = by_data.union(by_class.join(by_data.select("s"), "s", "left_anti")).join(known, "s", "left_anti")
    return _union(known, annotations, inferred)


def individuals(graph: Graph) -> DataFrame:
    """Nodes typed owl:Thing, owl:NamedIndividual, or by a class of the graph."""
    typed = _objects(graph, RDF.type)
    by_class = typed.join(classes(graph).select(F.col("s").alias("o")), "o", "left_semi").select("s")
    return _union(_typed(graph, OWL.Thing, OWL.NamedIndividual), by_class)


def entities(graph: Graph) -> DataFrame:
    """(s, kind) of an ontology's own entities, without the predefined ones: Class, ...Property, Individual."""
    own = [*PREDEFINED_CLASSES, *PREDEFINED_PROPERTIES, *ANNOTATIONS, *DATATYPES]
    rows = [
        classes(graph).select("s", F.lit("Class").alias("kind")),
        properties(graph).select("s", F.concat("kind", F.lit("Property")).alias("kind")),
        individuals(graph).select("s", F.lit("Individual").alias("kind")),
    ]
    return reduce(DataFrame.union, rows).where(~F.col("s").isin(own)).distinct()


def contains(graph: Graph, of: DataFrame) -> DataFrame:
    """(s, there): whether the graph, as an ontology, has each of the entities in the one column of `of`: whether it types
    them. Any typed node counts, so also one that entities() does not list because its type is unknown."""
    typed = graph.df.where(F.col("p") == RDF.type).select("s", F.lit(True).alias("typed")).distinct()
    return of.toDF("s").distinct().join(typed, "s", "left").select("s", F.coalesce("typed", F.lit(False)).alias("there"))


def add_entities(graph: Graph, frames: DataFrame) -> Graph:
    """The ontology with entities: their frames, triples (s, p, o) as frame() or a make_* function gives them."""
    return graph | Graph.from_triples(frames)


def remove_entities(graph: Graph, of: DataFrame) -> Graph:
    """The ontology without the entities in the one column of `of`: without the triples of their frames."""
    return Graph(graph.df.join(of.toDF("s").distinct(), "s", "left_anti").select("g", "s", "p", "o"))


def ontologies(graph: Graph) -> DataFrame:
    return _typed(graph, OWL.Ontology)


# Entities


def frame(graph: Graph, of: DataFrame) -> DataFrame:
    """(s, p, o): all that is said about the entities in the one column of `of`."""
    return graph.df.select("s", "p", "o").join(of.toDF("s"), "s", "left_semi").distinct()


def annotations(graph: Graph, of: DataFrame | None = None) -> DataFrame:
    """(s, p, o) whose predicate is an annotation property, of all subjects or of some (an ontology's node too)."""
    rows = graph.df.select("s", "p", "o").join(annotation_properties(graph).withColumnRenamed("s", "p"), "p", "left_semi").select("s", "p", "o")
    return rows if of is None else rows.join(of.toDF("s"), "s", "left_semi")


def super_classes(graph: Graph) -> DataFrame:
    return axioms(graph, RDFS.subClassOf)


def class_ancestors(graph: Graph) -> DataFrame:
    """(s, o): every class with all classes above it; those on a cycle are above each other and themselves."""
    return closure(_edges(graph, RDFS.subClassOf)).toDF("s", "o")


def property_ancestors(graph: Graph) -> DataFrame:
    """(s, o): every property with all properties above it."""
    return closure(_edges(graph, RDFS.subPropertyOf)).toDF("s", "o")


def _edges(graph: Graph, predicate: str) -> DataFrame:
    return graph.get(None, predicate).df.select(F.col("s").alias("a"), F.col("o").alias("b"))


def same_individuals(graph: Graph) -> DataFrame:
    """(s, same): every individual that owl:sameAs ties to others, with the least of them, its representative."""
    return connected(_edges(graph, OWL.sameAs)).toDF("s", "same")


def merged(graph: Graph) -> Graph:
    """The graph with every individual replaced by its representative, without owl:sameAs."""
    same = checkpointed(same_individuals(graph), "same")
    df = graph.df.where(F.col("p") != OWL.sameAs)
    for place in ("s", "o"):
        df = df.join(same.toDF(place, f"_{place}"), place, "left").withColumn(place, F.coalesce(f"_{place}", place)).drop(f"_{place}")
    return Graph(df.select(*COLUMNS).distinct())


def sub_classes(graph: Graph) -> DataFrame:
    return _objects(graph, RDFS.subClassOf, s="o", o="s").select("s", "o")


def equivalent_classes(graph: Graph) -> DataFrame:
    return axioms(graph, OWL.equivalentClass)


def disjoint_classes(graph: Graph) -> DataFrame:
    return axioms(graph, OWL.disjointWith)


def complements(graph: Graph) -> DataFrame:
    return axioms(graph, OWL.complementOf)


def disjoint_unions(graph: Graph) -> DataFrame:
    return lists_of(graph, OWL.disjointUnionOf)


def intersections(graph: Graph) -> DataFrame:
    return lists_of(graph, OWL.intersectionOf)


def unions(graph: Graph) -> DataFrame:
    return lists_of(graph, OWL.unionOf)


def enumerations(graph: Graph) -> DataFrame:
    return lists_of(graph, OWL.oneOf)


def deprecated(graph: Graph) -> DataFrame:
    said = graph.df.where((F.col("p") == OWL.deprecated) & F.startswith("o", F.lit('"true"'))).select("s")
    return _union(said, _typed(graph, OWL.DeprecatedClass, OWL.DeprecatedProperty))


#: Axioms of properties by name: predicate and the kinds of property that have them.
PROPERTY_AXIOMS = {
    "equivalent": OWL.equivalentProperty,
    "disjoint": OWL.propertyDisjointWith,
    "inverse": OWL.inverseOf,
    "domain": RDFS.domain,
    "range": RDFS.range,
    "super": RDFS.subPropertyOf,
}


def property_axioms(graph: Graph, axiom: str, kind: str | None = None) -> DataFrame:
    """(s, o): an axiom of PROPERTY_AXIOMS, of all properties or of those of a kind."""
    of = None if kind is None else properties(graph).where(F.col("kind") == kind).select("s")
    return axioms(graph, PROPERTY_AXIOMS[axiom], of)


def property_chains(graph: Graph) -> DataFrame:
    return lists_of(graph, OWL.propertyChainAxiom)


def characteristics(graph: Graph) -> DataFrame:
    """(s, characteristic)."""
    rows = graph.df.where((F.col("p") == RDF.type) & F.col("o").isin(list(CHARACTERISTICS)))
    return rows.select("s", F.coalesce(*[F.when(F.col("o") == t, F.lit(n)) for t, n in CHARACTERISTICS.items()]).alias("characteristic")).distinct()


def types(graph: Graph) -> DataFrame:
    """(s, o): individuals and their classes."""
    return _objects(graph, RDF.type).join(classes(graph).select(F.col("s").alias("o")), "o", "left_semi").select("s", "o")


def same_as(graph: Graph) -> DataFrame:
    return axioms(graph, OWL.sameAs)


def different_from(graph: Graph) -> DataFrame:
    return axioms(graph, OWL.differentFrom)


def facts(graph: Graph) -> DataFrame:
    """(s, p, o): positive facts of individuals, with object or datatype properties."""
    own = properties(graph).where(F.col("kind") != "Annotation").select(F.col("s").alias("p")).distinct()
    return graph.df.select("s", "p", "o").join(own, "p", "left_semi").join(individuals(graph), "s", "left_semi").select("s", "p", "o").distinct()


def negative_facts(graph: Graph) -> DataFrame:
    """(s, p, o): one pivot over the assertion nodes instead of a join per part."""
    parts = graph.df.where(F.col("p").isin(OWL.sourceIndividual, OWL.assertionProperty, OWL.targetIndividual, OWL.targetValue))
    of = lambda *names: F.max(F.when(F.col("p").isin(list(names)), F.col("o")))
    star = parts.join(_typed(graph, OWL.NegativePropertyAssertion), "s", "left_semi").groupBy("s").agg(
        of(OWL.sourceIndividual).alias("source"), of(OWL.assertionProperty).alias("p"), of(OWL.targetIndividual, OWL.targetValue).alias("o")
    )
    return star.select(F.col("source").alias("s"), "p", "o").dropna().distinct()


GROUPS = {OWL.AllDisjointClasses: "AllDisjointClasses", OWL.AllDisjointProperties: "AllDisjointProperties", OWL.AllDifferent: "AllDifferent"}


def disjoint_groups(graph: Graph) -> DataFrame:
    """(s, kind, items): groups of pairwise disjoint classes or properties, or of different individuals."""
    kinds = _objects(graph, RDF.type).where(F.col("o").isin(list(GROUPS))).select("s", F.coalesce(*[F.when(F.col("o") == t, F.lit(k)) for t, k in GROUPS.items()]).alias("kind"))
    heads = axioms(graph, [OWL.members, OWL.distinctMembers]).join(kinds, "s")
    return heads.join(read_lists(graph, heads.select("o")).withColumnRenamed("node", "o"), "o").select("s", "kind", "items")


# Making axioms


def make_axioms(pairs: DataFrame, p: str) -> DataFrame:
    """Triples s p o of pairs (s, o): any axiom with one predicate (subClassOf, inverseOf, sameAs ...)."""
    return pairs.select("s", F.lit(p).alias("p"), "o")


def make_list_axioms(lists: DataFrame, p: str) -> DataFrame:
    """Triples of axioms (s, items) whose object is a list (unionOf, intersectionOf, oneOf, propertyChainAxiom ...)."""
    head = F.concat(F.lit("_:l"), F.md5(F.concat_ws(" ", "s", F.lit(p), F.array_join("items", " "))))
    rows = lists.select("s", F.when(F.size("items") == 0, F.lit(RDF.nil)).otherwise(head).alias("node"), "items")
    return rows.select("s", F.lit(p).alias("p"), F.col("node").alias("o")).union(build_lists(rows.select("node", "items")))


def make_class(lists: DataFrame, p: str) -> DataFrame:
    """Boolean classes and enumerations (s, items) with their type; s names the class, or is a blank node."""
    return make_list_axioms(lists, p).union(lists.select("s", F.lit(RDF.type), F.lit(OWL.Class)))


def make_characteristics(pairs: DataFrame) -> DataFrame:
    """Triples of (s, characteristic)."""
    by_name = F.coalesce(*[F.when(F.col("characteristic") == n, F.lit(t)) for t, n in CHARACTERISTICS.items()])
    return pairs.select("s", F.lit(RDF.type).alias("p"), by_name.alias("o"))


def make_negative_facts(rows: DataFrame) -> DataFrame:
    """Assertion nodes for facts (s, p, o)."""
    node = F.concat(F.lit("_:f"), F.md5(F.concat_ws(" ", "s", "p", "o")))
    target = F.when(is_literal(F.col("o")), F.lit(OWL.targetValue)).otherwise(F.lit(OWL.targetIndividual))
    parts: list[tuple[Column, Column]] = [(F.lit(RDF.type), F.lit(OWL.NegativePropertyAssertion)), (F.lit(OWL.sourceIndividual), F.col("s")), (F.lit(OWL.assertionProperty), F.col("p")), (target, F.col("o"))]
    return rows.select(node.alias("s"), F.inline(F.array(*[F.struct(p.alias("p"), o.alias("o")) for p, o in parts])))


def make_group(groups: DataFrame, kind: str) -> DataFrame:
    """Groups (s, items) of a kind of GROUPS."""
    type_ = {k: t for t, k in GROUPS.items()}[kind]
    p = OWL.distinctMembers if kind == "AllDifferent" else OWL.members
    return make_list_axioms(groups, p).union(groups.select("s", F.lit(RDF.type), F.lit(type_)))


# Restrictions

#: What a restriction says, by predicate; qualified forms say their filler with onClass or onDataRange.
_SAYS = {
    OWL.someValuesFrom: "SomeValuesFrom",
    OWL.allValuesFrom: "AllValuesFrom",
    OWL.hasValue: "HasValue",
    OWL.cardinality: "ExactCardinality",
    OWL.minCardinality: "MinCardinality",
    OWL.maxCardinality: "MaxCardinality",
    OWL.qualifiedCardinality: "ExactCardinality",
    OWL.minQualifiedCardinality: "MinCardinality",
    OWL.maxQualifiedCardinality: "MaxCardinality",
}
_FILLERS = [OWL.onClass, OWL.onDatatype, OWL.onDataRange]


def restrictions(graph: Graph) -> DataFrame:
    """(s, kind, property, n, filler): one pivot over all owl:Restriction nodes. Kinds: Object or Data, Qualified or not,
    with the name of _SAYS; NAryDataSomeValuesFrom and NAryDataAllValuesFrom have their list in `properties`."""
    rows = graph.df.select("s", "p", "o").join(_typed(graph, OWL.Restriction), "s", "left_semi")
    says = F.coalesce(*[F.when(F.col("p") == p, F.lit(k)) for p, k in _SAYS.items()])
    counts = F.col("p").isin([p for p, k in _SAYS.items() if k.endswith("Cardinality")])
    star = rows.groupBy("s").agg(
        F.max(says).alias("says"),
        F.max(F.when(F.col("p") == OWL.onProperty, F.col("o"))).alias("property"),
        F.max(F.when(F.col("p") == OWL.onProperties, F.col("o"))).alias("list"),
        F.max(F.when(counts, F.regexp_extract("o", r'^"\s*(\d+)\s*"', 1).try_cast("int"))).alias("n"),
        F.max(F.when(F.col("p").isin(_FILLERS), F.col("o"))).alias("on"),
        F.max(F.when(F.col("p").isin(OWL.someValuesFrom, OWL.allValuesFrom, OWL.hasValue), F.col("o"))).alias("value"),
        F.max(F.col("p").isin(OWL.onDatatype, OWL.onDataRange)).alias("on_data"),
    ).where("says is not null and (property is not null or list is not null)")
    kinds = properties(graph).where("kind <> 'Annotation'").groupBy(F.col("s").alias("property")).agg(F.max("kind").alias("of"))
    data_values = datatypes(graph).select(F.col("s").alias("value"), F.lit(True).alias("data_value"))
    joined = star.join(kinds, "property", "left").join(data_values, "value", "left")
    is_data = (F.coalesce("of", F.lit("")) == "Object").eqNullSafe(False) & (
        (F.col("of") == "Datatype") | F.col("on_data") | F.coalesce("data_value", F.lit(False)) | is_literal(F.col("value"))
    )
    kind = F.concat(
        F.when(F.col("list").isNotNull(), F.lit("NAryData")).when(F.coalesce(is_data, F.lit(False)), F.lit("Data")).otherwise(F.lit("Object")),
        F.when(F.col("on").isNotNull(), F.lit("Qualified")).otherwise(F.lit("")),
        F.col("says"),
    )
    lists = read_lists(graph, star.where("list is not null").select("list")).select(F.col("node").alias("list"), F.col("items").alias("properties"))
    return joined.join(lists, "list", "left").select("s", kind.alias("kind"), "property", "properties", "n", F.coalesce("on", "value").alias("filler"))


def make_restrictions(rows: DataFrame) -> DataFrame:
    """Triples of restrictions (s, kind, property, properties, n, filler) as restrictions() gives them."""
    by_kind = {k: p for p, k in _SAYS.items() if "ualified" not in p}
    says = F.coalesce(*[F.when(F.endswith("kind", F.lit(k)), F.lit(p)) for k, p in by_kind.items()])
    counted = F.endswith("kind", F.lit("Cardinality"))
    number = F.concat(F.lit('"'), F.col("n").cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#nonNegativeInteger>'))
    on = F.when(F.startswith("kind", F.lit("Data")), F.lit(OWL.onDatatype)).otherwise(F.lit(OWL.onClass))
    parts = [
        (F.lit(RDF.type), F.lit(OWL.Restriction)),
        (F.when(F.col("property").isNotNull(), F.lit(OWL.onProperty)), F.col("property")),
        (says, F.when(counted, number).otherwise(F.col("filler"))),
        (F.when(counted & F.col("filler").isNotNull(), on), F.col("filler")),
    ]
    plain = rows.select("s", F.inline(F.array(*[F.struct(p.alias("p"), o.alias("o")) for p, o in parts]))).where("p is not null and o is not null")
    return plain.union(make_list_axioms(rows.where("properties is not null").select("s", F.col("properties").alias("items")), OWL.onProperties))


def some_values(graph: Graph) -> DataFrame:
    """(s, property, filler): existential restrictions of either kind."""
    return restrictions(graph).where(F.endswith("kind", F.lit("SomeValuesFrom")) & F.col("property").isNotNull()).select("s", "property", "filler")


def named_only(df: DataFrame, column: str = "s") -> DataFrame:
    return df.where(is_iri(F.col(column)))

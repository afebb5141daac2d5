"""RDF terms as canonical N-Triples strings (term keys), and the vocabularies.

A key is "<iri>", "_:label", or a quoted literal with an optional "@lang" or "^^<datatype>"; equal terms have equal keys,
so joins, grouping and Parquet filters work on one plain string column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Namespace:
    """A prefix of IRIs; `ns.name` and `ns["name"]` are keys of named nodes."""

    base: str

    def __getitem__(self, name: str) -> str:
        return f"<{self.base}{name}>"

    def __getattr__(self, name: str) -> str:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def legal(self, name: str) -> str | None:
        """The key, or None where the name could not be written as a prefixed name."""
        return self[name] if re.fullmatch(r"[^\W\d][\w.-]*", name) else None


XSD = Namespace("http://www.w3.org/2001/XMLSchema#")
RDF = Namespace("http://www.w3.org/1999/02/22-rdf-syntax-ns#")
RDFS = Namespace("http://www.w3.org/2000/01/rdf-schema#")
OWL = Namespace("http://www.w3.org/2002/07/owl#")

#: The numeric datatypes, integers first.
INTEGERS = (
    "integer nonPositiveInteger negativeInteger nonNegativeInteger positiveInteger "
    "long int short byte unsignedLong unsignedInt unsignedShort unsignedByte"
).split()
NUMERIC = [*INTEGERS, "decimal", "float", "double"]
#: The datatypes that a graph knows without stating them. They are the XSD types of RDF literals rather than
#: the datatype map of OWL 2, which leaves out the calendar types below and has some more.
DATATYPES = [
    XSD[name]
    for name in (
        "boolean byte double float long short duration dateTime time date gYearMonth gYear gMonthDay gDay gMonth base64Binary "
        "hexBinary anyURI QName NOTATION string normalizedString token language Name NCName ID IDREF IDREFS ENTITY ENTITIES "
        "decimal integer nonPositiveInteger negativeInteger int nonNegativeInteger unsignedLong unsignedInt unsignedByte unsignedShort"
    ).split()
] + [RDF.XMLLiteral]


def iri(value: str) -> str:
    return f"<{value}>"


def blank(label: str) -> str:
    return f"_:{label}"


#: What is escaped inside a literal's key, backslash first.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def literal(value: str, lang: str | None = None, datatype: str | None = None) -> str:
    """The key of a literal; `datatype` is a key of a named node."""
    for plain, escaped in ESCAPES:
        value = value.replace(plain, escaped)
    return f'"{value}"' + (f"@{lang}" if lang else f"^^{datatype}" if datatype and datatype != XSD.string else "")


def iri_column(value: Column) -> Column:
    return F.concat(F.lit("<"), value.cast("string"), F.lit(">"))


def literal_column(value: Column, lang: Column | None = None, datatype: str | None = None) -> Column:
    """The key of a literal from columns; null values give null keys."""
    text = value.cast("string")
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    tail = F.concat(F.lit('"@'), lang) if lang is not None else F.lit(f'"^^{datatype}' if datatype and datatype != XSD.string else '"')
    return F.concat(F.lit('"'), text, tail)


def as_key(term: str | int | float | bool) -> str:
    """A Python value as a key; strings are keys already."""
    if isinstance(term, bool):
        return literal(str(term).lower(), datatype=XSD.boolean)
    if isinstance(term, int):
        return literal(str(term), datatype=XSD.integer)
    if isinstance(term, float):
        return literal(repr(term), datatype=XSD.double)
    return term

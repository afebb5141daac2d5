"""SPARQL's term functions, tests and comparisons as Spark columns over term keys.

Null stands for an unbound variable and for an error alike; SQL's three-valued AND, OR and NOT are then SPARQL's.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.terms import INTEGERS, NUMERIC, XSD

_NUMERIC = [XSD[n][1:-1] for n in NUMERIC]
_STRING = XSD.string[1:-1]
_NUMBER = rf'(?s)^"((?:[^"\\]++|\\.)*+)"\^\^<(?:{"|".join(map(re.escape, _NUMERIC))})>$'


def is_iri(key: Column) -> Column:
    return F.startswith(key, F.lit("<"))


def is_blank(key: Column) -> Column:
    return F.startswith(key, F.lit("_:"))


def is_literal(key: Column) -> Column:
    return F.startswith(key, F.lit('"'))


def bound(key: Column) -> Column:
    return key.isNotNull()


def same_term(a: Column, b: Column) -> Column:
    return a == b


def lexical(key: Column) -> Column:
    """A literal's unescaped text, or an IRI's text; null for blank nodes (STR)."""
    inner = F.regexp_extract(key, r'(?s)^"((?:[^"\\]++|\\.)*+)"', 1)
    hidden = F.replace(inner, F.lit("\\\\"), F.lit("\x00"))
    for escaped, plain in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        hidden = F.replace(hidden, F.lit(escaped), F.lit(plain))
    return F.when(is_literal(key), hidden).when(is_iri(key), F.substr(key, F.lit(2), F.length(key) - 2))


str_ = lexical


def lang(key: Column) -> Column:
    """A literal's language tag, empty if it has none; null for other terms."""
    return F.when(is_literal(key), F.regexp_extract(key, r'"@([A-Za-z]+(?:-[A-Za-z0-9]+)*)$', 1))


def datatype(key: Column) -> Column:
    """A literal's datatype IRI text; plain literals are xsd:string, literals with a language give null."""
    typed = F.regexp_extract(key, r'"\^\^<([^>]*)>$', 1)
    return F.when(is_literal(key), F.when(typed != "", typed).when(lang(key) == "", F.lit(_STRING)))


def lang_matches(tag: Column, wanted: Column | str) -> Column:
    """Whether a tag matches a basic language range; "*" matches every tag that is not empty."""
    wanted = F.lower(F.lit(wanted) if isinstance(wanted, str) else wanted)
    tag = F.lower(tag)
    return F.when(wanted == "*", tag != "").otherwise((tag == wanted) | F.startswith(tag, F.concat(wanted, F.lit("-"))))


def regex(text: Column, pattern: str, flags: str = "") -> Column:
    """REGEX: finds the pattern anywhere; flags i, s, m, x."""
    if set(flags) - set("ismx"):
        raise ValueError(f"flags are of i, s, m, x: {flags}")
    return text.rlike(f"(?{flags}){pattern}" if flags else pattern)


def numeric(key: Column) -> Column:
    """The value of a numeric literal as a double, otherwise null."""
    # The key stands here once, so that one which is itself computed is computed once; what is escaped in a number is space.
    return F.regexp_replace(F.regexp_extract(key, _NUMBER, 1), r"\\[nrt]", " ").try_cast("double")


def boolean(key: Column) -> Column:
    value = lexical(key)
    return F.when(datatype(key) == XSD.boolean[1:-1], F.when(value.isin("true", "1"), True).when(value.isin("false", "0"), False))


def instant(key: Column) -> Column:
    return F.when(datatype(key).isin(XSD.dateTime[1:-1], XSD.date[1:-1]), lexical(key).try_cast("timestamp"))


def string(key: Column) -> Column:
    """The text of a plain or xsd:string literal, otherwise null."""
    return F.when(datatype(key) == _STRING, lexical(key))


def effective_boolean(key: Column) -> Column:
    """EBV: booleans, numbers other than 0 and NaN, texts that are not empty; null for other terms."""

    def truth(x: Column) -> Column:
        number, text, boolean_, _ = _values_of(x, "a")
        return F.coalesce(boolean_, (number != 0) & ~F.isnan(number), F.length(text) > 0)

    return _parsed(truth, a=key)


def _bound(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body of a struct of the values, each computed once however often body reads it."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), body), 1)


def _parts(**keys: Column) -> dict[str, Column]:
    """Of each key: itself, its text and its datatype."""
    return {f"{n}{part}": value for n, key in keys.items() for part, value in (("", key), ("_text", lexical(key)), ("_type", datatype(key)))}


def _parsed(body: Callable[[Column], Column], **keys: Column) -> Column:
    """body of the parts of keys; a key that is itself computed is computed once, however often its parts read it."""
    return _bound(keys, lambda k: _bound(_parts(**{n: k[n] for n in keys}), body))


def _value(x: Column, n: str, types: list[str], kind: str) -> Column:
    return F.when(x[f"{n}_type"].isin(types), x[f"{n}_text"].try_cast(kind))


def _values_of(x: Column, n: str) -> list[Column]:
    """A bound key's value as a number, a text, a boolean and an instant; all but one are null."""
    truth = F.when(x[f"{n}_type"] == XSD.boolean[1:-1], F.when(x[f"{n}_text"].isin("true", "1"), True).when(x[f"{n}_text"].isin("false", "0"), False))
    return [_value(x, n, _NUMERIC, "double"), _value(x, n, [_STRING], "string"), truth, _value(x, n, [XSD.dateTime[1:-1], XSD.date[1:-1]], "timestamp")]


def equal(a: Column, b: Column) -> Column:
    """"=" of keys: by value for numbers, booleans and dates; equal terms are equal; literals of other types that differ
    as terms are an error (null)."""

    def compared(x: Column) -> Column:
        by_value = F.coalesce(*[v == w for v, w in zip(_values_of(x, "a"), _values_of(x, "b"), strict=True)])
        unknown = x["a_type"].isNotNull() & x["b_type"].isNotNull()  # literals without a language
        same = x["a"] == x["b"]
        return F.when(same, True).otherwise(F.coalesce(by_value, F.when(~unknown, same)))

    return _parsed(compared, a=a, b=b)


def less(a: Column, b: Column) -> Column:
    """"<" of keys: numbers, texts, booleans, dates; null for what does not compare."""
    return _parsed(lambda x: F.coalesce(*[v < w for v, w in zip(_values_of(x, "a"), _values_of(x, "b"), strict=True)]), a=a, b=b)


def order_key(key: Column) -> list[Column]:
    """Sort columns in SPARQL's order: unbound, blank nodes, IRIs, literals (numbers by value)."""
    rank = F.when(key.isNull(), 0).when(is_blank(key), 1).when(is_iri(key), 2).otherwise(3)
    return [rank, F.coalesce(numeric(key), F.lit(float("-inf"))), lexical(key), key]


def divide(a: Column, b: Column) -> Column:
    """"/": decimals by zero are an error (null), doubles give infinity or NaN."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


# Arithmetic and aggregates of term keys. Numbers are promoted: integer, decimal, float, double. Integers are exact to 37
# digits, decimals to 18 places; what does not fit is an error (null), as is an operand that is not a number.

_KINDS = ["integer", "decimal", "float", "double"]
_INTEGERS = [XSD[n][1:-1] for n in INTEGERS]


def _kind(x: Column, n: str) -> Column:
    """Of a bound key: 0 for integers of any type, 1 decimals, 2 floats, 3 doubles; null for what is not a number."""
    type_ = x[f"{n}_type"]
    rank = F.when(type_.isin(_INTEGERS), 0)
    for i, name in enumerate(_KINDS[1:], 1):
        rank = rank.when(type_ == XSD[name][1:-1], i)
    return F.when(x[f"{n}_text"].try_cast("double").isNotNull(), rank)


def numeric_kind(key: Column) -> Column:
    """0 for integers of any type, 1 decimals, 2 floats, 3 doubles; null for what is not a number of its type."""
    return _parsed(lambda x: _kind(x, "a"), a=key)


def _number(kind: Column, whole: Column, decimal: Column, double: Column) -> Column:
    """The key of a number of that kind."""
    plain = F.regexp_replace(F.regexp_replace(decimal.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    texts = [whole.cast("string"), plain, double.cast("float").cast("string"), double.cast("string")]
    written = lambda k: F.coalesce(*[F.when(k["k"] == i, F.concat(F.lit('"'), t, F.lit(f'"^^{XSD[name]}'))) for i, (t, name) in enumerate(zip(texts, _KINDS, strict=True))])
    return _bound({"k": kind}, written)


def _binary(a: Column, b: Column, whole: str, decimal: str, exact, inexact, least: int = 0) -> Column:
    def result(x: Column) -> Column:
        both = {"k": F.when(_kind(x, "a").isNotNull() & _kind(x, "b").isNotNull(), F.greatest(_kind(x, "a"), _kind(x, "b"), F.lit(least)))}
        of = lambda kind: [x[f"{n}_text"].try_cast(kind) for n in "ab"]
        return _number(both["k"], exact(*of(whole)), exact(*of(decimal)), inexact(*of("double")))

    return _parsed(result, a=a, b=b)


def add(a: Column, b: Column) -> Column:
    """"+" of keys."""
    return _binary(a, b, "decimal(37,0)", "decimal(37,18)", F.try_add, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    """"-" of keys."""
    return _binary(a, b, "decimal(37,0)", "decimal(37,18)", F.try_subtract, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    """"*" of keys; operands up to 18 digits, decimals with up to 8 places."""
    return _binary(a, b, "decimal(18,0)", "decimal(18,8)", F.try_multiply, lambda x, y: x * y)


def divide_terms(a: Column, b: Column) -> Column:
    """"/" of keys: integers give decimals; by zero an error for exact numbers, infinity or NaN for others."""
    return _binary(a, b, "decimal(18,0)", "decimal(18,8)", F.try_divide, divide, least=1)


def negate(key: Column) -> Column:
    """Unary "-"."""
    return subtract(F.lit(f'"0"^^{XSD.integer}'), key)


def positive(key: Column) -> Column:
    """Unary "+": the number itself, null for other terms."""
    return F.when(numeric_kind(key).isNotNull(), key)


def _count(key: Column, times: Column | None) -> Column:
    return F.count(key) if times is None else F.coalesce(F.sum(F.when(key.isNotNull(), times)), F.lit(0))


def _total(key: Column, aggregate, times: Column | None = None) -> tuple[Column, Column, Column, Column]:
    """The kind of a group's numbers (null if a bound term is not a number), and an aggregate of their exact and double values."""
    kind, text = numeric_kind(key), lexical(key)
    all_numbers = F.count(key) == F.count(kind)
    weights = [1, 1, 1] if times is None else [times.cast("decimal(9,0)"), times.cast("decimal(9,0)"), times]
    values = [text.try_cast(t) if times is None else text.try_cast(t) * w for t, w in zip(("decimal(28,0)", "decimal(28,10)", "double"), weights, strict=True)]
    return F.when(all_numbers, F.max(kind)), *[aggregate(v) for v in values]


def sum_terms(key: Column, distinct: bool = False, times: Column | None = None) -> Column:
    """SUM of keys, an aggregate column: a number of the widest kind; 0 of no terms, null if a term is not a number. With
    distinct, each value counts once. `times` is how often a row counts (see Solutions.counted)."""
    kind, whole, decimal, double = _total(key, F.sum_distinct) if distinct else _total(key, F.sum, times)
    return F.when(F.count(key) == 0, F.lit(f'"0"^^{XSD.integer}')).otherwise(_number(kind, whole, decimal, double))


def avg_terms(key: Column, times: Column | None = None) -> Column:
    """AVG of keys, an aggregate column: a decimal for exact numbers. `times` is how often a row counts."""
    kind, _, decimal, double = _total(key, F.sum, times)
    n = _count(key, times)
    exact, mean = F.try_divide(decimal.cast("decimal(28,10)"), n.cast("decimal(12,0)")), F.try_divide(double, n.cast("double"))
    return F.when(F.count(key) == 0, F.lit(f'"0"^^{XSD.integer}')).otherwise(_number(F.greatest(kind, F.lit(1)), F.lit(None).cast("string"), exact, mean))


def _ordered(key: Column) -> Column:
    rank, value, text, whole = order_key(key)
    return F.struct(rank.alias("a"), value.alias("b"), text.alias("c"), whole.alias("d"))


def min_term(key: Column) -> Column:
    """MIN in the order of ORDER BY, an aggregate column; unbound terms don't count."""
    return F.min_by(key, F.when(key.isNotNull(), _ordered(key)))


def max_term(key: Column) -> Column:
    """MAX in the order of ORDER BY, an aggregate column."""
    return F.max_by(key, F.when(key.isNotNull(), _ordered(key)))

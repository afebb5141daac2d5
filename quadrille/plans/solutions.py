"""Solution sequences: DataFrames whose columns are query variables, with the operators of graph patterns.

Values are term keys, or stay native (numbers, texts, keys of a table) where a graph is a relational table; `iris` then
holds the IRI prefix of variables whose native value is a table key. Every operator is one DataFrame operation, so
Catalyst chooses join strategies and pushes filters and columns down.

A variable that an OPTIONAL or a UNION branch may leave unbound is in `maybe`. Joining on such a variable splits the
sides into bound and unbound rows, which keeps equi-joins where a null-tolerant condition would be a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.terms import is_blank, is_literal
from quadrille.plans.ordering import ordered
from quadrille.plans.ranges import band_join, triangles
from quadrille.storage import checkpointed

#: Rows of an order that Spark's own OFFSET and LIMIT may go through.
DEEP = 20_000

#: How often one row of counted() may count: values of 28 digits times it fit a decimal.
MOST_TIMES = 999_999_999


@dataclass(frozen=True)
class Solutions:
    df: DataFrame
    iris: dict[str, str] = field(default_factory=dict)
    maybe: frozenset[str] = frozenset()
    #: After order_by(): the order, and the solutions before it.
    order: tuple[Column, ...] = ()
    unsorted: DataFrame | None = None

    @property
    def variables(self) -> list[str]:
        """Visible variables: generated ones begin with an underscore."""
        return [c for c in self.df.columns if not c.startswith("_")]

    def __getitem__(self, variable: str) -> Column:
        return F.col(f"`{variable}`")

    def _with(self, df: DataFrame, **changes) -> Solutions:
        return replace(self, df=df, **({"order": (), "unsorted": None} | changes))

    def _shared(self, other: Solutions) -> list[str]:
        return [c for c in self.df.columns if c in other.df.columns]

    def _clash(self, other: Solutions) -> bool:
        """Whether a shared variable can never be equal: IRIs of different templates, or an IRI and a value."""
        return any(self.iris.get(v) != other.iris.get(v) for v in self._shared(other))

    def join(self, other: Solutions) -> Solutions:
        """Adjacent patterns: an inner join on the shared variables, a cross product without any."""
        if self._clash(other):
            a, b = self.rendered(), other.rendered()
            return a.join(b) if not a._clash(b) else self._with(a.df.limit(0))
        shared = self._shared(other)
        split = next((v for v in shared if v in self.maybe or v in other.maybe), None)
        iris, maybe = self.iris | other.iris, (self.maybe | other.maybe) - (set(shared) - (self.maybe & other.maybe))
        if split is None:
            df = self.df.join(other.df, shared) if shared else self.df.crossJoin(other.df)
            return Solutions(df, iris, maybe)
        sides = []
        for side in (self, other):
            bound = side._with(side.df.where(side[split].isNotNull()), maybe=side.maybe - {split})
            unbound = side._with(side.df.where(side[split].isNull()).drop(split), maybe=side.maybe - {split}) if split in side.maybe else None
            sides.append([bound, unbound])
        pairs = [a.join(b) for a in sides[0] if a for b in sides[1] if b]
        columns = [*self.df.columns, *[c for c in other.df.columns if c not in shared]]
        df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [p.df for p in pairs])
        return Solutions(df.select(*columns), iris, maybe)

    def within(self, other: Solutions, variable: str, of: str, below: float, above: float) -> Solutions:
        """Adjacent patterns without a shared variable, and FILTER(?of >= ?variable - below && ?of <= ?variable + above): a
        join on ranges of values instead of a nested loop. `variable` is one of this side, `of` of the other."""
        if self._shared(other):
            raise ValueError("the sides share a variable: join them and filter")
        return Solutions(band_join(self.df, other.df, (variable, of), below, above), self.iris | other.iris, self.maybe | other.maybe)

    def triangle(self, second: Solutions, third: Solutions) -> Solutions:
        """Three patterns that share their variables in a ring, (a, b), (b, c) and (c, a): a cyclic join whose steps in between
        stay small however many edges a node has."""
        sides = (self, second, third)
        if any(len(s.variables) != 2 or s.maybe for s in sides) or len({*self.variables, *second.variables, *third.variables}) != 3:
            raise ValueError("a triangle has three patterns of two bound variables, each two of them with one in common")
        if any(x._clash(y) for x, y in ((self, second), (second, third), (third, self))):
            return self.join(second).join(third)
        (a,), (b,), (c,) = (set(x.variables) & set(y.variables) for x, y in ((third, self), (self, second), (second, third)))
        frames = [s.df.select(F.col(x).alias(m), F.col(y).alias(n)) for s, x, y, m, n in ((self, a, b, "a", "b"), (second, b, c, "b", "c"), (third, c, a, "c", "a"))]
        found = triangles(*frames).select(F.col("a").alias(a), F.col("b").alias(b), F.col("c").alias(c))
        return Solutions(found, self.iris | second.iris | third.iris)

    def optional(self, other: Solutions, *filters: Column) -> Solutions:
        """OPTIONAL: a left join; filters written inside it belong to its condition."""
        shared = self._shared(other)
        if self._clash(other):
            new = [c for c in other.df.columns if c not in shared]
            return self._with(self.df.select("*", *[F.lit(None).cast(other.df.schema[c].dataType).alias(c) for c in new]), maybe=self.maybe | set(new))
        new = [c for c in other.df.columns if c not in shared]
        iris, maybe = self.iris | other.iris, self.maybe | set(new)
        if any(v in self.maybe or v in other.maybe for v in shared):
            return Solutions(self._optional_maybe(other, filters, new), iris, maybe)
        right = other.df.select(*[F.col(c).alias(f"__r_{c}") if c in shared else F.col(c) for c in other.df.columns])
        condition = reduce(lambda a, b: a & b, [*[F.col(v) == F.col(f"__r_{v}") for v in shared], *filters], F.lit(True))
        return Solutions(self.df.join(right, condition, "left").select(*self.df.columns, *new), iris, maybe)

    def _optional_maybe(self, other: Solutions, filters: Sequence[Column], new: list[str]) -> DataFrame:
        """A left join on variables that may be unbound: what joins, and the rows of the left side that nothing joins
        (equal rows share their fate, so the anti-join can compare whole rows)."""
        kept = {c: f"__l_{c}" for c in self.df.columns}
        left = self._with(self.df.select("*", *[F.col(c).alias(k) for c, k in kept.items()]))
        matched = left.join(other).df
        matched = matched.where(reduce(lambda a, b: a & b, filters)) if filters else matched
        hit = matched.select(*kept.values()).distinct()
        missed = self.df.join(hit, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in kept.items()]), "left_anti")
        return matched.select(*self.df.columns, *new).unionByName(missed, allowMissingColumns=True)

    def without(self, other: Solutions) -> Solutions:
        """OPTIONAL { other } FILTER(!bound(x)) as the anti-join that it means."""
        shared = self._shared(other)
        if self._clash(other):
            return self
        if not shared:  # every row has a partner as soon as other has a row
            return self._with(self.df.join(other.df.limit(1).select(F.lit(1).alias("__any")), F.lit(True), "left_anti"))
        return self._with(self.df.join(other.df.select(*shared), shared, "left_anti"))

    def union(self, *others: Solutions) -> Solutions:
        """UNION, keeping duplicates; variables that a branch lacks are unbound there."""
        branches = [self, *others]
        if any(a._clash(b) for i, a in enumerate(branches) for b in branches[i + 1 :]):
            branches = [b.rendered() for b in branches]
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [b.df for b in branches])
        missing = {c for b in branches for c in df.columns if c not in b.df.columns}
        return Solutions(df, reduce(lambda a, b: a | b, [b.iris for b in branches]), frozenset(missing).union(*[b.maybe for b in branches]))

    def filter(self, condition: Column) -> Solutions:
        """FILTER: rows whose condition is an error (null) are dropped."""
        return self._with(self.df.where(condition))

    def select(self, *columns: str | Column) -> Solutions:
        return self._with(self.df.select(*columns))

    def select_all(self) -> Solutions:
        return self._with(self.df.select(*self.variables))

    def distinct(self) -> Solutions:
        return self._with(self.df.distinct())

    reduced = distinct

    def order_by(self, *columns: Column) -> Solutions:
        """ORDER BY columns, each ascending (unbound first) unless it is a sort order already."""
        return replace(self, df=self.df.orderBy(*columns), order=columns, unsorted=self.df)

    def slice(self, offset: int = 0, limit: int | None = None) -> Solutions:
        """LIMIT and OFFSET. Beyond the first DEEP rows of an order, the solutions are dealt to ranges of the order on shared
        storage, and only the ranges that hold the window are read: Spark's own OFFSET would keep offset + limit rows in
        each task and merge them all in one."""
        if self.order and offset + (limit or 0) > DEEP:
            return self._with(ordered(self.unsorted, *self.order).window(offset, limit).orderBy(*self.order))
        df = self.df.offset(offset) if offset else self.df
        return self._with(df if limit is None else df.limit(limit))

    def count_all(self, distinct: bool = False) -> Column:
        """COUNT(*), or COUNT(DISTINCT *) over the visible variables, for aggregate()."""
        return F.count_distinct(F.struct(*map(F.col, self.variables))) if distinct else F.count("*")

    def counted(self, *variables: str) -> Solutions:
        """The different rows of these variables and how often each comes up (`_times`; what comes up more than MOST_TIMES has
        several rows). Aggregates of terms over them take `times`; those hold texts and so sort their rows, while this
        count is hashed and combined before its shuffle."""
        n = F.col("_n")
        often = F.concat(F.array_repeat(F.lit(MOST_TIMES).cast("long"), F.floor(n / MOST_TIMES).cast("int")), F.filter(F.array(n % MOST_TIMES), lambda x: x > 0))
        df = self.df.groupBy(*variables).agg(F.count("*").alias("_n"))
        return self._with(df.select(*variables, F.explode(often).alias("_times")), iris={v: i for v, i in self.iris.items() if v in variables}, maybe=self.maybe & set(variables))

    def aggregate(self, *aggregates: Column, by: Sequence[str] = (), having: Column | None = None) -> Solutions:
        """Aggregates; plain variables beside them are the groups."""
        df = self.df.groupBy(*by).agg(*aggregates) if by else self.df.agg(*aggregates)
        return Solutions(df if having is None else df.where(having), {v: i for v, i in self.iris.items() if v in by}, self.maybe & set(by))

    def rendered(self, *variables: str) -> Solutions:
        """Table keys written as IRI text: of these variables, or of all."""
        chosen = set(variables) or set(self.iris)
        write = lambda c: F.concat(F.lit(self.iris[c]), F.col(c).cast("string")).alias(c) if c in self.iris and c in chosen else F.col(c)
        return Solutions(self.df.select(*map(write, self.df.columns)), {v: i for v, i in self.iris.items() if v not in chosen}, self.maybe)

    def ask(self) -> DataFrame:
        """ASK: one row with the answer."""
        return self.df.limit(1).agg((F.count("*") > 0).alias("answer"))

    def construct(self, *template: tuple[str | Column, str | Column, str | Column]) -> DataFrame:
        """CONSTRUCT: the set of triples (s, p, o) that the template gives for each solution. Strings are term keys, or
        variables with a leading "?"; "_:x" is a blank node of its own for each solution. Triples with an unbound part, a
        literal subject or a predicate that is not an IRI are left out."""
        if not template:
            raise ValueError("a template has at least one triple")
        df = self.df
        if any(isinstance(x, str) and x.startswith("_:") for t in template for x in t):
            # Written down first: a task that runs again must not name a solution's nodes anew.
            df = checkpointed(df.withColumn("__row", F.hex(F.monotonically_increasing_id())), "solutions")

        def part(term: str | Column) -> Column:
            if isinstance(term, Column):
                return term
            if term.startswith("?"):
                return F.col(term[1:])
            return F.concat(F.lit(f"{term}x"), F.col("__row")) if term.startswith("_:") else F.lit(term)

        triples = F.array(*[F.struct(part(s).alias("s"), part(p).alias("p"), part(o).alias("o")) for s, p, o in template])
        df = df.select(F.explode(triples).alias("t")).select("t.*").dropna()
        return df.where(~is_literal(F.col("s")) & ~is_literal(F.col("p")) & ~is_blank(F.col("p"))).distinct()


def union_all(branches: Sequence[Solutions]) -> Solutions:
    return branches[0].union(*branches[1:])

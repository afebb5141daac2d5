"""Rows in a total order, dealt to ranges on shared storage, so that positions and deep windows need no single task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.storage import shared_folder

#: monotonically_increasing_id() counts the rows of a partition in so many low bits.
_ROW_BITS = 33


@dataclass(frozen=True)
class Ordered:
    """`rows` has the given columns, `_range` (a partition of the files) and `_row` (the place within the range);
    starts[r] is the number of rows in ranges before r. Ranges are as many as the shuffle has partitions, so `starts` is
    bounded by that setting and not by the rows.
    """

    rows: DataFrame
    starts: tuple[int, ...]
    total: int

    @property
    def _columns(self) -> list[str]:
        return [c for c in self.rows.columns if c not in ("_range", "_row")]

    def _position(self) -> Column:
        starts = F.split(F.lit(",".join(map(str, self.starts)) or "0"), ",")
        return F.element_at(starts, F.col("_range") + 1).cast("long") + F.col("_row")

    def numbered(self, name: str = "position") -> DataFrame:
        """Every row with its place in the order, from 0."""
        return self.rows.select(*self._columns, self._position().alias(name))

    def window(self, offset: int, limit: int | None = None) -> DataFrame:
        """The rows from `offset` on, `limit` of them: only the ranges that hold some of them are read."""
        end = self.total if limit is None else min(self.total, offset + limit)
        ends = [*self.starts[1:], self.total]
        held = [r for r, (a, b) in enumerate(zip(self.starts, ends, strict=False)) if a < end and b > offset and a < b]
        place = self._position()
        return self.rows.where(F.col("_range").isin(held)).where((place >= offset) & (place < end)).select(*self._columns)


def ordered(df: DataFrame, *order: Column | str, ranges: int | None = None) -> Ordered:
    """df by the order, as ranges. Rows that the order does not tell apart are told apart by all columns that can be sorted,
    so that a key with many rows is still dealt to many ranges.

    `ranges` fixes their number; without it the session's shuffle partitions do, joined where they are small.

    One shuffle, by range, whose partitions are sorted where they are and written down with each row's place. The counts of
    the ranges come from what was written; no row goes through the driver.
    """
    names = df.columns
    clash = {"_range", "_row", "_at"} & set(names)
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    sortable = [F.col(f"`{c}`") for c in names if not any(t in df.schema[c].dataType.simpleString() for t in ("map<", "variant"))]
    keys = [*order, *sortable]
    laid = df.repartitionByRange(*[x for x in [ranges] if x], *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = laid.select(*[f"`{c}`" for c in names], (F.col("_at") % (1 << _ROW_BITS)).alias("_row"), F.shiftright("_at", _ROW_BITS).cast("int").alias("_range"))
    path = shared_folder(df.sparkSession, "ordered")
    placed.write.partitionBy("_range").parquet(path)
    rows = df.sparkSession.read.schema(placed.schema).parquet(path)
    counts = {r["_range"]: r["n"] for r in rows.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for r in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(r, 0)
    return Ordered(rows, tuple(starts), total)

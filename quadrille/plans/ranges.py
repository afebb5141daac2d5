"""Joins without an equality: bands of values, and triangles, as equi-joins of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def band_join(left: DataFrame, right: DataFrame, on: tuple[str, str], below: float, above: float) -> DataFrame:
    """Pairs of rows with left - below <= right <= left + above, for numeric columns `on` (left, right) of frames without
    common column names. Nulls and NaN are in no band.

    The values are cut into buckets as wide as the band. A row of the right side goes to its bucket, a row of the left side to
    the two that its band meets; the join is on the bucket, and the exact condition comes after it. Two buckets hold about
    twice as many rows as the band itself, so the work follows the result. Where values are dense a bucket is large and so is
    the result; Spark's skew join splits it.
    """
    a, b = F.col(on[0]).cast("double"), F.col(on[1]).cast("double")
    width = below + above
    if width < 0:
        return left.join(right, F.lit(False))
    place = lambda value: F.floor(value / width) if width else value
    ends = place(a - below), place(a + above)
    met = F.sequence(*ends) if width else F.array(ends[0])
    placed = left.where(a.isNotNull() & ~F.isnan(a)).withColumn("_bucket", F.explode(met))
    condition = (F.col(on[1]) >= F.col(on[0]) - below) & (F.col(on[1]) <= F.col(on[0]) + above)
    return placed.join(right.where(b.isNotNull() & ~F.isnan(b)).withColumn("_bucket", place(b)), "_bucket").where(condition).select(*left.columns, *right.columns)


def triangles(ab: DataFrame, bc: DataFrame, ca: DataFrame) -> DataFrame:
    """(a, b, c) of the cyclic pattern ab(a, b), bc(b, c), ca(c, a), each a set of edges.

    Joining two of the three first would make a row for every path of two edges, which a node with many edges multiplies.
    Here each edge (c, a) is extended from that of its ends which has fewer edges to b, and what comes out is looked up on
    the other side: at most the sum of the smaller degrees in between, which is never above the edges to the power 1.5.
    """
    ca = ca.select("c", "a").distinct()
    sides = [(ab.select("a", "b").distinct(), "a"), (bc.select("b", "c").distinct(), "c")]
    sized = ca
    for edges, end in sides:
        sized = sized.join(edges.groupBy(end).agg(F.count("*").alias(f"n_{end}")), end)
    by_a = sized.where("n_a <= n_c").select("c", "a").join(sides[0][0], "a").join(sides[1][0], ["b", "c"], "left_semi")
    by_c = sized.where("n_a > n_c").select("c", "a").join(sides[1][0], "c").join(sides[0][0], ["a", "b"], "left_semi")
    return by_a.select("a", "b", "c").union(by_c.select("a", "b", "c"))

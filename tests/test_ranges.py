"""Band joins and triangles against plain loops, with what their plans and steps in between look like."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.plans import ranges
from quadrille.plans.mapping import TableGraph
from quadrille.plans.solutions import Solutions

SF = "/root/testdata/sf0.001"


def frames(spark, n=300, seed=3):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, float("nan"), 7.0, 7.0, 7.0, round(rng.gauss(0, 50), 1), float(rng.randrange(20))])
    left, right = [(i, value()) for i in range(n)], [(i, value()) for i in range(n)]
    return left, right, spark.createDataFrame(left, "a int, x double"), spark.createDataFrame(right, "b int, y double")


@pytest.mark.parametrize(("below", "above"), [(1.0, 2.5), (0.0, 0.0), (300.0, 300.0), (-1.0, 2.0), (2.0, -2.0), (1.0, -2.0)])
def test_band_join(spark, below, above):
    left, right, a, b = frames(spark)
    found = sorted((r["a"], r["b"]) for r in ranges.band_join(a, b, ("x", "y"), below, above).collect())
    expected = [(i, j) for i, x in left for j, y in right if x is not None and y is not None and x == x and y == y and x - below <= y <= x + above]
    assert found == expected


def test_band_join_has_no_nested_loop(spark):
    g = TableGraph(spark, SF)
    s = g.star("orders", "o", o_totalprice="price").within(g.star("orders", "near", o_totalprice="near_price"), "price", "near_price", 1.0, 1.0)
    plan = s.df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and ("SortMergeJoin [_bucket" in plan or "HashJoin [_bucket" in plan)
    with pytest.raises(ValueError):
        g.star("orders", "o", o_totalprice="p").within(g.star("orders", "o", o_totalprice="q"), "p", "q", 1, 1)


def test_triangles(spark):
    rng = random.Random(4)
    edge = lambda n: {(rng.choice([0, rng.randrange(12)]), rng.choice([0, rng.randrange(12)])) for _ in range(n)}
    ab, bc, ca = edge(60), edge(60), edge(60)
    frame = lambda rows, schema: spark.createDataFrame([*rows, *list(rows)[:3]], schema)
    found = [tuple(r) for r in ranges.triangles(frame(ab, "a int, b int"), frame(bc, "b int, c int"), frame(ca, "c int, a int")).collect()]
    assert sorted(found) == sorted((a, b, c) for a, b in ab for b2, c in bc if b2 == b and (c, a) in ca)


def test_triangle_steps_stay_small(spark):
    """A star of many edges: joining two patterns first would make their product, the triangle's steps stay near the edges."""
    n = 400
    ab, bc = spark.range(n).select(F.col("id").alias("x"), F.lit(0).alias("y")), spark.range(n).select(F.lit(0).alias("y"), F.col("id").alias("z"))
    ca = spark.range(n).select(F.col("id").alias("z"), F.col("id").alias("x"))
    found = Solutions(ab).triangle(Solutions(bc), Solutions(ca)).df
    assert found.count() == n and sorted(found.columns) == ["x", "y", "z"]
    assert ab.join(bc, "y").count() == n * n
    rows = found._jdf.queryExecution().executedPlan()
    found.collect()
    most = max(int(m.group(1)) for m in __import__("re").finditer(r"rows=(\d+)", _metrics(rows)))
    assert most <= 4 * n
    with pytest.raises(ValueError):
        Solutions(ab).triangle(Solutions(bc), Solutions(ab))


def _metrics(plan) -> str:
    """The rows that each operator of an executed plan made."""
    node = plan
    out, todo = [], [node]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            node = node.executedPlan()
        option = node.metrics().get("numOutputRows")
        if option.isDefined():
            out.append(f"rows={option.get().value()}")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return " ".join(out)

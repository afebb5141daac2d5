"""Total orders dealt to ranges: positions, windows and what a window reads."""

import pytest
from pyspark.sql import functions as F

from quadrille.plans import solutions
from quadrille.plans.ordering import ordered
from quadrille.plans.solutions import Solutions


def rows(spark, n=1000):
    return spark.range(n, numPartitions=5).select(F.col("id").alias("k"), (F.col("id") * 7919 % 101).alias("v"), F.when(F.col("id") % 10 > 0, F.col("id") % 3).alias("w"))


def plain(spark, n=1000):
    return sorted(((k, k * 7919 % 101, k % 3 if k % 10 else None) for k in range(n)), key=lambda r: (r[2] is not None, r[2] or 0, -r[1], r[0]))


def order():
    return F.col("w").asc_nulls_first(), F.col("v").desc()


def test_positions(spark):
    found = {r["k"]: r["position"] for r in ordered(rows(spark), *order()).numbered().collect()}
    assert found == {r[0]: i for i, r in enumerate(plain(spark))}


@pytest.mark.parametrize(("offset", "limit"), [(0, 7), (123, 50), (990, 50), (2000, 5), (400, None)])
def test_window(spark, offset, limit):
    found = ordered(rows(spark), *order()).window(offset, limit).collect()
    expected = plain(spark)[offset : None if limit is None else offset + limit]
    assert len(found) == len(expected) and {tuple(r) for r in found} == set(expected)


def test_window_reads_only_its_ranges(spark):
    laid = ordered(rows(spark), *order(), ranges=4)
    assert len(laid.starts) > 1 and laid.total == 1000
    plan = laid.window(990, 5)._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "Exchange" not in plan


def test_one_key_for_all_is_still_dealt_to_many_ranges(spark):
    laid = ordered(spark.range(0, 4000, 1, 4).select(F.lit(1).alias("v"), "id"), F.col("v"), ranges=4)
    assert len(laid.starts) > 1
    assert [r["position"] for r in laid.numbered().orderBy("id").collect()] == list(range(4000))


def test_empty_and_equal_rows(spark):
    assert ordered(rows(spark).limit(0), *order()).numbered().count() == 0
    same = spark.createDataFrame([(1,)] * 30, "v int")
    assert sorted(r["position"] for r in ordered(same, F.col("v")).numbered().collect()) == list(range(30))
    with pytest.raises(ValueError):
        ordered(same.withColumnRenamed("v", "_row"), F.col("_row"))


def test_deep_slice(spark, monkeypatch):
    monkeypatch.setattr(solutions, "DEEP", 100)
    s = Solutions(rows(spark)).order_by(*order())
    deep = s.slice(500, 20)
    assert [r["k"] for r in deep.df.collect()] == [r[0] for r in plain(spark)[500:520]]
    assert "single" not in deep.df._jdf.queryExecution().executedPlan().toString().lower()
    assert [r["k"] for r in s.slice(20, 10).df.collect()] == [r["k"] for r in s.df.collect()][20:30]
    assert [r["k"] for r in s.slice(900).df.collect()] == [r[0] for r in plain(spark)[900:]]

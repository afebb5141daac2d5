"""Columns that only some shards have are kept, before and after compaction; files that nothing lists are removed."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quadrille.llm.common import scratch
from quadrille.llm.sharding import SchemaConflict, ShardStore


def test_new_and_missing_columns_survive_compaction(spark):
    parts = {
        "plain": spark.range(4).repartition(2),
        "extra": spark.createDataFrame([(10, "a"), (11, None)], "id long, extra string").repartition(2),
        "score": spark.createDataFrame([(20, 1.5, (1, None)), (21, None, None)], "ID long, score double, s struct<a: int, b: int>"),
        "other": spark.createDataFrame([(30, (2, "c"))], "id long, s struct<a: int, c: string>"),
    }
    wide = {10: ("a", None, None, None), 20: (None, 1.5, 1, None), 30: (None, None, 2, "c")}
    expected = {(i, *wide.get(i, (None,) * 4)) for i in [*range(4), 10, 11, 20, 21, 30]}

    def found(store, version):
        return {tuple(r) for r in store.read(version).select("id", "extra", "score", "s.a", "s.c").collect()}

    for order in list(permutations(parts))[::5]:
        store = ShardStore(spark, scratch(spark, "test"))
        for name in order:
            store.append(parts[name])
        before = store.versions()[-1]
        assert found(store, before) == expected
        after = store.compact_fully()
        assert after > before and found(store, after) == expected and found(store, before) == expected


def test_an_append_without_rows_adds_no_shard(spark):
    store = ShardStore(spark, scratch(spark, "test"))
    store.append(spark.range(10).where("id < 5").repartition(3))
    shards = store.shards()
    assert sum(s.n_rows for s in shards) == 5
    assert store.append(spark.range(0)) == 2 and store.shards() == shards


def test_another_type_is_refused(spark):
    store = ShardStore(spark, scratch(spark, "test"))
    store.append(spark.range(3))
    with pytest.raises(SchemaConflict, match="id"):
        store.append(spark.createDataFrame([("x",)], "id string"))
    assert store.versions() == [1]


def test_vacuum(spark):
    store = ShardStore(spark, scratch(spark, "test"))
    for i in range(5):
        store.append(spark.range(10).withColumn("text", F.lit("x" * i)).coalesce(1))
    after = store.compact_fully()
    spark.range(3).coalesce(1).write.parquet(f"{store.root}/data/lost")
    assert store.vacuum() == 0 and store.read(1).count() == 10
    assert store.vacuum(seconds=-60) >= 6
    assert store.versions() == [after] and store.read().count() == 50 and store.vacuum(seconds=-60) == 0


def test_an_append_writes_its_own_lines_only(spark, monkeypatch):
    from quadrille.llm import sharding

    monkeypatch.setattr(sharding, "FULL_EVERY", 4)
    store = ShardStore(spark, scratch(spark, "test"), fanin=100)
    for i in range(11):
        store.append(spark.range(i, i + 1).coalesce(1) if i != 5 else spark.range(5, 6).withColumn("more", F.lit("x")).coalesce(1))
    lines = [len(store.manifests.read(v)) - 1 for v in store.versions()]
    assert lines == [1, 1, 1, 1, 5, 1, 1, 1, 9, 1, 1]
    for v in store.versions():
        assert sorted(r["id"] for r in store.read(v).collect()) == list(range(v)) and len(store.shards(v)) == v
    with pytest.raises(SchemaConflict):
        store.append(spark.createDataFrame([(1, 2)], "id long, more int"))
    store.vacuum(keep=2, seconds=-60)
    assert store.versions() == [9, 10, 11] and store.read(10).count() == 10 and store.read().where("more = 'x'").count() == 1


def test_the_target_grows_with_the_volume(spark, monkeypatch):
    from quadrille.llm import sharding

    store = ShardStore(spark, scratch(spark, "test"), target_bytes=1)
    for i in range(4):
        store.append(spark.range(50).coalesce(1))
    assert store.compact() is None  # every file is above the target
    monkeypatch.setattr(sharding, "MOST_SHARDS", 1)
    assert store.compact_fully() == 5 and len(store.shards()) == 1 and store.read().count() == 200

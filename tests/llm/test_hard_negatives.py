"""Hard negatives and the tree below them against brute force, and on their defined cases."""

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.llm import hard_negatives as hn
from quadrille.llm.queries import oracle_sql, op12_hard_negatives

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, row string, cell int, score int, windows string"


def plain(rows, low=30, high=90, anchor=10):
    usable = []
    for i, (k, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.append((i, k, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    key = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    out = []
    for i, k, label, v in usable:
        if k is None or k % anchor:
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), k2, j, l2) for j, k2, l2, w in usable if j != i]
        for s, k2, _, _ in sorted((x for x in scores if x[3] == label), key=key)[:5]:
            fit = [x for x in scores if x[3] != label and low * s <= 100 * x[0] <= high * s]
            out += [(k, k2, r, x[1], s, x[0]) for r, x in enumerate(sorted(fit, key=key)[:10], 1)]
    return sorted(out, key=str)


def mined(spark, rows, monkeypatch, bytes_=1 << 12, **options):
    df = spark.createDataFrame([(k, v, l, "r", 1, 2, "w") for k, v, l in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(hn, "PIECE_BYTES", bytes_)
    monkeypatch.setattr(hn.Index.build, "__defaults__", (hn.FIT_ROWS, hn.MOST_CELLS, bytes_))
    return sorted((tuple(r) for r in hn.mine(df, F.col("vec_id") % 10 == 0, **options).collect()), key=str)


def vectors(n, dim, seed, clusters=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return (centres[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32) / dim**0.5, rng.integers(0, 4, n)


def test_many_cells_against_brute_force(spark, monkeypatch):
    v, labels = vectors(700, 8, 1)
    rows = [(i, v[i].tolist(), int(labels[i])) for i in range(700)]
    monkeypatch.setattr(hn, "LEAF_ROWS", 16)
    monkeypatch.setattr(hn, "SLAB", 16)
    found = mined(spark, rows, monkeypatch)
    assert found == plain(rows) and len(found) > 1000


def test_defined_cases(spark, monkeypatch):
    v, labels = vectors(150, 6, 2)
    rows = [(i, v[i].tolist(), int(labels[i])) for i in range(150)]
    rows += [(None, v[3].tolist(), 1), (None, None, 1), (10, None, 2), (20, v[4].tolist(), None), (30, [float("nan")] + [0.0] * 5, 1), (40, [float("inf")] * 6, 1), (50, [None] + [1.0] * 5, 1)]
    rows += [(60, [0.5, 0.25], 3), (70, [], 1), (80, [0.0] * 6, 2), (90, v[9].tolist(), 1), (90, v[9].tolist(), 1), (100, (-v[9]).tolist(), 7)]
    rows += [(1000 + i, v[0].tolist(), i % 3) for i in range(200)]  # a third of all rows is one vector
    assert mined(spark, rows, monkeypatch, 256) == plain(rows)


def test_empty_and_alone(spark, monkeypatch):
    assert mined(spark, [], monkeypatch) == []
    assert mined(spark, [(0, [1.0, 0.0], 1)], monkeypatch) == []
    assert mined(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], monkeypatch) == []
    huge = [(0, [1e30, 1.0], 1), (1, [1e30, 0.0], 1), (2, [100.0, 0.0], 2)]
    assert [r[3] for r in mined(spark, huge, monkeypatch, low=0)] == [2]


def test_query_on_whole_table(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    con.execute(f"create table o as {oracle_sql()['op12_hard_negatives']}")
    df = op12_hard_negatives(spark, SF)
    expected = con.execute(f"select {', '.join(df.columns)} from o").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(expected) and len(expected) == 250


def test_annuli_skip_branches():
    """On rows that lie in groups, most leaves of a piece are never read."""
    v, _ = vectors(4000, 4, 3, clusters=40)
    v /= np.linalg.norm(v, axis=1)[:, None]
    ints = np.floor(256 * v.astype(np.float64)).astype(np.int32)
    reach = float((ints.astype(np.float64) ** 2).sum(1).max())
    n = len(ints)
    packed = {"rows": np.arange(n).tobytes(), "ids": np.arange(n).tobytes(), "labels": np.zeros(n, np.int64).tobytes(), "vecs": ints.tobytes()}
    piece = hn.Piece.unpacked(packed, 4, reach)
    queries = ints[:50]
    slab = hn.Slab(np.arange(50), np.ones(50, np.int64), np.zeros(50, np.int64), queries, np.arange(50), np.zeros(50, np.int64), np.full(50, hn._LOWEST), np.full(50, hn._HIGHEST))
    reads = [0]

    class Counted(np.ndarray):
        def __matmul__(self, other):
            reads[0] += 1
            return np.asarray(self) @ np.asarray(other)

    counted = hn.Piece(**{**piece.__dict__, "vecs": piece.vecs.view(Counted)})
    found = list(counted.visit(slab, np.arange(50), 10, False, reach))
    for i, (q, w, ids, rows, scores) in enumerate(found):
        own = ints[i].astype(np.int64) @ ints.astype(np.int64).T
        assert sorted(scores.tolist(), reverse=True) == sorted((int(x) for j, x in enumerate(own) if j != i), reverse=True)[:10]
    assert reads[0] < 0.4 * 50 * piece.tree.leaves


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 4), st.integers(1, 12), st.integers(0, 1000))
def test_bounds_hold(n, dim, leaf_rows, seed):
    rng = np.random.default_rng(seed)
    points = np.round(rng.normal(size=(n, dim)) * 2)
    tree = hn.grow(points, leaf_rows, seed)
    leaf = tree.place(points)
    assert leaf.max(initial=0) < tree.leaves
    lo, hi = tree.spans(points, leaf)
    queries = rng.normal(size=(5, dim)) * 3
    near, far = tree.bounds(queries, lo, hi)
    d = hn.distances(queries, points)
    for i, of in enumerate(leaf):
        assert (near[:, of] <= d[:, i] + 1e-6).all() and (far[:, of] >= d[:, i] - 1e-6).all()

"""Hard-negative mining: rows of another label whose score lies in a window below the score of an anchor's own positives.

Scores are inner products. Each vector x gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, and each query
a zero there; then the squared distance is |q|^2 + M^2 - 2 * score, so higher scores are nearer and a window of scores is an
annulus around the query. A vantage-point tree over these norm-augmented vectors bounds every branch's distances to a query
from below and above, by the triangle inequality, and so tells which branches an annulus misses.

The tree has two levels. Its top is grown from a sample of at most FIT_ROWS rows and has at most MOST_CELLS cells; all rows
are dealt to the cells. Rows of a cell are dealt by a hash to pieces of about PIECE_BYTES, each with a tree of its own, so a
cell that holds a third of all rows is many pieces. Queries are packed to slabs of up to SLAB, neighbours in the tree
together. A search has two rounds: each query first goes through its own cell; the k-th score found there shrinks its annulus;
then all other pieces that the rest of the annulus meets are visited. Within a piece the leaves are taken nearest first, from
the inner edge of the annulus outwards, until the next is beyond the k best found. Both rounds are exact: nothing is lost.
A task holds one piece and one slab.

Scores are whole numbers: components are rounded down after multiplication by SCALE.

Defined cases: a row with a null label, a null vector, or a null or non-finite component takes no part; vectors shorter than
the longest are filled up with zeros; components beyond COMPONENT_BOUND steps count as that bound, so that scores fit a long;
of rows with equal keys each is a row of its own; a null key comes last in ties; an anchor without other rows of its label, or
without rows in a window, has no result there; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import materialize

SCALE, COMPONENT_BOUND = 256, 1 << 20
#: Rows that the top of the tree is grown from, and its cells, at most; bytes of a piece's vectors; queries of a slab.
FIT_ROWS, MOST_CELLS, PIECE_BYTES, SLAB = 16_384, 1024, 1 << 20, 4096
#: Rows of a leaf within a piece; levels of a tree; relative error of a distance.
LEAF_ROWS, DEPTH, ERROR = 256, 40, 1e-6
_NO_KEY, _LOWEST, _HIGHEST = (1 << 63) - 1, -(1 << 62), 1 << 62


# The tree


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def augmented(vectors: np.ndarray, reach: float) -> np.ndarray:
    v = vectors.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(0, reach - (v * v).sum(1)))[:, None]])


@dataclass(frozen=True)
class Tree:
    """Nodes with a vantage point, a radius and two children (inside, outside); a child below 0 is the leaf ~child. `paths`
    has the nodes above each leaf, filled up with -1. Leaves are numbered from left to right, so near ones are neighbours."""

    vantages: np.ndarray
    radii: np.ndarray
    children: np.ndarray
    paths: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.paths)

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of every point."""
        leaf = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))] if len(self.radii) else []
        while todo:
            node, rows = todo.pop()
            inside = distances(points[rows], self.vantages[node : node + 1])[:, 0] <= self.radii[node]
            for child, own in zip(self.children[node], (rows[inside], rows[~inside]), strict=True):
                if child < 0:
                    leaf[own] = ~child
                elif len(own):
                    todo.append((int(child), own))
        return leaf

    def spans(self, points: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest distance of each leaf's points to the vantage points above it."""
        lo, hi = np.full(self.paths.shape, -np.inf), np.full(self.paths.shape, np.inf)
        for i, path in enumerate(self.paths):
            nodes, own = path[path >= 0], points[leaf == i]
            if not len(own):
                lo[i], hi[i] = np.inf, -np.inf
            elif len(nodes):
                d = distances(own, self.vantages[nodes])
                lo[i, : len(nodes)], hi[i, : len(nodes)] = d.min(0), d.max(0)
        return lo, hi

    def bounds(self, queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds from below and above of each query's distances to each leaf's points."""
        n = len(queries)
        if not len(self.radii):
            return np.full((n, 1), lo.max(initial=0)), np.full((n, 1), np.inf)
        at = distances(queries, self.vantages)[:, self.paths]
        return np.maximum(0, np.maximum(lo - at, at - hi).max(2)), np.where(hi < lo, -np.inf, at + hi).min(2)


def grow(points: np.ndarray, leaf_rows: int, seed: int = 0) -> Tree:
    """A tree whose leaves have about `leaf_rows` of the points; equal points share a leaf, however many they are."""
    rng = np.random.default_rng(seed)
    vantages, radii, children, paths = [], [], [], []

    def split(rows: np.ndarray, path: list[int]) -> tuple[np.ndarray, float, np.ndarray] | None:
        if len(rows) <= leaf_rows or len(path) >= DEPTH:
            return None
        tried, seen = (points[rng.choice(rows, min(n, len(rows)), replace=False)] for n in (8, 64))
        vantage = tried[distances(tried, seen).std(1).argmax()]
        d = distances(points[rows], vantage[None])[:, 0]
        radius = np.median(d)
        return (vantage, float(radius), d <= radius) if (d > radius).any() else None

    todo: list[tuple[np.ndarray, list[int], tuple[int, int] | None]] = [(np.arange(len(points)), [], None)]
    while todo:
        rows, path, link = todo.pop()
        cut = split(rows, path)
        if link:
            children[link[0]][link[1]] = len(radii) if cut else ~len(paths)
        if cut is None:
            paths.append(path)
            continue
        node = len(radii)
        vantages.append(cut[0])
        radii.append(cut[1])
        children.append([0, 0])
        todo += [(rows[~cut[2]], [*path, node], (node, 1)), (rows[cut[2]], [*path, node], (node, 0))]
    deep = max(map(len, paths))
    padded = np.array([p + [-1] * (deep - len(p)) for p in paths], np.int64).reshape(len(paths), deep)
    return Tree(np.array(vantages).reshape(-1, points.shape[1]), np.array(radii), np.array(children, np.int64).reshape(-1, 2), padded)


# Rows, pieces and slabs


def usable(df: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(row, id, label, vec array<int>) of the rows that take part; `row` is unique once it is written down."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).where(~bad)
    step = lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(COMPONENT_BOUND)), F.lit(-COMPONENT_BOUND)).cast("int")
    return rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("id"), F.col(label).cast("long").alias("label"), F.transform(v, step).alias("vec"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int32)
    for i, v in enumerate(column):
        own = v.values.to_numpy(zero_copy_only=False)
        out[i, : len(own)] = own
    return out


def _ints(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


_PIECE = "cell int, piece int, lo array<double>, hi array<double>, rows binary, ids binary, labels binary, vecs binary"


@dataclass(frozen=True)
class Index:
    """All rows of a table in pieces: (cell, piece, distances to the top's vantage points, packed rows)."""

    pieces: DataFrame
    top: Tree
    lo: np.ndarray
    hi: np.ndarray
    dim: int
    reach: float

    @staticmethod
    def build(rows: DataFrame, fit_rows: int = FIT_ROWS, most_cells: int = MOST_CELLS, piece_bytes: int = PIECE_BYTES) -> Index:
        """`rows` as usable() gives them, written down. The top is grown from a sample of at most `fit_rows`; every row is indexed."""
        norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        n, dim, reach = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(norm)).first()
        dim, reach = max(1, dim or 0), reach or 0.0
        share = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, fit_rows / max(n, 1)))
        sample = _matrix(rows.where(share).select("vec").limit(fit_rows).toArrow()["vec"], dim)
        each = max(64, piece_bytes // (4 * dim))
        cells = min(most_cells, max(1, -(-n // each)))
        top = grow(augmented(sample, reach), max(1, -(-len(sample) // cells))) if len(sample) else grow(np.zeros((1, dim + 1)), 1)
        shared = rows.sparkSession.sparkContext.broadcast(top)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = shared.value.place(augmented(_matrix(b.column("vec"), dim), reach))
                yield pa.record_batch([pa.array(cell.astype(np.int32)), *b.columns], ["cell", *b.schema.names])

        dealt = materialize(rows.mapInArrow(placed, "cell int, row long, id long, label long, vec array<int>"), "cells")
        sizes = {r["cell"]: r["n"] for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        parts = F.element_at(F.split(F.lit(",".join(str(-(-sizes.get(c, 1) // each)) for c in range(top.leaves))), ","), F.col("cell") + 1).cast("long")

        def pack(key: tuple, t: pa.Table) -> pa.Table:
            tree, cell = shared.value, key[0].as_py()
            vecs = _matrix(t["vec"], dim)
            points = augmented(vecs, reach)
            path = tree.paths[cell][tree.paths[cell] >= 0]
            d = distances(points, tree.vantages[path]) if len(path) else np.zeros((1, 0))
            packed = [_ints(t[c]).tobytes() for c in ("row", "id", "label")]
            columns = [[cell], [key[1].as_py()], [d.min(0).tolist()], [d.max(0).tolist()], *([x] for x in packed), [vecs.tobytes()]]
            return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 2, *[pa.binary()] * 4), strict=True)], ["cell", "piece", "lo", "hi", "rows", "ids", "labels", "vecs"])

        pieced = dealt.withColumn("piece", F.pmod(F.xxhash64("row", F.lit(7)), parts).cast("int"))
        pieces = materialize(pieced.groupBy("cell", "piece").applyInArrow(pack, _PIECE), "pieces")
        lo, hi = np.full(top.paths.shape, -np.inf), np.full(top.paths.shape, np.inf)
        lo[[c for c in range(top.leaves) if c not in sizes]], hi[[c for c in range(top.leaves) if c not in sizes]] = np.inf, -np.inf
        along = pieces.select("cell", F.posexplode(F.arrays_zip("lo", "hi")).alias("at", "d")).groupBy("cell", "at").agg(F.min("d.lo").alias("lo"), F.max("d.hi").alias("hi"))
        for r in along.collect():  # a row for each cell and level of the top
            lo[r["cell"], r["at"]], hi[r["cell"], r["at"]] = r["lo"], r["hi"]
        return Index(pieces, top, lo, hi, dim, reach)

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(query, window, id, row, score): the k best rows of each window of each query, whose label is the query's own
        (`same`, without the query's own row) or another one. Queries are (row, label, vec, windows), with windows
        array<struct<window int, low long, high long>> of scores; better is a higher score, then a smaller id."""
        homed = materialize(self._homed(queries), "queries")
        first = materialize(self._round(homed, k, same, True), "first")
        best = _best(first, k)
        full = best.groupBy("query", "window").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") == k)
        known = full.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "low"))).alias("known"))
        low = lambda w: F.greatest(w["low"], F.coalesce(F.element_at(F.col("known"), w["window"]), w["low"]))
        shrunk = F.transform("windows", lambda w: F.struct(w["window"].alias("window"), low(w).alias("low"), w["high"].alias("high")))
        narrowed = homed.join(known, homed["row"] == known["query"], "left").withColumn("windows", shrunk).select(*homed.columns)
        return _best(first.unionByName(self._round(narrowed, k, same, False)), k)

    def _homed(self, queries: DataFrame) -> DataFrame:
        """The queries with their own cell and slab: cells from left to right until a slab is full, large cells split."""
        shared, dim, reach = queries.sparkSession.sparkContext.broadcast(self.top), self.dim, self.reach

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                home = shared.value.place(augmented(_matrix(b.column("vec"), dim), reach))
                yield pa.record_batch([pa.array(home.astype(np.int32)), *b.columns], ["home", *b.schema.names])

        chosen = queries.select("row", "label", "vec", "windows").where(F.size("windows") > 0)
        homed = materialize(chosen.mapInArrow(placed, f"home int, row long, label long, vec array<int>, windows {_WINDOWS}"), "homed")
        sizes = {r["home"]: r["n"] for r in homed.groupBy("home").agg(F.count("*").alias("n")).collect()}
        slabs, slab, held = {}, 0, 0
        for cell in sorted(sizes):
            if held and held + sizes[cell] > SLAB:
                slab, held = slab + 1, 0
            parts = -(-sizes[cell] // SLAB)
            slabs[cell] = (slab, parts)
            slab, held = (slab, held + sizes[cell]) if parts == 1 else (slab + parts, 0)
        listed = lambda i: F.split(F.lit(",".join(str(slabs.get(c, (0, 1))[i]) for c in range(self.top.leaves))), ",")
        own = lambda i: F.element_at(listed(i), F.col("home") + 1).cast("long")
        return homed.withColumn("slab", own(0) + F.pmod(F.xxhash64("row", F.lit(3)), own(1)))

    def _round(self, homed: DataFrame, k: int, same: bool, first: bool) -> DataFrame:
        """The first round looks into each query's own cell, the second into all other pieces that its annulus meets."""
        dim, reach = self.dim, self.reach
        shared = homed.sparkSession.sparkContext.broadcast((self.top, self.lo, self.hi))

        def pack(t: pa.Table) -> pa.Table:
            windows = t["windows"].combine_chunks()
            flat = windows.flatten()
            of = np.repeat(np.arange(len(windows)), np.diff(windows.offsets.to_numpy()))
            packed = [_ints(t[c]).tobytes() for c in ("row", "label", "home")] + [_matrix(t["vec"], dim).tobytes(), of.tobytes()]
            packed += [flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("window", "low", "high")]
            return pa.table([pa.array([t["slab"][0].as_py()]), *[pa.array([x], pa.binary()) for x in packed]], ["slab", *_SLAB_COLUMNS])

        slabs = materialize(homed.groupBy("slab").applyInArrow(pack, "slab long, " + ", ".join(f"{c} binary" for c in _SLAB_COLUMNS)), "slabs")

        def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top, lo, hi = shared.value
            for b in batches:
                for i in range(b.num_rows):
                    s = Slab.unpacked({c: b.column(c)[i].as_buffer() for c in _SLAB_COLUMNS}, dim)
                    cells = np.unique(s.home) if first else np.flatnonzero(s.met(top, lo, hi, reach))
                    yield pa.record_batch([pa.array([b.column("slab")[i].as_py()] * len(cells), pa.int64()), pa.array(cells.astype(np.int32))], ["slab", "cell"])

        pairs = slabs.mapInArrow(meets, "slab long, cell int").join(self.pieces.select("cell", "piece"), "cell")
        pairs = materialize(pairs, "pairs")
        left = self.pieces.drop("lo", "hi").join(pairs, ["cell", "piece"])
        right = slabs.join(pairs, "slab")

        def visit(pieces: pa.Table, found: pa.Table) -> pa.Table:
            piece = Piece.unpacked({c: pieces[c][0].as_buffer() for c in ("rows", "ids", "labels", "vecs")}, dim, reach)
            slab = Slab.unpacked({c: found[c][0].as_buffer() for c in _SLAB_COLUMNS}, dim)
            here = slab.home == pieces["cell"][0].as_py()
            made = [np.concatenate(c) for c in zip(*piece.visit(slab, np.flatnonzero(here if first else ~here), k, same, reach), strict=True)]
            return pa.table([pa.array(c.astype(np.int64)) for c in made] or [pa.array([], pa.int64())] * 5, ["query", "window", "id", "row", "score"])

        by = ("slab", "cell", "piece")
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(visit, "query long, window long, id long, row long, score long")


_WINDOWS = "array<struct<window: int, low: bigint, high: bigint>>"
_SLAB_COLUMNS = ["rows", "labels", "home", "vecs", "of", "windows", "low", "high"]


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query and window; Spark keeps k of each before the shuffle too."""
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Slab:
    """Some queries; window j belongs to query of[j]."""

    rows: np.ndarray
    labels: np.ndarray
    home: np.ndarray
    vecs: np.ndarray
    of: np.ndarray
    windows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def unpacked(packed: dict, dim: int) -> Slab:
        read = {c: np.frombuffer(b, np.int32 if c == "vecs" else np.int64) for c, b in packed.items()}
        return Slab(**read | {"vecs": read["vecs"].reshape(-1, dim)})

    def annuli(self, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(points, inner, outer): the queries' points, and radii of each window, widened by the error of a distance."""
        points = np.hstack([self.vecs.astype(np.float64), np.zeros((len(self.rows), 1))])
        own = (points * points).sum(1)
        slack = ERROR * (np.sqrt(own) + np.sqrt(reach))[self.of]
        radius = lambda score: np.sqrt(np.maximum(0, own[self.of] + reach - 2 * score.astype(np.float64)))
        return points, np.maximum(0, radius(self.high) - slack), radius(self.low) + slack

    def widest(self, inner: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The annulus around all windows of each query."""
        least, most = np.full(len(self.rows), np.inf), np.full(len(self.rows), -np.inf)
        np.minimum.at(least, self.of, inner)
        np.maximum.at(most, self.of, outer)
        return least, most

    def met(self, top: Tree, lo: np.ndarray, hi: np.ndarray, reach: float, step: int = 256) -> np.ndarray:
        """Whether some query's annulus meets each cell, other than the query's own."""
        points, inner, outer = self.annuli(reach)
        least, most = self.widest(inner, outer)
        found = np.zeros(top.leaves, bool)
        for a in range(0, len(points), step):
            near, far = top.bounds(points[a : a + step], lo, hi)
            hit = (near <= most[a : a + step, None]) & (far >= least[a : a + step, None])
            hit[np.arange(len(hit)), self.home[a : a + step]] = False
            found |= hit.any(0)
        return found


@dataclass(frozen=True)
class Piece:
    """Some rows in the order of the leaves of their own tree."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vecs: np.ndarray
    tree: Tree
    ends: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @staticmethod
    def unpacked(packed: dict, dim: int, reach: float) -> Piece:
        rows, ids, labels = (np.frombuffer(packed[c], np.int64) for c in ("rows", "ids", "labels"))
        vecs = np.frombuffer(packed["vecs"], np.int32).reshape(-1, dim)
        points = augmented(vecs, reach)
        tree = grow(points, LEAF_ROWS)
        leaf = tree.place(points)
        order = np.argsort(leaf, kind="stable")
        ends = np.searchsorted(leaf[order], np.arange(tree.leaves + 1))
        # Sums of products of whole numbers are exact in doubles up to this length, and matrix products are fast there.
        exact = np.float64 if dim * COMPONENT_BOUND**2 <= 1 << 53 else np.int64
        return Piece(rows[order], ids[order], labels[order], vecs[order].astype(exact), tree, ends, *tree.spans(points, leaf))

    def visit(self, slab: Slab, chosen: np.ndarray, k: int, same: bool, reach: float) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, window, id, row, score) arrays: what may be among the k best of the windows of the chosen queries."""
        if not len(chosen):
            return
        points, inner, outer = slab.annuli(reach)
        least, most = slab.widest(inner, outer)
        near, far = self.tree.bounds(points[chosen], self.lo, self.hi)
        starts = np.searchsorted(slab.of, np.arange(len(slab.rows) + 1))
        slack = ERROR * (np.sqrt((points * points).sum(1)) + np.sqrt(reach))
        for i, q in enumerate(chosen):
            windows = range(starts[q], starts[q + 1])
            best: list[np.ndarray] = [np.empty(0, np.int64)] * len(windows)
            best_scores: list[np.ndarray] = [np.empty(0, np.int64)] * len(windows)
            low, high, out = slab.low[starts[q] : starts[q + 1]].copy(), slab.high[starts[q] : starts[q + 1]], outer[starts[q] : starts[q + 1]].copy()
            query, own = slab.vecs[q].astype(self.vecs.dtype), float(points[q] @ points[q])
            for leaf in np.argsort(np.maximum(near[i], least[q]), kind="stable"):
                if near[i, leaf] > out.max():
                    break
                if far[i, leaf] < least[q]:
                    continue
                a, b = self.ends[leaf], self.ends[leaf + 1]
                scores = (self.vecs[a:b] @ query).astype(np.int64)
                fit = (self.labels[a:b] == slab.labels[q]) == same
                fit &= (scores >= low.min()) & (self.rows[a:b] != slab.rows[q])
                at = np.flatnonzero(fit)
                if not len(at):
                    continue
                found = scores[at]
                for w in range(len(windows)):
                    take = (found >= low[w]) & (found <= high[w])
                    if not take.any():
                        continue
                    rows, values = np.concatenate([best[w], at[take] + a]), np.concatenate([best_scores[w], found[take]])
                    if len(rows) > k:
                        kept = np.lexsort((self.rows[rows], self.ids[rows], -values))[:k]
                        rows, values = rows[kept], values[kept]
                    best[w], best_scores[w] = rows, values
                    if len(rows) == k:
                        low[w] = max(low[w], values.min())
                        out[w] = np.sqrt(max(0.0, own + reach - 2.0 * float(low[w]))) + slack[q]
            for w, j in enumerate(windows):
                if n := len(best[w]):
                    yield np.repeat(slab.rows[q], n), np.repeat(slab.windows[j], n), self.ids[best[w]], self.rows[best[w]], best_scores[w]


# The operator


def _floor_div(a: Column, by: int) -> Column:
    return F.floor(a.cast("decimal(20,0)") / F.lit(by).cast("decimal(5,0)")).cast("long")


def mine(
    df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that meets `anchors` (a
    condition on the key), its first `positives` other rows of the same label, and for each of them the first `negatives`
    rows of other labels whose score is from `low` to `high` percent of the positive's."""
    chosen = df.select(key, vector, label)
    rows = materialize(usable(chosen, key, vector, label, scale), "vectors")
    index = Index.build(rows)
    is_anchor = F.when(F.col("id") != _NO_KEY, F.col("id")).alias(key)
    asked = rows.select("*", is_anchor).where(anchors).select("row", "id", "label", "vec")
    every = F.array(F.struct(F.lit(0).alias("window"), F.lit(_LOWEST).cast("long").alias("low"), F.lit(_HIGHEST).cast("long").alias("high")))
    own = index.search(asked.withColumn("windows", every), positives, same=True)
    own = materialize(own.select(F.col("query"), F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    bounds = F.struct("window", (-_floor_div(-low * F.col("positive_score"), 100)).alias("low"), _floor_div(high * F.col("positive_score"), 100).alias("high"))
    windows = own.select("query", bounds.alias("w")).where("w.low <= w.high").groupBy("query").agg(F.sort_array(F.collect_list("w")).alias("windows"))
    against = index.search(asked.join(windows, asked["row"] == windows["query"]).select("row", "label", "vec", "windows"), negatives, same=False)
    named = lambda c: F.when(F.col(c) != _NO_KEY, F.col(c)).alias(c)
    found = against.select("query", F.col("window").cast("int").alias("window"), F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    anchored = asked.select(F.col("row").alias("query"), F.col("id").alias("anchor_id"))
    joined = reduce(lambda a, b: a.join(b[0], b[1]), [(own, ["query", "window"]), (anchored, "query")], found)
    return joined.select(*map(named, ("anchor_id", "positive_id")), "rank", named("negative_id"), "positive_score", "negative_score")

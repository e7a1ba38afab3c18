"""Approximate nearest neighbours by inner product: stable projections, a kd-tree over them, and a chi-square stopping test.

1. Largest inner product becomes least Euclidean distance by one more coordinate that lifts all vectors of one length to one norm. Gaussian (2-stable)
   projections to DIMENSIONS coordinates keep each squared distance up to a chi-square factor with that many degrees of freedom.
2. One kd-tree of projections covers the whole table: its splits are medians of a sample of at most SAMPLE rows, every row goes down to its cell, and
   cells hold about CELL rows (beyond MOST_CELLS of them, cells are split by a hash of the vector). Within a cell a finer kd-tree orders the rows.
3. A query takes projected neighbours one after another, nearest first, and verifies each by the exact inner product on the original vector. It stops once
   ``chi2_cdf(next projected distance / k-th exact distance)`` reaches the confidence: a nearer vector would by then have been met with at least that probability.
   First it does so in its own cell; the k-th distance found there says which other cells the test leaves open, and these are searched in a second
   round. Nothing caps candidates: on data without near neighbours the test lets a query verify many.

Equal vectors stand for one point with their k + 1 least ids, which is exact for k results apart from the query: a vector that fills a third of
the table costs that many rows, cut before the shuffle. A cell's queries are dealt in blocks, and only a cell with queries in several blocks is repeated.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id. Vectors of different length are
never compared. Repeated rows are one query and one candidate; several vectors under one id are queries apart, ranked apart, and never each other's neighbour; of several
candidates under one id the nearest counts. Very long vectors are taken whole. Scores are correctly rounded sums, so that ties do not depend on the place of a row. Empty
tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import cache
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

NEAREST, DIMENSIONS, LEAF, CONFIDENCE = 20, 24, 32, 0.9
#: Rows in a cell, queries in a block, cells of a tree at most, rows of the sample at most.
CELL, QUERY_BLOCK, MOST_CELLS, SAMPLE = 16_384, 4096, 4096, 65_536
#: Projected neighbours after which the test is made anew.
RINGS = (64, 256, 1024, 4096, 16_384)

#: Squared distances below this share of the largest squared norm are rounding.
NIL = 1e-10


def chi2_cdf(x: np.ndarray | float, freedom: int = DIMENSIONS) -> np.ndarray | float:
    """Chi-square distribution for an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for j in range(1, freedom // 2):
        term = term * half / j
        total = total + term
    return 1 - np.exp(-half) * total


@cache
def stops_at(confidence: float, freedom: int) -> float:
    """The ratio of projected to exact distance from which on the test holds."""
    low, high = 0.0, 1e4
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if chi2_cdf(mid, freedom) >= confidence else (mid, high)
    return high


def projection(length: int, dims: int) -> np.ndarray:
    """[coordinate of the lifted vector, projected coordinate]."""
    return np.random.Generator(np.random.PCG64(length)).standard_normal((length + 1, dims))


def projected(vectors: np.ndarray, top: float, dims: int) -> np.ndarray:
    """Projections of vectors lifted to squared norm top; rounded, so that equal vectors of different batches agree."""
    p = projection(vectors.shape[1], dims)
    points = vectors @ p[:-1] + np.sqrt(np.maximum(top - (vectors**2).sum(axis=1), 0))[:, None] * p[-1]
    unit = np.sqrt(top) * 1e-7 or 1.0
    return np.round(points / unit) * unit


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Index arrays of the leaves: halves at the median of the widest coordinate."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            out.append(own)
            continue
        axis = int(np.argmax(np.ptp(points[own], axis=0)))
        order = own[np.argsort(points[own, axis], kind="stable")]
        todo += (order[len(own) // 2 :], order[: len(own) // 2])
    return out


class Cells:
    """The top of the kd-tree over vectors of one length: splits from a sample, boxes that cover all of space."""

    def __init__(self, sample: np.ndarray, cells: int, top: float, dims: int, salts: int = 1):
        self.top, self.dims, self.salts, self.splits = top, dims, salts, []
        boxes = [(np.arange(len(sample)), np.full(dims, -np.inf), np.full(dims, np.inf))]
        while len(boxes) < cells and max(len(b[0]) for b in boxes) > 1:
            k = max(range(len(boxes)), key=lambda b: len(boxes[b][0]))
            own, low, high = boxes[k]
            axis = int(np.argmax(np.ptp(sample[own], axis=0)))
            at = float(np.median(sample[own, axis]))
            left = sample[own, axis] < at
            if not left.any():
                break
            self.splits.append((k, axis, at))
            upper, lower = low.copy(), high.copy()
            upper[axis], lower[axis] = at, at
            boxes[k] = (own[left], low, lower)
            boxes.append((own[~left], upper, high))
        self.low, self.high = np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes])

    def of(self, points: np.ndarray) -> np.ndarray:
        """Each point's cell. The n-th split opens cell n + 1."""
        cell = np.zeros(len(points), np.int32)
        for n, (k, axis, at) in enumerate(self.splits):
            cell[(cell == k) & (points[:, axis] >= at)] = n + 1
        return cell

    def apart(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point to each cell's box."""
        return (np.maximum(np.maximum(self.low - point, point - self.high), 0) ** 2).sum(axis=1)


class Index:
    """One cell: distinct vectors, their least ids, and the kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, dims: int = DIMENSIONS, leaf: int = LEAF, top: float | None = None):
        vectors = np.ascontiguousarray(vectors + 0.0)  # -0.0 equals 0.0
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, inverse = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        by = np.argsort(inverse, kind="stable")
        starts = np.searchsorted(inverse[by], np.arange(len(first) + 1))
        self.ids = [np.unique(ids[by[a:b]])[: k + 1] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.top = float((vectors**2).sum(axis=1).max()) if top is None else top
        points = projected(vectors[first], self.top, dims)
        leaves = kd_leaves(points, leaf)
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])
        self.order = np.concatenate(leaves)
        self.edges = np.r_[0, np.cumsum([len(x) for x in leaves])]
        self.sizes = np.diff(self.edges)
        self.points, self.vectors = np.ascontiguousarray(points[self.order]), np.ascontiguousarray(vectors[first][self.order])
        self.norms = (self.points**2).sum(axis=1)
        self.k, self.dims, self.project = k, dims, projection(vectors.shape[1], dims)
        self.verified = 0

    def search(self, query_id: int, query: np.ndarray, confidence: float = CONFIDENCE, bound: float = np.inf) -> tuple[list[int], list[float]]:
        """The k nearest found, ties to the lesser id, without the query's own row. bound: squared distance of a k-th neighbour known already."""
        ratio, at = stops_at(confidence, self.dims), query @ self.project[:-1]
        near = (np.maximum(np.maximum(self.low - at, at - self.high), 0) ** 2).sum(axis=1)
        norm, nil = self.top + query @ query, NIL * self.top
        best, far = np.full(0, -np.inf), bound  # far: squared distance of the k-th neighbour so far
        seen, scores = [], []

        def verify(places: np.ndarray) -> None:
            nonlocal best, far
            found = self.vectors[places] @ query
            self.verified += len(places)
            seen.append(places)
            scores.append(found)
            best = np.concatenate([best, found])
            if len(best) > self.k + 1:
                best = np.partition(best, len(best) - self.k - 1)[-self.k - 1 :]
            if len(best) > self.k:
                far = min(far, max(norm - 2 * best.min(), 0.0))

        open_ = np.ones(len(near), bool)
        if far == np.inf:  # the nearest leaves give a first distance
            leaves = np.argsort(near, kind="stable")
            leaves = leaves[: np.searchsorted(np.cumsum(self.sizes[leaves]), 4 * self.k) + 1]
            open_[leaves] = False
            verify(np.flatnonzero(np.repeat(~open_, self.sizes)))
        # projected neighbours in rings, nearest first, until none is left that the test leaves open
        places = np.flatnonzero(np.repeat(open_ & (near <= ratio * far + nil), self.sizes))
        gaps = (self.norms - 2 * (self.points @ at) + at @ at)[places]
        inside = gaps <= ratio * far + nil
        places, gaps = places[inside], gaps[inside]
        rings = [r for r in RINGS if r < len(places)]
        order = np.argpartition(gaps, rings) if rings else np.arange(len(places))
        for lo, hi in zip([0, *rings], [*rings, len(places)]):
            own = order[lo:hi][gaps[order[lo:hi]] <= ratio * far + nil]
            if not len(own):
                break
            verify(places[own])
        if not seen:
            return [], []
        places, found = np.concatenate(seen), np.concatenate(scores)
        held = np.flatnonzero(found >= best.min() - 1e-9 * abs(norm))
        pairs = sorted((-fsum((self.vectors[places[h]] * query).tolist()), i) for h in held for i in self.ids[self.order[places[h]]].tolist() if i != query_id)[: self.k]
        return [i for _, i in pairs], [-s for s, _ in pairs]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part. Float components stay float on the way (half the bytes); all reckoning is in double."""
    huge = 1.7976931348623157e308
    v = F.col(vector_col).cast("array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False))).filter(F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) <= huge)) & F.exists("vector", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _norm2():
    return F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda t, x: t + x * x)


def fit(vectors: DataFrame, dims: int = DIMENSIONS, cell: int = CELL, sample: int = SAMPLE) -> dict[int, Cells]:
    """The tree of each vector length, from counts and largest norms of all rows and a sample of at most about ``sample`` of them."""
    shape = vectors.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"), F.max(_norm2()).alias("top")).collect()
    total, fine = sum(r.n for r in shape), 1 << 30
    tops = {r.length: float(r.top) for r in shape}
    share = min(fine, sample * fine // max(1, total))

    def points(batches):
        for batch in batches:
            for length in np.unique(batch.column(1).to_numpy()):
                own = batch.filter(pa.array(batch.column(1).to_numpy() == length))
                p = projected(_matrix(own.column(0)), tops[int(length)], dims)
                yield pa.RecordBatch.from_arrays([pa.array([int(length)] * len(p), pa.int32()), pa.array([x.tobytes() for x in p], pa.binary())], names=["length", "point"])

    chosen = vectors.filter(F.pmod(F.xxhash64("vector", "vec_id"), F.lit(fine)) < share).select("vector", F.size("vector").alias("length"))
    held: dict[int, list] = {r.length: [] for r in shape}
    if total > cell:
        for r in chosen.mapInArrow(points, "length int, point binary").collect():
            held[r.length].append(np.frombuffer(r.point))
    out = {}
    for r in shape:
        own = np.array(held[r.length]).reshape(-1, dims)
        cells = Cells(own, min(-(-r.n // cell), MOST_CELLS, max(1, len(own) // 8)), tops[r.length], dims)
        cells.salts = max(1, -(-r.n // (cell * len(cells.low))))
        out[r.length] = cells
    return out


_DEALT = "length int, cell int, vec_id long, vector {}"


def _deal(trees, open_cells: bool, ratio: float, dims: int):
    """Rows to their cells; open_cells: queries with a bound (third column) to the other cells that the test leaves open."""

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column(1).combine_chunks().offsets.to_numpy() if isinstance(batch.column(1), pa.ChunkedArray) else batch.column(1).offsets.to_numpy())
            for length in np.unique(sizes):
                own = batch.filter(pa.array(sizes == length))
                tree: Cells = trees.value[int(length)]
                vectors = _matrix(own.column(1))
                if not open_cells:
                    rows, cell = np.arange(len(vectors)), tree.of(projected(vectors, tree.top, dims))
                else:
                    points, home = vectors @ projection(int(length), dims)[:-1], own.column("cell").to_numpy()
                    bounds, found = own.column("bound").to_numpy(), []
                    for p, h, b in zip(points, home, bounds, strict=True):
                        apart = tree.apart(p)
                        hit = apart <= ratio * b + NIL * tree.top
                        hit[h] = False
                        found.append(np.flatnonzero(hit))
                    rows, cell = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int32)
                columns = [pa.array(np.full(len(rows), length, np.int32)), pa.array(cell), own.column(0).take(pa.array(rows)), own.column(1).take(pa.array(rows))]
                names = ["length", "cell", "vec_id", "vector"]
                if open_cells:
                    columns.append(own.column("bound").take(pa.array(rows)))
                    names.append("bound")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


_FOUND = "query_id long, query_key long, bound double, vec_id long, score double"


def _search(trees, k: int, dims: int, leaf: int, confidence: float):
    def run(table: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [], [])
        asks = table["asks"].to_numpy(zero_copy_only=False)
        if asks.any() and not asks.all():
            ids, values = table["vec_id"].to_numpy(), _matrix(table["vector"])
            keys, bounds = table["query_key"].to_numpy(), table["bound"].to_numpy()
            index = Index(ids[~asks], values[~asks], k, dims, leaf, trees.value[values.shape[1]].top)
            for row in np.flatnonzero(asks).tolist():
                found, scores = index.search(int(ids[row]), values[row], confidence, float(bounds[row]))
                for column, value in zip(out, ([int(ids[row])] * len(found), [int(keys[row])] * len(found), [float(bounds[row])] * len(found), found, scores), strict=True):
                    column.extend(value)
        return pa.table({c.split()[0]: pa.array(v, t) for c, v, t in zip(_FOUND.split(", "), out, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()), strict=True)})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, confidence: float = CONFIDENCE, dims: int = DIMENSIONS, leaf: int = LEAF, cell: int = CELL, query_block: int = QUERY_BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each query. Both frames as ``usable`` makes them."""
    spark = vectors.sparkSession
    ratio = stops_at(confidence, dims)
    trees = fit(vectors, dims, cell, sample)
    held = spark.sparkContext.broadcast(trees)
    salts = F.create_map(*[x for length, t in trees.items() for x in (F.lit(length), F.lit(t.salts))]) if trees else F.create_map(F.lit(0), F.lit(1))
    dealt = _DEALT.format(vectors.schema["vector"].dataType.simpleString())
    alike = Window.partitionBy("vector").orderBy("vec_id")  # cut before its shuffle, and repeated rows fall within it
    points = vectors.select("vec_id", "vector", F.dense_rank().over(alike).alias("at")).filter(F.col("at") <= k + 1).dropDuplicates(["vec_id", "vector"])
    points = points.select("vec_id", "vector").mapInArrow(_deal(held, False, ratio, dims), dealt).withColumn("salt", F.pmod(F.xxhash64("vector"), salts[F.col("length")]).cast("int"))
    points = common.checkpoint(points)
    asked = queries.select("vec_id", "vector").dropDuplicates(["vec_id", "vector"]).mapInArrow(_deal(held, False, ratio, dims), dealt)
    asked = common.checkpoint(asked.withColumn("query_key", F.xxhash64("vec_id", "vector")).withColumn("bound", F.lit(float("inf"))))

    def visit(asks: DataFrame) -> DataFrame:
        """The nearest in the cells that queries (with a bound each) are dealt to."""
        asks = common.checkpoint(asks.withColumn("salt", F.explode(F.sequence(F.lit(0), salts[F.col("length")] - 1))))
        blocks = asks.groupBy("length", "cell", "salt").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))
        at = ("length", "cell", "salt")
        there = points.join(blocks, list(at)).select(*at, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "vector", F.lit(0).cast("long").alias("query_key"), F.lit(0.0).alias("bound"), F.lit(False).alias("asks"))
        from_ = asks.join(blocks, list(at)).select(*at, F.pmod("query_key", "blocks").cast("int").alias("block"), "vec_id", "vector", "query_key", "bound", F.lit(True).alias("asks"))
        return there.unionByName(from_).groupBy(*at, "block").applyInArrow(_search(held, k, dims, leaf, confidence), _FOUND)

    own = common.checkpoint(visit(asked))
    # the k-th distance in the own cell decides which others stay open
    top = F.create_map(*[x for length, t in trees.items() for x in (F.lit(length), F.lit(t.top))]) if trees else F.create_map(F.lit(0), F.lit(0.0))
    last = own.groupBy("query_key").agg(F.count("*").alias("n"), F.min("score").alias("last")).filter(F.col("n") >= k)
    told = asked.drop("bound").join(last, "query_key", "left")
    told = told.withColumn("bound", F.coalesce(F.greatest(top[F.col("length")] + _norm2() - 2 * F.col("last"), F.lit(0.0)), F.lit(float("inf"))))
    rest = told.select("vec_id", "vector", "cell", "bound").mapInArrow(_deal(held, True, ratio, dims), dealt + ", bound double").withColumn("query_key", F.xxhash64("vec_id", "vector"))
    found = own.unionByName(visit(rest)).groupBy("query_id", "query_key", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

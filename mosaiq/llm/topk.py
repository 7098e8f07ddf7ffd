"""Exact top-k inner products by dual-tree search over cover trees.

Rows are cut into blocks while they are read, and each block gets a cover tree once, stored with it. A node covers all
points below it by its radius; its children are a net of its points at half that radius: their centres are farther apart
than that, and every point lies within it of its nearest centre. The queries get such trees too. A pair of nodes (Q, R)
is pruned when its bound ``<q, r> + radius_Q |r| + radius_R |q| + radius_Q radius_R`` is below the worst k-th score of
Q's queries. A task goes over the blocks it holds with the scores found so far, so later blocks are pruned harder.

Vectors are integers, floor(scale * x); a bound is a float with slack, so ties are never pruned. Scores of two blocks
are computed in floats where every sum is exact in one, in 64-bit integers where they suffice, and in Python's integers
beyond. Vectors whose components or number of components are large lie in blocks of their own, so only these pay for it.
Query blocks go to the tasks in waves of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import discard, materialise

K = 10
SCALE = 1024
EVERY = 100
BLOCK_ROWS = 2048
#: Bytes of one block's vectors, and of the query blocks that one wave sends to the tasks.
BLOCK_BYTES, WAVE_BYTES = 1 << 21, 1 << 25
#: Rows and queries of a node that isn't divided further, and rows of a piece that is scanned at once.
LEAF, QUERY_LEAF, PIECE = 24, 2, 256
#: Up to this component, and 2 ** 12 of them, products and squares of vectors stay exact in a float: a plain block.
MOST, MOST_DIMS = 1 << 20, 1 << 12
#: Greatest score; larger ones count as it, smaller ones than its negative as that.
MOST_SCORE = (1 << 63) - 1
_BLOCK = "block long, n int, dims int, plain boolean, ids binary, vectors binary, nodes binary, radii binary"


class CoverTree:
    """Points in the order of the tree, and a row for each node: centre (a point), first and last + 1 of its points,
    first and last + 1 of its children; 0, 0 for a leaf. Node 0 is the root."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.ids, self.x, self.f, self.nodes, self.radius = ids, x, x.astype(np.float64), nodes, radius
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((self.f**2).sum(axis=1))
        self.most = float(np.abs(self.f).max(initial=0))

    def exact_rows(self, rows) -> list[list[int]]:
        """These vectors in Python's integers."""
        return [[int(v) for v in self.f[i].tolist()] for i in rows]

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> CoverTree:
        f = x.astype(np.float64)
        plain = np.abs(f).max(initial=0) <= MOST and f.shape[1] <= MOST_DIMS
        square = (f**2).sum(axis=1) if plain else None
        order = np.arange(len(x))
        nodes: list[list[int]] = []
        radius: list[float] = []

        def distances(rows: np.ndarray, centre: int) -> np.ndarray:
            if plain:
                return np.maximum(square[rows] + square[centre] - 2 * (f[rows] @ f[centre]), 0)  # exact
            with np.errstate(over="ignore", invalid="ignore"):
                return ((f[rows] - f[centre]) ** 2).sum(axis=1) * (1 + 1e-9)

        def add(lo: int, hi: int, centre: int) -> None:
            nodes.append([centre, lo, hi, 0, 0])
            radius.append(float(np.sqrt(distances(order[lo:hi], centre).max(initial=0))))

        if len(x):
            add(0, len(x), 0)
        at = 0
        while at < len(nodes):  # children of one node lie next to each other
            centre, lo, hi, _, _ = nodes[at]
            if hi - lo > leaf and radius[at] > 0:
                rows = order[lo:hi].copy()
                near, owner, centres = distances(rows, centre), np.zeros(len(rows), dtype=np.int64), [centre]
                limit = radius[at] ** 2 / 4
                while near.max() > limit:
                    centres.append(int(rows[near.argmax()]))
                    d = distances(rows, centres[-1])
                    closer = d < near
                    owner[closer], near[closer] = len(centres) - 1, d[closer]
                if len(centres) > 1:
                    by = np.argsort(owner, kind="stable")
                    order[lo:hi] = rows[by]
                    ends = lo + np.cumsum(np.bincount(owner, minlength=len(centres)))
                    nodes[at][3:] = [len(nodes), len(nodes) + len(centres)]
                    for a, b, c in zip([lo, *ends[:-1].tolist()], ends.tolist(), centres, strict=True):
                        add(a, b, c)
            at += 1
        place = np.empty(len(x), dtype=np.int64)
        place[order] = np.arange(len(x))
        table = np.array(nodes, dtype=np.int64).reshape(-1, 5)
        table[:, 0] = place[table[:, 0]]
        return cls(ids[order], x[order], table, np.array(radius))


class Search:
    """The k best rows of each query so far: scores, ids (ties to the smaller id)."""

    def __init__(self, queries: CoverTree, k: int):
        self.tree, self.k = queries, k
        self.best = [np.empty((0, 2), dtype=np.int64)] * len(queries.x)
        self.worst = np.full(len(queries.x), -np.inf)  # no pair below it is looked at
        self.scanned = 0  # pairs of a query and a row whose score was computed

    def scores(self, lo: int, hi: int, data: CoverTree, rows: np.ndarray) -> np.ndarray:
        """Exact inner products of queries lo to hi with these rows, but for the ends of MOST_SCORE."""
        largest = self.tree.most * data.most * max(1, self.tree.f.shape[1])
        if largest <= 1 << 53:
            return self.tree.f[lo:hi] @ data.f[rows].T
        if largest < 1 << 62:
            return self.tree.f[lo:hi].astype(np.int64) @ data.f[rows].astype(np.int64).T
        sums = [[sum(a * b for a, b in zip(q, r, strict=True)) for r in data.exact_rows(rows)] for q in self.tree.exact_rows(range(lo, hi))]
        return np.array([[max(-MOST_SCORE, min(MOST_SCORE, s)) for s in row] for row in sums], dtype=np.int64).reshape(hi - lo, len(rows))

    def scan(self, lo: int, hi: int, data: CoverTree, rows: np.ndarray) -> None:
        scores = self.scores(lo, hi, data, rows)
        ids = data.ids[rows]
        self.scanned += scores.size
        better = (scores >= self.worst[lo:hi, None]) & (ids[None, :] != self.tree.ids[lo:hi, None])
        for i in np.flatnonzero(better.any(axis=1)).tolist():
            keep = better[i]
            found = np.concatenate([self.best[lo + i], np.stack([scores[i, keep].astype(np.int64), ids[keep]], axis=1)])
            found = found[np.lexsort((found[:, 1], -found[:, 0]))[: self.k]]
            self.best[lo + i] = found
            if len(found) == self.k:  # a float at most as large
                last = int(found[-1, 0])
                self.worst[lo + i] = float(last) if abs(last) <= 1 << 53 else np.nextafter(float(last), -np.inf)

    def over(self, data: CoverTree) -> None:
        """Take in one block of rows."""
        if not len(data.x) or not len(self.tree.x):
            return
        q, r = self.tree.nodes, data.nodes
        todo = [(0, np.zeros(1, dtype=np.int64))]
        while todo:
            a, b = todo.pop()
            centre, lo, hi, first, last = q[a]
            c, t = r[b, 0], data.radius[b]
            with np.errstate(over="ignore", invalid="ignore"):
                far = self.tree.norm[centre] * data.norm[c]
                top = data.f[c] @ self.tree.f[centre] + self.tree.radius[a] * data.norm[c] + t * self.tree.norm[centre] + self.tree.radius[a] * t
                top += 1e-6 * (np.abs(top) + 1) + 1e-9 * far
            top[np.isnan(top)] = np.inf
            live = top >= self.worst[lo:hi].min()
            b, top = b[live], top[live]
            if not len(b):
                continue
            inner = r[b, 4] > 0
            if last > first:  # the larger side is divided: data nodes first, then the queries' node
                wide = inner & (data.radius[b] >= self.tree.radius[a])
                if wide.any():
                    todo.append((a, np.concatenate([b[~wide], *(np.arange(x, y) for x, y in r[b[wide], 3:])])))
                else:
                    todo += [(k, b) for k in range(first, last)]
                continue
            b = b[np.argsort(-top, kind="stable")]
            if len(b) > 16:  # the most promising nodes come first
                todo += [(a, b[16:]), (a, b[:16])]
                continue
            inner = r[b, 4] > 0
            if inner.any():
                todo.append((a, np.concatenate([np.arange(x, y) for x, y in r[b[inner], 3:]])))
            if not inner.all():
                rows = np.concatenate([np.arange(x, y) for x, y in r[b[~inner], 1:3]])
                for i in range(0, len(rows), PIECE):
                    self.scan(lo, hi, data, rows[i : i + PIECE])


_LARGEST = float(np.finfo(np.float64).max)


def _cut(leaf: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], tuple[list[int], list[np.ndarray]]] = {}  # by number of dimensions and kind
        task, done = TaskContext.get().partitionId(), 0

        def block(dims: int, plain: bool) -> pa.RecordBatch:
            nonlocal done
            ids, rows = held.pop((dims, plain))
            done += 1
            tree = CoverTree.build(np.array(ids, "<i8"), np.concatenate(rows).reshape(len(ids), dims), leaf)
            binary = [pa.array([a.tobytes()], pa.binary()) for a in (tree.ids, tree.x.astype("<i4" if plain else "<f8"), tree.nodes.astype("<i4"), tree.radius.astype("<f8"))]
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | done]), pa.array([len(ids)], pa.int32()), pa.array([dims], pa.int32()), pa.array([plain]), *binary], ["block", "n", "dims", "plain", "ids", "vectors", "nodes", "radii"])

        for b in batches:
            for vec_id, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with np.errstate(over="ignore"):
                    row = np.clip(np.floor(np.array(v.as_py(), dtype=np.float64) * scale), -_LARGEST, _LARGEST)
                kind = len(row), bool(np.abs(row).max(initial=0) <= MOST and len(row) <= MOST_DIMS)
                ids, rows = held.setdefault(kind, ([], []))
                ids.append(vec_id)
                rows.append(row)
                if len(ids) >= min(BLOCK_ROWS, max(1, BLOCK_BYTES // ((4 if kind[1] else 8) * max(1, len(row))))):
                    yield block(*kind)
        for kind in list(held):
            yield block(*kind)

    return run


def _tree(r: dict) -> CoverTree:
    ids, nodes = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["nodes"], "<i4").reshape(-1, 5)
    return CoverTree(ids, np.frombuffer(r["vectors"], "<i4" if r["plain"] else "<f8").reshape(len(ids), r["dims"]), nodes, np.frombuffer(r["radii"], "<f8"))


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple[int, Search]] = []
        for b in batches:
            for i in range(b.num_rows):
                if not open_:
                    open_ = [(q["dims"], Search(_tree(q), k)) for q in shared.value]
                data = b.slice(i, 1).to_pylist()[0]
                tree = _tree(data)
                for dims, s in open_:
                    if dims == data["dims"]:
                        s.over(tree)
        for _, s in open_:
            found = np.concatenate([np.concatenate([np.full((len(f), 1), q), f], axis=1) for q, f in zip(s.tree.ids.tolist(), s.best, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 2]), pa.array(found[:, 1])], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """For each query (row whose vec_id is divisible by `every`): query_id, rank (from 1), vec_id, score of its k best rows.

    vectors: vec_id, embedding. Components become floor(scale * x), x as double, of any size up to the greatest double;
    scores beyond 64 bits count as the ends of that range. Vectors that are null or hold null or non-finite
    components, and rows with null vec_id, take no part. Scores are compared among vectors of equal length; empty
    vectors score 0. A query meets every row but those with its own vec_id; repeated rows are one query but several
    candidates; different query vectors with one vec_id are answered together. Ties go to the smaller vec_id. With
    fewer candidates than k all are returned; without any, no row. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    whole = F.transform("embedding", lambda x: x.cast("double"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    data = materialise(rows.mapInArrow(_cut(LEAF, scale), _BLOCK), "blocks")
    queries = materialise(rows.where(F.col("vec_id") % every == 0).distinct().mapInArrow(_cut(QUERY_LEAF, scale), _BLOCK), "queries")

    # a stated query set against all rows, in blocks: each wave sends query blocks of at most WAVE_BYTES to the tasks
    waves: list[list[int]] = []
    room = 0
    for r in queries.select("block", F.expr("length(ids) + length(vectors) + length(nodes) + length(radii)").alias("size")).orderBy("block").collect():  # two numbers a block
        if not waves or r["size"] > room:
            waves.append([])
            room = WAVE_BYTES
        waves[-1].append(r["block"])
        room -= r["size"]
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for wave in waves:
        shared = spark.sparkContext.broadcast([r.asDict() for r in queries.where(F.col("block").isin(wave)).collect()])  # at most WAVE_BYTES
        found = found.unionByName(materialise(data.mapInArrow(_search(shared, k), "query_id long, vec_id long, score long"), "wave"))
        shared.destroy()
    discard(data, queries)
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

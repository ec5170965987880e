"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are integers (the quantised impacts). Rows lie in blocks with the pivot (one of some rows) that they are nearest
to; a block has a posting list for each dimension, sorted by impact. The impact of a posting on a query is the product of
both components, its quantised impact that product's power of two. A query takes the segments of all dimensions by
descending quantised impact, large losses as well as large gains, and keeps an upper bound of every row's score:

    q . v = (s |q|^2 + |v|^2 / s - |sqrt(s) q - v / sqrt(s)|^2) / 2

for any s > 0, so what the postings read so far take off is final and the rest can only take off more (s makes both
norms alike). After each segment the leading rows are scored exactly, and the k-th best of them is a proven floor: rows whose
bound is less are out. The search stops when scoring all possible members reads fewer components than the next segment has postings, and scores
them exactly. Nothing is left out without that proof.

A query searches its own block first. What it finds there is its floor in all others, and clusters whose rows are too
far from it to reach the floor (by the pivot and the greatest distance from it) don't see the query at all. The other
blocks take queries in chunks, so a task holds one block and one chunk at a time. Blocks' best k meet in a last top-k.

Defined results: vectors that are null or hold null or non-finite components take no part, as queries or candidates, and
neither do rows without an id; shorter vectors count as padded with zeros; rows with one vec_id are all candidates of
other queries, and one query (the least of their vectors); with fewer than k candidates all are returned; ties go to the
smaller vec_id; an empty table gives no rows; other columns are ignored. Products of large components are summed as Python
integers; a score beyond 64 bits is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import cut, ship

BLOCK_ROWS = 8192
CHUNK_QUERIES = 2048
#: Most rows that serve as pivots; they decide where a row lies, not whether it is searched.
PIVOTS = 512
#: Leading rows that are scored for the floor.
FEW = 64


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """v @ q of integers, exactly."""
    most = max((abs(int(x)) for x in (v.min(), v.max())), default=0) * max((abs(int(x)) for x in (q.min(), q.max())), default=0) if v.size and q.size else 0
    return v @ q if most * max(1, len(q)) < 1 << 62 else v.astype(object) @ q.astype(object)


class Block:
    """The impact-ordered index of some rows, and counts of what its searches did."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], vectors[order]
        n, dims = self.v.shape
        by = np.argsort(self.v, axis=0, kind="stable")
        self.rows = by.T.ravel()
        self.values = np.take_along_axis(self.v, by, axis=0).T.ravel().astype(np.float64)
        self.starts = np.arange(dims) * n
        # one key for dimension and impact, so that one search finds the places in all lists
        self.low, self.high = (int(f(self.v)) if self.v.size else 0 for f in (np.min, np.max))
        self.span = self.high - self.low + 2
        whole = self.span * max(1, dims) < 1 << 62
        self.keys = np.repeat(np.arange(dims) * self.span, n) + (np.take_along_axis(self.v, by, axis=0).T.ravel() - self.low) if whole else None
        self.norms = (self.v.astype(np.float64) ** 2).sum(axis=1)
        self.size = math.sqrt(self.norms.mean()) if n else 0.0
        self.most = np.abs(self.v).max(axis=0) if n else np.zeros(dims, np.int64)
        self.searched = self.read = self.rescored = 0

    def places(self, dims: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The first posting of each dimension whose impact is at least `value`."""
        if self.keys is not None:
            at = np.clip(value, self.low, self.high + 1).astype(np.int64) - self.low
            return np.searchsorted(self.keys, dims * self.span + at)
        n = len(self.ids)
        return np.array([s + np.searchsorted(self.values[s : s + n], x) for s, x in zip(self.starts[dims].tolist(), value.tolist(), strict=True)], np.int64)

    def search(self, own: int, q: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and scores of the best k rows but those with the id `own`; rows under `floor` needn't be there."""
        n = len(self.ids)
        mine = slice(*np.searchsorted(self.ids, [own, own + 1]))
        possible = np.arange(n)
        dims = np.flatnonzero(q)
        dims = dims[self.most[dims] > 0]
        self.searched += 1
        if n - (mine.stop - mine.start) > max(k, FEW) and len(dims):
            possible = self.members(mine, dims, q, k, floor)
        possible = possible[self.ids[possible] != own]
        self.rescored += len(possible)
        exact = products(self.v[possible], q)
        best = np.lexsort((self.ids[possible], -exact))[:k]
        return self.ids[possible][best], exact[best]

    def members(self, mine: slice, dims: np.ndarray, q: np.ndarray, k: int, floor: int | None) -> np.ndarray:
        """The rows that can be among the best k, by segments of descending quantised impact."""
        n, w = len(self.ids), q[dims].astype(np.float64)
        size = math.sqrt(float((q.astype(np.float64) ** 2).sum()))
        s = self.size / size  # both norms alike
        bound = (s * size * size + self.norms / s) / 2
        slack = 1e-9 * float(bound.max())
        bound[mine] = -np.inf
        root = math.sqrt(s)
        few = max(k, FEW)
        low, high = self.starts[dims], self.starts[dims] + n  # what is between them is still to read
        level = math.floor(math.log2(float((np.abs(w) * self.most[dims]).max())))
        possible = np.arange(n)
        while True:
            # postings with |w * v| >= 2 ** level, at both ends of their lists; after level 0 all that are left
            least = np.ceil(2.0**level / np.abs(w)) if level >= 0 else np.zeros(len(w))
            up = np.clip(self.places(dims, least), low, high)
            down = np.clip(self.places(dims, 1 - least), low, up)
            todo = int((high - up).sum() + (down - low).sum())
            if todo and len(possible) * len(q) <= todo:  # scoring these rows reads less than the segment
                return possible
            if todo:
                a, b, weight = np.r_[low, up], np.r_[down, high], np.r_[w, w]
                slices = [x for x in zip(a.tolist(), b.tolist(), weight.tolist(), strict=True) if x[1] > x[0]]
                values = np.concatenate([self.values[i:j] for i, j, _ in slices])
                loss = np.repeat([x * root for *_, x in slices], [j - i for i, j, _ in slices]) - values / root
                bound -= np.bincount(np.concatenate([self.rows[i:j] for i, j, _ in slices]), loss * loss / 2, n)
                self.read += todo
                low, high = down, up
                if todo >= n:  # a row has got news of a posting on the average
                    leaders = np.argpartition(bound, n - few)[n - few :]
                    leaders = leaders[bound[leaders] > -np.inf]
                    self.rescored += len(leaders)
                    if len(leaders) >= k:
                        found = int(np.sort(products(self.v[leaders], q))[-k])
                        floor = found if floor is None else max(floor, found)
                if floor is not None:
                    possible = np.flatnonzero(bound + slack >= floor)
            if level < 0:
                return possible
            level -= 1


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """The lists of a column as rows, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), dims), np.int64)
    at = np.repeat(np.arange(len(sizes)) * dims - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    out.ravel()[at] = column.flatten().to_numpy()
    return out


def longest(column: pa.ChunkedArray | pa.Array) -> int:
    return max(column.value_lengths().to_pylist() if isinstance(column, pa.Array) else [x for c in column.chunks for x in c.value_lengths().to_pylist()], default=0)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, q: floor(scale * x) of every component, for the vectors that take part."""
    good = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(good & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("q"))


class Pivots:
    """Where rows lie, and how far from its pivot a cluster reaches."""

    def __init__(self, vectors: list[list[int]]):
        self.dims = max(map(len, vectors), default=0)
        self.p = np.array([[*v, *[0] * (self.dims - len(v))] for v in vectors], np.float64).reshape(len(vectors), self.dims)
        self.half = (self.p**2).sum(axis=1) / 2
        self.radius = np.zeros(len(vectors))
        self.blocks = np.ones(len(vectors), np.int64)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pivot nearest to each row, and its distance (the first `dims` components of a row tell the pivot)."""
        x = v.astype(np.float64)
        p = np.pad(self.p, ((0, 0), (0, x.shape[1] - self.dims))) if x.shape[1] > self.dims else self.p
        at = np.argmax(x @ p.T - self.half, axis=1)
        return at, np.linalg.norm(x - p[at], axis=1)

    def reached(self, v: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """[row, cluster]: whether a row of the cluster can have an inner product with the row of at least its floor."""
        x = v.astype(np.float64)
        near = x[:, : self.dims] @ self.p.T + np.linalg.norm(x, axis=1)[:, None] * self.radius
        return near * (1 + 1e-9 * np.sign(near)) + 1e-6 >= floor[:, None]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every row for which `is_query` (of vec_id) holds, its best k other rows."""
    spark = vectors.sparkSession
    ship(spark)
    rows = quantised(vectors, id_col, vector_col, scale)
    n = rows.count()
    # at most PIVOTS rows come to the driver
    pivots = Pivots([r["q"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(max(1, min(PIVOTS, -(-n // BLOCK_ROWS)))).collect()])
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches):
        for batch in batches:
            at, far = shared.value.nearest(matrix(batch.column("q"), max(shared.value.dims, longest(batch.column("q")))))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), pa.array(at, pa.int32()), pa.array(far)], ["vec_id", "q", "cluster", "far"])

    placed = rows.mapInArrow(place, "vec_id long, q array<long>, cluster int, far double") if n else rows.withColumn("cluster", F.lit(0)).withColumn("far", F.lit(0.0))
    for r in placed.groupBy("cluster").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        pivots.blocks[r["cluster"]], pivots.radius[r["cluster"]] = -(-r["n"] // BLOCK_ROWS), r["far"]
    of = F.array(*[F.lit(int(x)) for x in pivots.blocks]) if len(pivots.blocks) else F.array(F.lit(1))
    block = (F.col("cluster") * F.lit(1 << 32) + F.pmod(F.xxhash64("vec_id", "q"), F.element_at(of, F.col("cluster") + 1))).alias("block")
    lying = placed.select("vec_id", "q", block)
    queries = cut(lying.where(is_query).groupBy("vec_id").agg(F.min(F.struct("q", "block")).alias("x")).select("vec_id", "x.*"))
    parts = max(1, -(-queries.count() // CHUNK_QUERIES))
    bounds = spark.sparkContext.broadcast((pivots.p, pivots.radius, pivots.blocks))

    def search(key, mine: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(mine) and len(asked):
            dims = max(longest(t.column("q")) for t in (mine, asked))
            b = Block(mine.column("vec_id").to_numpy(), matrix(mine.column("q"), dims))
            floors = asked.column("floor").to_pylist()
            for own, q, floor in zip(asked.column("vec_id").to_pylist(), matrix(asked.column("q"), dims), floors, strict=True):
                out.append((np.full(k, own), *b.search(own, q, k, floor)))
        cat = lambda i: np.concatenate([x[i] for x in out]).tolist() if out else []
        ids = cat(1)
        own = [int(x[0][0]) for x in out for _ in range(len(x[1]))]
        return pa.table({"query_id": pa.array(own, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(cat(2), pa.int64())})

    def others(batches):
        p, radius, n_blocks = bounds.value
        of = Pivots([])
        of.p, of.dims, of.radius = p, p.shape[1], radius
        first = np.cumsum(n_blocks) - n_blocks
        names = np.repeat(np.arange(len(p)) << 32, n_blocks) + np.arange(int(n_blocks.sum())) - np.repeat(first, n_blocks)
        cluster = np.repeat(np.arange(len(p)), n_blocks)
        for whole in batches:
            for i in range(0, len(whole), 64):
                batch = whole.slice(i, 64)
                floor = np.array([-np.inf if x is None else float(x) for x in batch.column("floor").to_pylist()])
                v = matrix(batch.column("q"), max(of.dims, longest(batch.column("q"))))
                to = of.reached(v, floor)[:, cluster] & (names != batch.column("block").to_numpy()[:, None])
                row, at = np.nonzero(to)
                at_row = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([at_row.column("vec_id"), at_row.column("q"), pa.array(names[at]), at_row.column("floor")], ["vec_id", "q", "block", "floor"])

    result = "query_id long, vec_id long, score long"
    asked = queries.withColumn("floor", F.lit(None).cast("long"))
    home = cut(lying.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(search, result))
    floors = home.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    again = queries.join(floors, "vec_id", "left").mapInArrow(others, "vec_id long, q array<long>, block long, floor long")
    right = again.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit("chunk")), F.lit(parts)))
    left = lying.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    away = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(search, result)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return home.unionByName(away).withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact top-k by inner product with a dual-tree search over cover trees.

Candidates and queries are dealt into blocks by a hash of their id; each pair of a query block and a candidate block is one group,
and the group builds a cover tree over either side and searches both together. A node covers its points by the measured distance
from its centre to the farthest of them. For a query node (centre q, radius r) and a candidate node (centre p, radius s), no
inner product exceeds q.p + r|p| + s|q| + rs, nor the product of the largest norms. Every pair of nodes, inner ones of either tree
included, is held against the worst kth score of the query node before either is opened; if it can't reach that, the pair is
left out, else the node with the larger radius is split, the most promising parts first. The best k of each block pair are merged by query.

A node whose rows lie equally far from one another, so that centres part none of them, is dealt out in even parts, which keeps the depth
of a tree near the logarithm of its rows. Block sizes bound a group's memory, whatever the number of rows: `query_rows` and `block_rows` vectors.

Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Repeated rows (same id and vector)
count once. Only vectors of the same length are compared; an empty vector scores 0. Rows that share a query's id are its own and no
candidates. A table with no query gives an empty result. Only id and vector are read, so no other column can clash. Where a block's scores could reach 2^53 they are
worked out in whole numbers instead, without a tree; scores over 2^63 do not fit the result and end the query with an error.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.session import ship

LEAF = 1024
FAN_OUT = 12
FOUND = "query_id bigint, vec_id bigint, score bigint"


class Node:
    """Rows of a block, their centre, covering radius and largest norm, and the nodes below."""

    __slots__ = ("rows", "centre", "norm", "radius", "longest", "below", "centres", "norms", "radii", "lengths", "worst")

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: int) -> None:
        self.centre = points[centre]
        self.norm = float(np.linalg.norm(self.centre))
        self.rows, self.below, self.worst = rows, [], -np.inf
        own = points[rows]
        gap = np.linalg.norm(own - self.centre, axis=1)
        self.radius = float(gap.max()) * (1 + 1e-9)
        self.longest = float(np.linalg.norm(own, axis=1).max()) * (1 + 1e-9)
        if len(rows) <= LEAF or self.radius == 0:
            return
        # Farthest-first centres until everything lies within half the radius, or the fan-out is reached.
        owner, chosen = np.zeros(len(rows), np.int64), [centre]
        while len(chosen) < FAN_OUT and gap.max() > self.radius / 2:
            far = int(gap.argmax())
            other = np.linalg.norm(own - own[far], axis=1)
            nearer = other < gap
            owner[nearer], gap[nearer] = len(chosen), other[nearer]
            chosen.append(int(rows[far]))
        if np.bincount(owner).max() > 0.9 * len(rows):
            owner = np.arange(len(rows)) * FAN_OUT // len(rows)
            chosen = [int(rows[np.argmax(owner == i)]) for i in range(FAN_OUT)]
        del own
        self.below = [Node(points, rows[owner == i], c) for i, c in enumerate(chosen)]
        self.centres = np.array([b.centre for b in self.below])
        self.norms, self.radii, self.lengths = (np.array([getattr(b, f) for b in self.below]) for f in ("norm", "radius", "longest"))

    def bounds(self, query: Node) -> np.ndarray:
        """The most that a query of `query` can score with a point of each node below."""
        top = self.centres @ query.centre + query.radius * self.norms + self.radii * query.norm + query.radius * self.radii
        top = np.minimum(top, query.longest * self.lengths)
        return top + 1e-9 * np.abs(top) + 1e-6


class Search:
    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> None:
        self.queries, self.query_ids, self.points, self.ids, self.k = queries, query_ids, points, ids, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.visit(Node(queries, np.arange(len(queries)), 0), Node(points, np.arange(len(points)), 0), np.inf)

    def visit(self, query: Node, node: Node, bound: float) -> None:
        """Search `node` for the queries of `query`, none of which can score over `bound` there."""
        if bound < query.worst:
            self.left_out(query, node)
        elif node.below and (node.radius >= query.radius or not query.below):
            bounds = node.bounds(query)
            for i in np.argsort(-bounds):
                self.visit(query, node.below[i], bounds[i])
        elif query.below:
            for part in query.below:
                part.worst = max(part.worst, query.worst)
                self.visit(part, node, self.between(part, node))
            query.worst = max(query.worst, min(part.worst for part in query.below))
        else:
            self.compare(query, node.rows)

    @staticmethod
    def between(query: Node, node: Node) -> float:
        top = float(query.centre @ node.centre) + query.radius * node.norm + node.radius * query.norm + query.radius * node.radius
        top = min(top, query.longest * node.longest)
        return top + 1e-9 * abs(top) + 1e-6

    def left_out(self, query: Node, node: Node) -> None:
        """Called for each pair of nodes that is not opened."""

    def compare(self, query: Node, rows: np.ndarray) -> None:
        scores = self.queries[query.rows] @ self.points[rows].T
        ids = self.ids[rows]
        scores[self.query_ids[query.rows][:, None] == ids[None, :]] = -np.inf
        good = (scores >= self.scores[query.rows, -1][:, None]) & (scores > -np.inf)
        for i in np.flatnonzero(good.any(axis=1)):
            at, enough = query.rows[i], np.flatnonzero(good[i])
            pool, names = np.concatenate([self.scores[at], scores[i, enough]]), np.concatenate([self.found[at], ids[enough]])
            best = np.lexsort((names, -pool))[:self.k]
            self.scores[at], self.found[at] = pool[best], names[best]
        query.worst = float(self.scores[query.rows, -1].min())


def in_whole_numbers(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, row, score) of the best k for vectors whose scores a double can't hold."""
    out, whole = [], [[int(v) for v in p] for p in points]
    for query_id, query in zip(query_ids.tolist(), queries):
        q = [int(v) for v in query]
        best = heapq.nsmallest(k, ((-sum(x * y for x, y in zip(q, p)), i) for i, p in zip(ids.tolist(), whole) if i != query_id))
        out += [(query_id, i, -score) for score, i in best]
    return out


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, query_rows: int = 16_384, block_rows: int = 8_192,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by `every`: rank, vec_id and score of the `k` best other rows, ties to the smaller id."""
    value = F.col(f"`{vector_col}`").cast("array<double>")
    fit = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), value.alias("raw"))
            .filter(F.col("vec_id").isNotNull() & F.col("raw").isNotNull() & fit)
            .select("vec_id", F.transform("raw", lambda x: F.floor(x * float(scale)).cast("double")).alias("vec"))
            .distinct().withColumn("dim", F.size("vec")))
    asks = F.pmod("vec_id", F.lit(every)) == 0
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(asks, 1))).first()
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-n_queries // query_rows))
    dealt = lambda parts: F.pmod(F.xxhash64("vec_id", "vec"), F.lit(parts)).cast("int")                          # noqa: E731
    candidates = rows.withColumn("b", dealt(blocks)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = rows.filter(asks).withColumn("a", dealt(query_blocks)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows or not held.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        query_ids, q = matrix(asking)
        ids, p = matrix(held)
        if p.shape[1] and np.abs(q).max() * np.abs(p).max() * p.shape[1] >= 2.0 ** 53:
            return pa.table([pa.array(c, pa.int64()) for c in zip(*in_whole_numbers(q, query_ids, p, ids, k))] or [pa.array([], pa.int64())] * 3,
                            ["query_id", "vec_id", "score"])
        done = Search(q, query_ids, p, ids, k)
        real = done.scores > -np.inf
        return pa.table({"query_id": np.repeat(query_ids, real.sum(axis=1)), "vec_id": done.found[real],
                         "score": done.scores[real].astype(np.int64)})

    found = queries.groupBy("dim", "a", "b").cogroup(candidates.groupBy("dim", "a", "b")).applyInArrow(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ship(__name__)

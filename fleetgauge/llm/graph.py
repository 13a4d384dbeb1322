"""Connected components by alternating stars: every round points neighbours at the smallest vertex they know of.

A large star links the larger neighbours of each vertex to the smallest of its neighbourhood, a small star does the same with the
smaller ones; after some rounds, logarithmic in practice, the edges are stars around the smallest vertex of each component. Each
round is a table in the shared folder, minima are taken with partial aggregates, and a vertex with very many edges is split by
adaptive skew joins, since its minimum is a single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import settle


def downhill(pairs: DataFrame) -> DataFrame:
    """(u, v) with u > v, each once."""
    return pairs.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.withColumnRenamed("m", "v"))


def mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(pairs: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of a pair (u, v); the root is the smallest vertex reachable. Null ends are left out."""
    edges = settle(downhill(pairs.filter("u IS NOT NULL AND v IS NOT NULL")))
    before = mark(edges)
    while before[0]:
        edges = settle(downhill(small_star(downhill(large_star(edges)))))
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("vertex"), F.col("v").alias("root")))

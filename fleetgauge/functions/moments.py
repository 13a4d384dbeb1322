"""Means, squares and cross products of all pairs of columns in one scan, each pair over the rows that have both.

A task keeps, for every pair, the number of rows, both means and the centred sums of squares and products, as matrices; batches
are merged into them with the pairwise update, which cancels nothing, and so are the tasks' matrices, row by row. What is
shuffled is a matrix per task, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

# Planes of a state, each (columns, columns): rows, mean of i and of j, sum of squares of i and of j, sum of products.
N, MEAN_I, MEAN_J, SQUARES_I, SQUARES_J, PRODUCTS = range(6)


def of_batch(x: np.ndarray) -> np.ndarray:
    """The state of one batch of rows; missing values are NaN."""
    seen = ~np.isnan(x)
    # Values near 0: the first one of each column is taken off, so that a column that does not vary has sums of exactly 0.
    shift = np.array([column[here][0] if here.any() else 0.0 for column, here in zip(x.T, seen.T)])
    y, mask = np.where(seen, x - shift, 0.0), seen.astype(float)
    n, sums, squares = mask.T @ mask, y.T @ mask, (y * y).T @ mask
    some = np.maximum(n, 1)
    mean = sums / some
    out = np.empty((6, *n.shape))
    out[N], out[MEAN_I], out[MEAN_J] = n, mean + shift[:, None], (mean + shift[:, None]).T
    spread = np.maximum(squares - n * mean * mean, 0.0)
    out[SQUARES_I], out[SQUARES_J], out[PRODUCTS] = spread, spread.T, y.T @ y - n * mean * mean.T
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[N] + b[N]
    share = b[N] / np.maximum(n, 1)
    di, dj = b[MEAN_I] - a[MEAN_I], b[MEAN_J] - a[MEAN_J]
    weight = a[N] * share
    return np.stack([n, a[MEAN_I] + di * share, a[MEAN_J] + dj * share, a[SQUARES_I] + b[SQUARES_I] + weight * di * di,
                     a[SQUARES_J] + b[SQUARES_J] + weight * dj * dj, a[PRODUCTS] + b[PRODUCTS] + weight * di * dj])


PAIR = "a string, b string, n bigint, mean_a double, mean_b double, squares_a double, squares_b double, products double"


def pair_moments(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PAIR for every ordered pair of `columns`, a column with itself included."""
    names = list(columns)

    def scan(batches):
        state = np.zeros((6, len(names), len(names)))
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                state = merged(state, of_batch(np.column_stack([part.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))])))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array([state[:, i].tobytes() for i in range(len(names))], pa.binary())],
                                         ["i", "state"])

    def merge(batches):
        states: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("i").to_pylist(), batch.column("state").to_pylist()):
                own = np.frombuffer(raw).reshape(6, len(names))
                states[i] = merged(states[i], own) if i in states else own
        for i, s in states.items():
            yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(names)), pa.array(names), pa.array(s[N].astype(np.int64))]
                                             + [pa.array(s[k]) for k in (MEAN_I, MEAN_J, SQUARES_I, SQUARES_J, PRODUCTS)], [c.split()[0] for c in PAIR.split(", ")])

    numbers = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    return numbers.mapInArrow(scan, "i int, state binary").repartition("i").mapInArrow(merge, PAIR)


def correlation():
    """The correlation of a PAIR row; NULL when a side does not vary, or by less than its last ten digits can tell."""
    def varies(side: str):
        return F.col(f"squares_{side}") > F.col("n") * F.pow(1e-10 * F.col(f"mean_{side}"), 2)
    # Sides that vary by rounding noise only would give a correlation of noise.
    return F.when(varies("a") & varies("b"), F.col("products") / F.sqrt(F.col("squares_a") * F.col("squares_b")))


ship(__name__)

"""A boosted ensemble taken apart: scores after every round, and exact signed feature contributions.

For one tree, a leaf pays its value to the features on its path: the Shapley value of the game in
which a known feature lets a row reach the leaf or not, and an unknown one lets through the share of
training rows that took that branch. That game has a closed form per leaf, so each batch is scored leaf
by leaf with NumPy. Contributions and the base value add up to the margin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


def leaf_paths(tree) -> list[tuple[float, list[tuple[int, float, bool, float]]]]:
    """(leaf value, [(feature, threshold, goes left, share of rows that go that way)]) of a fitted tree."""
    out = []

    def walk(node, path):
        if node.subtreeDepth() == 0:
            out.append((node.prediction(), path))
            return
        split, rows = node.split(), float(node.impurityStats().count())
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            share = float(child.impurityStats().count()) / rows
            walk(child, path + [(split.featureIndex(), split.threshold(), left, share)])

    walk(tree._java_obj.rootNode(), [])
    return out


def ensemble_paths(model) -> list[tuple[float, list]]:
    """Leaves of every tree with the tree's weight in their value."""
    return [(value * weight, path) for tree, weight in zip(model.trees, model.treeWeights) for value, path in leaf_paths(tree)]


def tree_arrays(tree) -> tuple[np.ndarray, ...]:
    """A fitted tree as arrays: feature, threshold, left, right, value. A leaf points at itself."""
    rows: list[list] = []

    def add(node) -> int:
        at = len(rows)
        rows.append([0, np.inf, at, at, node.prediction()])
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[at][:2] = [split.featureIndex(), split.threshold()]
            rows[at][2] = add(node.leftChild())
            rows[at][3] = add(node.rightChild())
        return at

    add(tree._java_obj.rootNode())
    kinds = (np.int64, float, np.int64, np.int64, float)
    return tuple(np.array(c, dtype=k) for c, k in zip(zip(*rows), kinds))


def staged_margins(x: np.ndarray, trees: Sequence, weights: Sequence[float], depth: int) -> Iterator[np.ndarray]:
    """The weighted tree sum of each row after one tree, after two, and so on: one running sum, whatever the number of rounds."""
    margin, at = np.zeros(len(x)), np.arange(len(x))
    for weight, (feature, threshold, left, right, value) in zip(weights, trees):
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(depth):
            node = np.where(x[at, feature[node]] <= threshold[node], left[node], right[node])
        margin = margin + weight * value[node]
        yield margin


def staged_counts(model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(round, score, pos, n): how often a boosted classifier gives a probability after each of its rounds, for all rounds in one pass.

    Rows are counted inside each batch first, so that what is shuffled grows with the distinct scores, of which early rounds have few.
    """
    trees, weights = [tree_arrays(t) for t in model.trees], list(model.treeWeights)
    names, depth = list(features), max(t.depth for t in model.trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            label = batch["label"].to_numpy().astype(np.int64)
            for i, margin in enumerate(staged_margins(batch[names].to_numpy(dtype=float), trees, weights, depth), start=1):
                score, at = np.unique(1 / (1 + np.exp(-2 * margin)), return_inverse=True)
                yield pd.DataFrame({"round": np.int32(i), "score": score, "pos": np.bincount(at, weights=label, minlength=len(score)).astype(np.int64),
                                    "n": np.bincount(at, minlength=len(score))})

    slim = rows.select(F.col("label").cast("int").alias("label"), *[F.col(f).cast("double").alias(f) for f in names])
    counts = slim.mapInPandas(run, "round int, score double, pos bigint, n bigint")
    return counts.groupBy("round", "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def contributions(x: np.ndarray, leaves: Sequence) -> tuple[np.ndarray, float]:
    """(rows, features) contributions and the base value."""
    phi, base = np.zeros_like(x, dtype=float), 0.0
    for value, path in leaves:
        reach: dict[int, float] = {}
        meets: dict[int, np.ndarray] = {}
        for feature, threshold, left, share in path:
            ok = x[:, feature] <= threshold
            ok = ok if left else ~ok
            reach[feature] = reach.get(feature, 1.0) * share
            meets[feature] = meets.get(feature, True) & ok
        base += value * math.prod(reach.values())
        names, d = list(reach), len(reach)
        for i in names:
            # Coefficients by number of known features among the others.
            poly = np.zeros((d, len(x)))
            poly[0] = 1.0
            for size, j in enumerate((j for j in names if j != i), start=1):
                known = meets[j].astype(float)
                poly[1:size + 1] = poly[1:size + 1] * reach[j] + poly[:size] * known
                poly[0] *= reach[j]
            weight = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
            phi[:, i] += value * (meets[i].astype(float) - reach[i]) * (weight @ poly)
    return phi, base


def explain_rows(rows: DataFrame, model, features: Sequence[str], keys: Sequence[str], top: int = 12) -> DataFrame:
    """(keys, feature, contribution, value): the `top` largest contributions per row, |c| > 1e-6."""
    leaves, names = ensemble_paths(model), list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            phi, _ = contributions(x, leaves)
            order = np.argsort(-np.abs(phi), axis=1, kind="stable")[:, :top]
            at = np.repeat(np.arange(len(batch)), order.shape[1])
            col = order.ravel()
            out = batch[list(keys)].iloc[at].reset_index(drop=True)
            out["feature"] = [names[j] for j in col]
            out["contribution"], out["value"] = phi[at, col], x[at, col]
            yield out[out["contribution"].abs() > 1e-6]

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    wanted = rows.select(*keys, *[F.col(f).cast("double").alias(f) for f in names])
    return wanted.mapInPandas(run, f"{kinds}, feature string, contribution double, value double")


ship(__name__)

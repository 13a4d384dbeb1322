"""A decision tree without a depth limit, grown level by level over distributed rows.

The top of the tree is grown by scans. Each scan walks every row down the splits found so far, counts classes by (node, feature, bin)
inside its task, and only these sums are shuffled; rows are neither moved nor rewritten. A node whose rows fit a task (`cells` values) is a
stub: rows of stubs are shuffled once, and each stub is finished whole where its rows meet, with exact cuts. So the driver holds the top only, which
has as many nodes as the table has task-sized parts, times their depth.

A split sends a row left if its value is at most the threshold. The best split has the smallest sum of n0 * n1 / n over its two sides (Gini),
then the first feature, then the lowest threshold; splits that gain nothing are taken too, so that only rows that are alike in all
features share a leaf with the other class. Features with up to `bins` values in a node are cut between each two neighbours, others at
approximate quantiles of the rows; a node that those can't part gets cuts of its own rows. Missing values count as larger than all others.
Equal classes predict 0. Rows need a label 0 or 1; an empty table gives a tree of one leaf.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle, ship

CELLS = 4_000_000
BINS = 64
ROOM = 8_000_000          # counters that a task of a scan holds


class Top:
    """The nodes grown by scans, as lists; a node without a feature is a leaf, a stub or still growing."""

    def __init__(self, n0: int, n1: int) -> None:
        self.paths, self.feature, self.threshold, self.left, self.right, self.n0, self.n1 = [""], [-1], [0.0], [0], [0], [n0], [n1]

    def split(self, node: int, feature: int, threshold: float, n0: int, n1: int) -> tuple[int, int]:
        """`n0`, `n1` are the left side's rows by class."""
        self.feature[node], self.threshold[node] = feature, threshold
        for side, a, b in (("L", n0, n1), ("R", self.n0[node] - n0, self.n1[node] - n1)):
            at = len(self.paths)
            (self.left if side == "L" else self.right)[node] = at
            for column, value in ((self.paths, self.paths[node] + side), (self.feature, -1), (self.threshold, 0.0), (self.left, at), (self.right, at),
                                  (self.n0, a), (self.n1, b)):
                column.append(value)
        return self.left[node], self.right[node]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature), np.array(self.threshold), np.array(self.left), np.array(self.right),
                np.array(self.n0), np.array(self.n1))


@dataclass
class Tree:
    features: list[str]
    top: Top
    stubs: dict[int, str]            # top nodes that go on in `subtrees`
    subtrees: DataFrame              # a row per stub: path, and its nodes as arrays

    def nodes(self) -> DataFrame:
        """(path, depth, feature, threshold, n0, n1) of every node; a leaf has no feature. A path is the turns taken from the root."""
        spark, top = self.subtrees.sparkSession, self.top
        rows = [(top.paths[i], len(top.paths[i]), self.features[f] if f >= 0 else None, top.threshold[i] if f >= 0 else None, int(top.n0[i]), int(top.n1[i]))
                for i, f in enumerate(top.feature) if i not in self.stubs]
        schema = "path string, depth int, feature string, threshold double, n0 bigint, n1 bigint"
        names = F.array(*[F.lit(f) for f in self.features])
        inner = self.subtrees.select("path", F.explode(F.arrays_zip("turns", "feature", "threshold", "n0", "n1")).alias("t"))
        inner = inner.select(F.concat("path", "t.turns").alias("path"), F.length(F.concat("path", "t.turns")).alias("depth"),
                             F.when(F.col("t.feature") >= 0, F.get(names, F.col("t.feature"))).alias("feature"),
                             F.when(F.col("t.feature") >= 0, F.col("t.threshold")).alias("threshold"), "t.n0", "t.n1")
        return spark.createDataFrame(rows, schema).unionByName(inner)


def walk(x: np.ndarray, arrays: tuple[np.ndarray, ...]) -> np.ndarray:
    """The node at which each row of `x` comes to rest."""
    feature, threshold, left, right = arrays[:4]
    node, at = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        on = feature[node] >= 0
        if not on.any():
            return node
        goes_left = x[at, feature[node]] <= threshold[node]
        node = np.where(on, np.where(goes_left, left[node], right[node]), node)


def by_node(node: np.ndarray, wanted: np.ndarray):
    """(node, its rows) for the `wanted` ones of the nodes at which rows rest."""
    order = np.argsort(node, kind="stable")
    ends = np.nonzero(np.diff(node[order], append=-1))[0] + 1
    for a, b in zip([0, *ends[:-1]], ends):
        if wanted[node[order[a]]]:
            yield int(node[order[a]]), order[a:b]


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The column `x` of equally long arrays."""
    column = batch.column("x")
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def as_rows(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(x, y): the features as an array, missing values as infinity, and the class."""
    def number(name):
        value = F.col(f"`{name}`").cast("double")
        return F.when(value.isNull() | F.isnan(value), F.lit(float("inf"))).otherwise(value)
    return rows.select(F.array(*[number(f) for f in features]).alias("x"), F.col(f"`{label}`").cast("int").alias("y")).where("y IS NOT NULL")


# ---- the scans ------------------------------------------------------------------------------------

def few_values(data: DataFrame, arrays, wanted: Sequence[int], bins: int, width: int) -> DataFrame:
    """(node, feature, values): up to `bins` + 1 different values of each feature in the `wanted` nodes, from each task."""
    chosen = np.isin(np.arange(len(arrays[0])), list(wanted))

    def run(batches):
        seen: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = matrix(batch)
            for n, rows in by_node(walk(x, arrays), chosen):
                for f in range(width):
                    known = seen.get((n, f))
                    if known is None or len(known) <= bins:
                        values = x[rows, f] if known is None else np.concatenate([known, x[rows, f]])
                        seen[n, f] = np.unique(values)[:bins + 1]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.int32()),
                                          pa.array([v.tolist() for v in seen.values()], pa.list_(pa.float64()))], ["node", "feature", "values"])
    return data.mapInArrow(run, "node bigint, feature int, values array<double>")


def located(data: DataFrame, arrays, wanted: Sequence[int]) -> DataFrame:
    """(node, x, y) of the rows that rest in one of the `wanted` nodes."""
    wanted = np.array(sorted(wanted))

    def run(batches):
        for batch in batches:
            node = walk(matrix(batch), arrays)
            keep = pa.array(np.isin(node, wanted))
            yield pa.RecordBatch.from_arrays([pa.array(node).filter(keep), batch.column("x").filter(keep), batch.column("y").filter(keep)], ["node", "x", "y"])
    return data.mapInArrow(run, "node bigint, x array<double>, y int")


def cuts(data: DataFrame, top: Top, wanted: Sequence[int], bins: int, width: int) -> dict[int, list[np.ndarray]]:
    """For each wanted node the thresholds of each feature, at most `bins`; none where the feature has one value only."""
    arrays = top.arrays()
    found = few_values(data, arrays, wanted, bins, width)
    found = found.select("node", "feature", F.explode("values").alias("v")).groupBy("node", "feature").agg(F.sort_array(F.collect_set("v")).alias("values"))
    out: dict[int, list[np.ndarray]] = {n: [np.array([])] * width for n in wanted}
    many: list[tuple[int, int]] = []
    for r in settle(found.select("node", "feature", F.slice("values", 1, bins + 1).alias("values"))).collect():       # bins x features x nodes numbers
        values = np.array(r["values"])
        if len(values) > bins:
            many.append((r["node"], r["feature"]))
            continue
        low, high = values[:-1], values[1:]
        out[r["node"]][r["feature"]] = np.where(np.isinf(high), low, low + (np.where(np.isinf(high), low, high) - low) / 2)
    if many:
        wide = located(data, arrays, sorted({n for n, _ in many})).select("node", F.posexplode("x").alias("feature", "v"))
        wide = wide.join(F.broadcast(data.sparkSession.createDataFrame(many, "node bigint, feature int")), ["node", "feature"])     # features x nodes of one scan
        steps = [(i + 1) / bins for i in range(bins - 1)]
        for r in wide.groupBy("node", "feature").agg(F.min("v").alias("least"), F.max("v").alias("most"),
                                                     F.percentile_approx("v", steps, 20 * bins).alias("at")).collect():
            values = np.unique([r["least"], *r["at"]])
            out[r["node"]][r["feature"]] = values[values < r["most"]]
    return out


def class_counts(data: DataFrame, arrays, edges: dict[int, list[np.ndarray]], bins: int, width: int) -> DataFrame:
    """(node, feature, bin, n0, n1): rows by class, summed inside each task."""
    wanted = sorted(edges)
    chosen, place = np.isin(np.arange(len(arrays[0])), wanted), {n: k for k, n in enumerate(wanted)}

    def run(batches):
        counts = np.zeros((len(wanted), width, bins + 1, 2), np.int64)
        for batch in batches:
            x, y = matrix(batch), batch.column("y").to_numpy(zero_copy_only=False)
            for n, rows in by_node(walk(x, arrays), chosen):
                k = place[n]
                for f in range(width):
                    at = np.searchsorted(edges[n][f], x[rows, f], side="left")
                    counts[k, f] += np.bincount(at * 2 + y[rows], minlength=(bins + 1) * 2).reshape(bins + 1, 2)
        k, f, b = np.nonzero(counts.sum(axis=3))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(wanted, np.int64)[k]), pa.array(f.astype(np.int32)), pa.array(b.astype(np.int32)),
                                          pa.array(counts[k, f, b, 0]), pa.array(counts[k, f, b, 1])], ["node", "feature", "bin", "n0", "n1"])
    return data.mapInArrow(run, "node bigint, feature int, bin int, n0 bigint, n1 bigint")


def best_splits(counts: DataFrame) -> DataFrame:
    """(node, feature, bin, n0, n1): the split of each node, with the left side's rows by class."""
    sums = counts.groupBy("node", "feature", "bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return sums.groupBy("node", "feature").agg(F.sort_array(F.collect_list(F.struct("bin", "n0", "n1"))).alias("b")).select(    # at most bins + 1 entries
        "node", "feature", F.explode(F.expr("""transform(sequence(1, size(b)), i -> struct(b[i - 1].bin AS bin,
            aggregate(slice(b, 1, i), 0L, (s, e) -> s + e.n0) AS n0, aggregate(slice(b, 1, i), 0L, (s, e) -> s + e.n1) AS n1,
            aggregate(b, 0L, (s, e) -> s + e.n0) AS all0, aggregate(b, 0L, (s, e) -> s + e.n1) AS all1))""")).alias("s")).select("node", "feature", "s.*").where(
        "n0 + n1 < all0 + all1").withColumn("score", F.expr("""CAST(n0 AS DOUBLE) * n1 / (n0 + n1)
            + CAST(all0 - n0 AS DOUBLE) * (all1 - n1) / (all0 + all1 - n0 - n1)""")).groupBy("node").agg(
        F.min(F.struct("score", "feature", "bin", "n0", "n1")).alias("s")).select("node", "s.feature", "s.bin", "s.n0", "s.n1")


# ---- the stubs ------------------------------------------------------------------------------------

def best_exact(x: np.ndarray, y: np.ndarray) -> tuple[int, float, np.ndarray] | None:
    """(feature, threshold, rows that go left) of the best split, or None if no feature varies."""
    order = np.argsort(x, axis=0, kind="stable")
    values = np.take_along_axis(x, order, axis=0)
    n = len(y)
    ones = np.cumsum(y[order], axis=0)[:-1].astype(float)
    rows = np.arange(1, n, dtype=float)[:, None]
    zeros, all_ones = rows - ones, float(y.sum())
    score = zeros * ones / rows + (n - all_ones - zeros) * (all_ones - ones) / (n - rows)
    score[values[:-1] == values[1:]] = np.inf
    feature, at = divmod(int(np.argmin(score.T)), n - 1)      # the first feature, then the lowest threshold
    if not np.isfinite(score[at, feature]):
        return None
    low, high = values[at, feature], values[at + 1, feature]
    threshold = low if np.isinf(high) else low + (high - low) / 2
    threshold = low if threshold >= high else threshold
    return feature, float(threshold), x[:, feature] <= threshold


def grow_here(x: np.ndarray, y: np.ndarray) -> dict[str, list]:
    """A whole tree on the rows at hand."""
    nodes: dict[str, list] = {c: [] for c in ("turns", "feature", "threshold", "low", "high", "n0", "n1")}

    def add(turns: str, rows: np.ndarray) -> int:
        ones = int(y[rows].sum())
        for column, value in zip(nodes.values(), (turns, -1, 0.0, 0, 0, len(rows) - ones, ones)):
            column.append(value)
        return len(nodes["turns"]) - 1

    todo = [(add("", np.arange(len(y))), np.arange(len(y)))]
    while todo:
        at, rows = todo.pop()
        split = best_exact(x[rows], y[rows]) if nodes["n0"][at] and nodes["n1"][at] else None
        if split is None:
            continue
        nodes["feature"][at], nodes["threshold"][at], left = split
        for side, name, mine in (("L", "low", rows[left]), ("R", "high", rows[~left])):
            nodes[name][at] = add(nodes["turns"][at] + side, mine)
            todo.append((nodes[name][at], mine))
    return nodes


SUBTREE = pa.schema([("path", pa.string()), ("turns", pa.list_(pa.string())), ("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())),
                     ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())), ("n0", pa.list_(pa.int64())), ("n1", pa.list_(pa.int64()))])
SUBTREE_DDL = ("path string, turns array<string>, feature array<int>, threshold array<double>, low array<int>, high array<int>, "
               "n0 array<bigint>, n1 array<bigint>")


def finish_stubs(data: DataFrame, arrays, stubs: dict[int, str]) -> DataFrame:
    """A row of SUBTREE per stub."""
    def run(batches):
        def done():
            nodes = grow_here(np.concatenate(xs), np.concatenate(ys))
            columns = [pa.array([v], t.type) for v, t in zip([stubs[node], *nodes.values()], SUBTREE)]
            return pa.RecordBatch.from_arrays(columns, schema=SUBTREE)
        node, xs, ys = None, [], []
        for batch in batches:
            x, y, nodes = matrix(batch), batch.column("y").to_numpy(zero_copy_only=False), batch.column("node").to_numpy()
            edges = [0, *(np.nonzero(np.diff(nodes))[0] + 1).tolist(), len(nodes)]
            for a, b in zip(edges, edges[1:]):
                if b > a and nodes[a] != node:
                    if xs:
                        yield done()
                    node, xs, ys = int(nodes[a]), [], []
                xs.append(x[a:b])
                ys.append(y[a:b])
        if node is not None:
            yield done()
    rows = located(data, arrays, list(stubs)).repartition("node").sortWithinPartitions("node")
    return rows.mapInArrow(run, SUBTREE_DDL)


def grow_tree(rows: DataFrame, features: Sequence[str], label: str = "label", cells: int = CELLS, bins: int = BINS) -> Tree:
    """The whole tree on `rows`. `cells` bounds the values of a node that one task finishes, `bins` the cuts of a feature in larger ones."""
    data, width = settle(as_rows(rows, features, label)), len(features)
    n, ones = data.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    top = Top(n - ones, ones)
    large = lambda i: top.n0[i] and top.n1[i] and (top.n0[i] + top.n1[i]) * width > cells                         # noqa: E731
    growing = [0] if large(0) else []
    stubs = {} if growing or not (top.n0[0] and top.n1[0]) else {0: ""}
    edges: dict[int, list[np.ndarray]] = {}
    fresh = set(growing)                                 # nodes whose cuts come from their own rows
    per_scan = max(1, ROOM // (width * (bins + 1) * 2))
    while growing:
        scan, growing = growing[:per_scan], growing[per_scan:]
        own = [i for i in scan if i in fresh]
        if own:
            edges.update(cuts(data, top, own, bins, width))
            scan = [i for i in scan if any(len(e) for e in edges[i])]        # else all rows are alike: a leaf of both classes
        if not scan:
            continue
        found = {r["node"]: r for r in best_splits(class_counts(data, top.arrays(), {i: edges[i] for i in scan}, bins, width)).collect()}
        for i in scan:
            if i not in found:                           # the cuts of an ancestor do not part these rows
                fresh.add(i)
                growing.append(i)
                continue
            r = found[i]
            for child in top.split(i, r["feature"], float(edges[i][r["feature"]][r["bin"]]), r["n0"], r["n1"]):
                if large(child):
                    edges[child] = edges[i]
                    growing.append(child)
                elif top.n0[child] and top.n1[child]:
                    stubs[child] = top.paths[child]
            edges.pop(i)
    return Tree(list(features), top, stubs, settle(finish_stubs(data, top.arrays(), stubs)))


# ---- what the tree says ---------------------------------------------------------------------------

def predictions(tree: Tree, rows: DataFrame, depths: Sequence[int | None], label: str = "label") -> DataFrame:
    """(y, votes): the class that the tree, cut off at each of `depths` (None: whole), gives to each row."""
    limits = [np.iinfo(np.int64).max if d is None else d for d in depths]
    arrays, stubs = tree.top.arrays(), np.array(sorted(tree.stubs), np.int64)
    paths = {i: p for i, p in tree.stubs.items()}
    schema = pa.schema([("kind", pa.int32()), ("path", pa.string()), ("x", pa.list_(pa.float64())), ("y", pa.int32()), ("votes", pa.list_(pa.int32()))])

    def descend(x, walked, depth, votes):
        """Go down from the root of `walked`, `depth` levels below the tree's own, and note the votes on the way."""
        feature, threshold, left, right, n0, n1 = walked
        node, at = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            vote = (n1[node] > n0[node]).astype(np.int32)
            for j, limit in enumerate(limits):
                if depth <= limit:
                    votes[:, j] = vote
            on = feature[node] >= 0
            if not on.any():
                return node
            goes_left = x[at, feature[node]] <= threshold[node]
            node = np.where(on, np.where(goes_left, left[node], right[node]), node)
            depth += 1

    def through_top(batches):
        for batch in batches:
            x = matrix(batch)
            votes = np.zeros((len(x), len(limits)), np.int32)
            node = descend(x, arrays, 0, votes)
            goes_on = np.isin(node, stubs)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(x), np.int32)), pa.array([paths.get(int(i)) if g else None for i, g in zip(node, goes_on)], pa.string()),
                                              batch.column("x"), batch.column("y"), pa.array(votes.tolist(), pa.list_(pa.int32()))], schema=schema)

    def through_stubs(batches):
        path, walked = None, None
        for batch in batches:
            kinds, names = batch.column("kind").to_numpy(), batch.column("path").to_pylist()
            start = 0
            while start < batch.num_rows:
                if kinds[start] == 0:                    # a subtree comes before its rows
                    path = names[start]
                    t = batch.column("tree")[start].as_py()
                    walked = tuple(np.array(t[c]) for c in ("feature", "threshold", "low", "high", "n0", "n1"))
                    start += 1
                    continue
                end = start
                while end < batch.num_rows and kinds[end] == 1 and names[end] == path:
                    end += 1
                part = batch.slice(start, end - start)
                votes = np.array(part.column("votes").to_pylist(), np.int32)
                descend(matrix(part), walked, len(path), votes)
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(votes.tolist(), pa.list_(pa.int32()))], ["y", "votes"])
                start = end

    walked = as_rows(rows, tree.features, label).mapInArrow(through_top, "kind int, path string, x array<double>, y int, votes array<int>")
    walked = settle(walked)
    ended = walked.where("path IS NULL").select("y", "votes")
    if not tree.stubs:
        return ended
    tree_type = "struct<feature: array<int>, threshold: array<double>, low: array<int>, high: array<int>, n0: array<bigint>, n1: array<bigint>>"
    subtrees = tree.subtrees.select(F.lit(0).alias("kind"), "path", F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("int").alias("y"),
                                    F.lit(None).cast("array<int>").alias("votes"),
                                    F.struct("feature", "threshold", "low", "high", "n0", "n1").cast(tree_type).alias("tree"))
    both = walked.where("path IS NOT NULL").withColumn("tree", F.lit(None).cast(tree_type)).unionByName(subtrees)
    rest = both.repartition("path").sortWithinPartitions("path", "kind").mapInArrow(through_stubs, "y int, votes array<int>")
    return ended.unionByName(rest)


def tree_ladder(tree: Tree, test: DataFrame, depths: Sequence[int | None] = (2, 4, 6, 8, 12, 16, 24, 32, None), label: str = "label") -> DataFrame:
    """Per depth limit (null: none): the depth and leaves of the tree cut off there, and accuracy and balanced accuracy on its own and on `test` rows."""
    nodes, out = settle(tree.nodes()), None
    for d in depths:
        ends = nodes.where(F.col("feature").isNull() if d is None else (F.col("depth") == d) | (F.col("feature").isNull() & (F.col("depth") < d)))
        hit1, hit0 = F.sum(F.when(F.col("n1") > F.col("n0"), F.col("n1")).otherwise(0)), F.sum(F.when(F.col("n1") > F.col("n0"), 0).otherwise(F.col("n0")))
        row = ends.agg(F.max("depth").alias("depth"), F.count("*").alias("leaves"), ((hit0 + hit1) / F.sum(F.col("n0") + F.col("n1"))).alias("train_accuracy"),
                       ((hit0 / F.sum("n0") + hit1 / F.sum("n1")) / 2).alias("train_balanced_accuracy")).select(F.lit(d).cast("int").alias("max_depth"), "*")
        out = row if out is None else out.unionByName(row)
    table = spark_depths(tree, depths)
    votes = predictions(tree, test, depths, label).select("y", F.posexplode("votes").alias("at", "vote")).groupBy("at").agg(
        F.avg((F.col("y") == F.col("vote")).cast("double")).alias("test_accuracy"),
        ((F.avg(F.when(F.col("y") == 0, (F.col("vote") == 0).cast("double"))) + F.avg(F.when(F.col("y") == 1, (F.col("vote") == 1).cast("double")))) / 2)
        .alias("test_balanced_accuracy"))
    tested = table.join(F.broadcast(votes), "at", "left").drop("at").withColumnRenamed("d", "max_depth")      # a row per depth
    same = F.col("a.max_depth").eqNullSafe(F.col("b.max_depth"))
    return out.alias("a").join(F.broadcast(tested).alias("b"), same, "left").select("a.*", "b.test_accuracy", "b.test_balanced_accuracy")


def spark_depths(tree: Tree, depths: Sequence[int | None]) -> DataFrame:
    schema = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("d", T.IntegerType())])
    return tree.subtrees.sparkSession.createDataFrame(list(enumerate(depths)), schema)


def label_conflict_ceiling(rows: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """(n, unreachable, ceiling): rows that no tree can get right, as rows alike in all features have the other class, and the accuracy that leaves."""
    alike = as_rows(rows, features, label).groupBy("x").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    return alike.agg(F.sum("n").alias("n"), F.sum(F.least("ones", F.col("n") - F.col("ones"))).alias("unreachable")).withColumn(
        "ceiling", 1 - F.col("unreachable") / F.col("n"))


ship(__name__)

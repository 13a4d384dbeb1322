"""Trees without a depth limit on hand-made frames."""

import numpy as np
import pandas as pd
import pytest

from fleetgauge.operators import trees


def nodes_of(tree):
    frame = tree.nodes().toPandas()
    return {tuple(None if pd.isna(v) else v for v in row) for row in frame[["path", "feature", "threshold", "n0", "n1"]].itertuples(index=False)}


def frame(spark, x, y, parts=4):
    names = [f"f{i}" for i in range(x.shape[1])]
    return spark.createDataFrame(pd.DataFrame(np.c_[x, y], columns=[*names, "label"])).repartition(parts), names


def plain_class(tree, x, depth=None):
    """Walk the node table row by row."""
    table = {r["path"]: r for r in tree.nodes().collect()}
    out = []
    for row in x:
        path = ""
        while table[path]["feature"] is not None and (depth is None or len(path) < depth):
            path += "L" if row[int(table[path]["feature"][1:])] <= table[path]["threshold"] else "R"
        out.append(int(table[path]["n1"] > table[path]["n0"]))
    return np.array(out)


def noisy(n=1500, seed=1):
    r = np.random.default_rng(seed)
    x = r.integers(0, 20, (n, 3)).astype(float)
    return x, ((x[:, 0] + 2 * x[:, 1] + r.normal(size=n) * 10) > 30).astype(int)


def test_scans_and_tasks_grow_the_same_tree(spark):
    df, names = frame(spark, *noisy())
    here = trees.grow_tree(df, names)
    scanned = trees.grow_tree(df, names, cells=300)
    assert not here.top.feature[0] >= 0 and scanned.top.feature[0] >= 0 and len(scanned.stubs) > 5
    assert nodes_of(here) == nodes_of(scanned)


def test_deeper_than_thirty(spark):
    """Classes that alternate along one feature are peeled off one end."""
    x = np.arange(120.0)[:, None]
    df, names = frame(spark, x, np.arange(120) % 2)
    tree = trees.grow_tree(df, names)
    ladder = {r["max_depth"]: r for r in trees.tree_ladder(tree, df, (2, 8, 32, None)).collect()}
    assert ladder[None]["depth"] > 30 and ladder[None]["leaves"] == 120
    assert ladder[None]["train_accuracy"] == ladder[None]["test_accuracy"] == 1
    assert ladder[2]["depth"] == 2 and ladder[2]["train_accuracy"] < ladder[8]["train_accuracy"] < 1


@pytest.mark.parametrize("cells, bins", [(10 ** 7, 64), (200, 4)])
def test_ladder_against_walking(spark, cells, bins):
    x, y = noisy(600)
    x[::17, 2] = np.nan
    df, names = frame(spark, x, y)
    tree = trees.grow_tree(df, names, cells=cells, bins=bins)
    x = np.where(np.isnan(x), np.inf, x)
    for r in trees.tree_ladder(tree, df, (1, 3, 6, None)).collect():
        hit = plain_class(tree, x, r["max_depth"]) == y
        assert r["test_accuracy"] == pytest.approx(hit.mean()) and r["train_accuracy"] == pytest.approx(hit.mean())
        assert r["test_balanced_accuracy"] == pytest.approx((hit[y == 0].mean() + hit[y == 1].mean()) / 2)


def test_conflicts_bound_the_accuracy(spark):
    x = np.repeat(np.array([[1.0, 1.0], [1.0, 2.0], [3.0, 0.0]]), 40, axis=0)
    y = np.array([0] * 30 + [1] * 10 + [1] * 40 + [0] * 40)
    df, names = frame(spark, x, y)
    for cells in (10 ** 6, 20):                         # the rows that are alike are a leaf, even where they are many
        tree = trees.grow_tree(df, names, cells=cells)
        assert trees.tree_ladder(tree, df, (None,)).first()["train_accuracy"] == pytest.approx(110 / 120)
    assert trees.label_conflict_ceiling(df, names).first().asDict() == {"n": 120, "unreachable": 10, "ceiling": pytest.approx(110 / 120)}


def test_a_rare_value_is_still_cut_off(spark):
    """No quantile of the rows tells the few rows at the lower end apart."""
    x = np.r_[np.zeros(3), np.full(2000, 9.0), np.arange(100, 130)][:, None]
    df, names = frame(spark, x, np.r_[np.ones(3), np.zeros(2000), np.ones(30)].astype(int))
    tree = trees.grow_tree(df, names, cells=50, bins=4)
    assert trees.tree_ladder(tree, df, (None,)).first()["train_accuracy"] == 1


def test_one_class_and_no_rows(spark):
    df, names = frame(spark, np.arange(6.0)[:, None], np.zeros(6, int))
    for rows, n in ((df, 6), (df.limit(0), 0)):
        tree = trees.grow_tree(rows, names)
        assert nodes_of(tree) == {("", None, None, n, 0)}
        assert trees.predictions(tree, rows, (1, None)).count() == n

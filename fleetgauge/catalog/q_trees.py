"""Trees without a depth limit: the ladder of depths, its first levels, and what no tree can learn."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trees
from .base import query
from .q_models import SS, training_windows
from .q_timeline import BASE
from .views import aggregate_sql, label_sql, tiles_sql

WHOLE = ["q__last", "q__max", "n__last", "n__max", "n_real"]          # whole numbers, so that cuts lie between neighbours on both sides
CELLS, BINS = 20_000, 512
LEVELS = 3


def level_sql(k: int) -> str:
    """x0 has the rows of all splits at the root; each level parts the nodes of the one before by the best split of the training rows."""
    score = "CAST(n0 AS DOUBLE) * n1 / (n0 + n1) + CAST(a0 - n0 AS DOUBLE) * (a1 - n1) / (a0 + a1 - n0 - n1)"
    return f"""
long{k} AS (SELECT path, label, unnest(x) AS v, unnest(range({len(WHOLE)})) AS f FROM x{k} WHERE split = 'train'),
vals{k} AS (SELECT path, f, v, sum(1 - label) AS n0, sum(label) AS n1 FROM long{k} GROUP BY path, f, v),
cum{k} AS (SELECT path, f, v, lead(v) OVER (PARTITION BY path, f ORDER BY v) AS nxt, sum(n0) OVER w AS n0, sum(n1) OVER w AS n1,
                  sum(n0) OVER (PARTITION BY path, f) AS a0, sum(n1) OVER (PARTITION BY path, f) AS a1
           FROM vals{k} WINDOW w AS (PARTITION BY path, f ORDER BY v)),
best{k} AS (SELECT path, f, v + (nxt - v) / 2.0 AS cut FROM cum{k} WHERE nxt IS NOT NULL AND a0 > 0 AND a1 > 0
            QUALIFY row_number() OVER (PARTITION BY path ORDER BY {score}, f, v) = 1),
x{k + 1} AS (SELECT r.path || CASE WHEN f IS NULL THEN '' WHEN x[f + 1] <= cut THEN 'L' ELSE 'R' END AS path, x, label, split
             FROM x{k} r LEFT JOIN best{k} b ON b.path = r.path),
node{k} AS (SELECT r.path, any_value(['{"', '".join(WHOLE)}'][f + 1]) AS feature, any_value(cut) AS cut, count(*) - sum(label) AS n0, sum(label) AS n1
            FROM x{k} r LEFT JOIN best{k} b ON b.path = r.path WHERE split = 'train' GROUP BY r.path)"""


GROWN_SQL = f"""{BASE}, {tiles_sql(SS)}, {aggregate_sql(SS, ("q", "n"), aggregates=("last", "max"))},
x0 AS (SELECT '' AS path, [{", ".join(f"CAST(t.{c} AS DOUBLE)" for c in WHOLE)}] AS x, {label_sql(SS, "t")} AS label, s.split
       FROM feat t JOIN split s ON s.drive = t.drive),{",".join(level_sql(k) for k in range(LEVELS + 1))}"""


def grown(spark, d):
    t = training_windows(spark, d)
    return trees.grow_tree(t.where("split = 'train'"), WHOLE, cells=CELLS, bins=BINS), t


@query("m2_first_levels", "path:s feature:s threshold:r n0:i n1:i",
       GROWN_SQL + " UNION ALL ".join(f" SELECT path, feature, cut AS threshold, n0, n1 FROM node{k} WHERE length(path) = {k}" for k in range(LEVELS + 1)))
def _(spark, d):
    return grown(spark, d)[0].nodes().where(F.col("depth") <= LEVELS)


def ladder_sql(k: int) -> str:
    hits = ("count(*) FILTER (WHERE r.label = (n1 > n0)::INT AND split = '{s}')::DOUBLE / nullif(count(*) FILTER (WHERE split = '{s}'), 0) AS {s}_accuracy, "
            "(count(*) FILTER (WHERE r.label = 0 AND n1 <= n0 AND split = '{s}')::DOUBLE / nullif(count(*) FILTER (WHERE r.label = 0 AND split = '{s}'), 0) + "
            "count(*) FILTER (WHERE r.label = 1 AND n1 > n0 AND split = '{s}')::DOUBLE / nullif(count(*) FILTER (WHERE r.label = 1 AND split = '{s}'), 0)) / 2 "
            "AS {s}_balanced_accuracy")
    return (f" SELECT {k} AS max_depth, (SELECT max(length(path)) FROM node{k}) AS depth, (SELECT count(*) FROM node{k}) AS leaves, "
            f"{hits.format(s='train')}, {hits.format(s='test')} FROM x{k} r JOIN node{k} n ON n.path = r.path")


_LADDER = "max_depth:i depth:i leaves:i train_accuracy:r train_balanced_accuracy:r test_accuracy:r test_balanced_accuracy:r"


@query("m2_ladder_first_levels", _LADDER, GROWN_SQL + " UNION ALL ".join(ladder_sql(k) for k in range(1, LEVELS + 1)))
def _(spark, d):
    tree, t = grown(spark, d)
    return trees.tree_ladder(tree, t.where("split = 'test'"), range(1, LEVELS + 1))


@query("m2_unbounded_ladder", _LADDER)
def _(spark, d):
    tree, t = grown(spark, d)
    return trees.tree_ladder(tree, t.where("split = 'test'"))


@query("m2_unbounded_accuracy", "n:i unreachable:i ceiling:r train_accuracy:r",
       f"""{GROWN_SQL}, alike AS (SELECT x, count(*) AS n, sum(label) AS ones FROM x0 WHERE split = 'train' GROUP BY x)
       SELECT sum(n) AS n, sum(least(ones, n - ones)) AS unreachable, 1 - sum(least(ones, n - ones)) / sum(n)::DOUBLE AS ceiling,
              1 - sum(least(ones, n - ones)) / sum(n)::DOUBLE AS train_accuracy FROM alike""")
def _(spark, d):
    """A tree without limits is right wherever a tree can be."""
    tree, t = grown(spark, d)
    train = t.where("split = 'train'")
    whole = trees.tree_ladder(tree, train, (None,)).select("train_accuracy")
    return trees.label_conflict_ceiling(train, WHOLE).crossJoin(whole)      # one row each

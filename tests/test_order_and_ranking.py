"""Global order without a global sort, against brute force on ties and hot values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.functions import order
from fleetgauge.operators import ranking as rk


@pytest.fixture(scope="module")
def rows():
    """A third of the rows share one score; the rest are close together or tied in pairs."""
    r = random.Random(7)
    out = [(i, 0.5, int(r.random() < 0.2)) for i in range(200)]
    out += [(200 + i, round(0.9 + r.random() * 1e-4, 6), int(r.random() < 0.5)) for i in range(200)]
    out += [(400 + i, round(r.random(), 2), int(r.random() < 0.3)) for i in range(200)]
    return out


@pytest.fixture(scope="module")
def scored(spark, rows):
    return spark.createDataFrame(rows, "drive bigint, score double, label int")


def average_precision(rows):
    pos, tp, n, out = sum(y for _, _, y in rows), 0, 0, 0.0
    for s in sorted({s for _, s, _ in rows}, reverse=True):
        here = [y for _, t, y in rows if t == s]
        tp, n = tp + sum(here), n + len(here)
        out += sum(here) / pos * tp / n
    return out


def roc_auc(rows):
    pos = [s for _, s, y in rows if y]
    neg = [s for _, s, y in rows if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


@pytest.fixture(params=[False, True])
def many_ranges(spark, request):
    """Once with the small ranges joined into one, once with as many as there are shuffle partitions."""
    if request.param:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield request.param
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ranking_metrics(scored, rows, many_ranges):
    got = rk.ranking_metrics(scored).first()
    assert got.roc_auc == pytest.approx(roc_auc(rows)) and got.pr_auc == pytest.approx(average_precision(rows))


def test_one_class_gives_null(spark):
    got = rk.ranking_metrics(spark.createDataFrame([(1, 0.2, 0), (2, 0.4, 0)], "drive int, score double, label int")).first()
    assert got.roc_auc is None and got.pr_auc is None


def test_ranges_balance_values_not_rows(scored, rows, many_ranges):
    placed = order.in_ranges(rk.score_counts(scored), [F.col("score")])
    sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
    assert sum(sizes) == len({s for _, s, _ in rows})
    assert len(sizes) > 10 and max(sizes) < 3 * sum(sizes) / len(sizes) if many_ranges else len(sizes) == 1


def test_score_rank_is_a_permutation_in_score_order(scored, rows, many_ranges):
    ranked = sorted((r["rank"], r.score) for r in order.score_rank(scored, "score", [F.col("drive")]).collect())
    assert [k for k, _ in ranked] == list(range(1, len(rows) + 1))
    assert [s for _, s in ranked] == sorted((s for _, s, _ in rows), reverse=True)


def test_hash_rank_is_a_permutation(spark):
    got = order.hash_rank(spark.range(5000).withColumnRenamed("id", "drive"), [F.col("drive")], 1).select("rank").collect()
    assert sorted(r[0] for r in got) == list(range(1, 5001))


def test_exact_quantiles(scored, rows, many_ranges):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.prob: r.value for r in order.exact_quantiles(scored, ["score"], probs).collect()}
    want = np.quantile([s for _, s, _ in rows], probs)
    assert [got[p] for p in probs] == pytest.approx(list(want))


def test_one_and_many_ranges_agree(spark, scored):
    """The audit and the quantiles give the same however many ranges the values are dealt into."""
    from fleetgauge.operators import leakage

    def facts():
        audit = leakage.audit_numeric(scored, ["score", "drive"], "label").collect()       # sums of doubles depend on their order in the last digits
        return (sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in audit), sorted(order.exact_quantiles(scored, ["score", "drive"], [0.3, 0.5]).collect()))
    whole = facts()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert facts() == whole
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def best_f1(rows, thresholds, strict=False):
    best = (-1.0, None)
    for t in thresholds:
        hit = [y for _, s, y in rows if (s > t if strict else s >= t)]
        f1 = 2 * sum(hit) / (len(hit) + sum(y for _, _, y in rows))
        best = max(best, (f1, t))
    return best


def test_best_threshold_is_realisable(scored, rows):
    got = rk.best_threshold(scored).first()
    assert (got.f1, got.threshold) == pytest.approx(best_f1(rows, {s for _, s, _ in rows}))


def test_grid_is_strict(scored, rows):
    got = {round(r.threshold, 2): r.f1 for r in rk.grid_thresholds(scored).collect()}
    assert len(got) == 99
    assert got[0.5] == pytest.approx(best_f1(rows, [0.5], strict=True)[0])


def test_precision_at_k_edges(spark, scored):
    small = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 0), (3, 0.7, 1)], "drive bigint, score double, label int")
    got = {r.k: r for r in rk.precision_at_k(small, (2, 10), ["drive"]).collect()}
    assert (got[2].hits, got[2].precision, got[2].recall, got[2].best_possible) == (1, 0.5, 0.5, 1.0)
    assert (got[10].k_effective, got[10].hits) == (3, 2) and got[10].best_possible == pytest.approx(2 / 3)
    assert got[2].lift == pytest.approx(0.5 / (2 / 3))
    at = rk.precision_at_cuts(scored, ["drive"], fixed=(10, 10_000), at_positives=True)
    assert sorted(r.k for r in at.collect())[-1] == scored.count()


def test_spearman_with_ties(spark):
    a = [0.1, 0.1, 0.3, 0.4, 0.9, 0.9, 0.9]
    b = [0.2, 0.1, 0.4, 0.4, 0.7, 0.9, 0.8]
    df = spark.createDataFrame(list(zip(a, b)), "score double, score_b double")

    def mid(v):
        return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]

    assert rk.spearman(df, "score", "score_b").first()[0] == pytest.approx(np.corrcoef(mid(a), mid(b))[0, 1])


def test_no_single_partition_window_over_rows(scored):
    """Only bucket totals may meet in one task."""
    plan = rk.ranking_metrics(scored)._jdf.queryExecution().executedPlan().toString()
    singles = [line for line in plan.splitlines() if "Exchange SinglePartition" in line]
    assert len(singles) <= 2            # the bucket offsets, and the final one-row aggregate


def test_ranges_follow_the_scores(spark, many_ranges):
    """Scores crowded near 0: no range holds over twice its share of the distinct ones, and no row sorts a list of cuts."""
    counts = spark.range(1000).select((F.col("id") * F.col("id") / 2.5e8).alias("score"), F.lit(1).cast("bigint").alias("n"))
    placed = order.in_ranges(counts, [F.col("score")])
    sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 2 * 1000 / len(sizes)
    upto = order.totals_in_order(counts, [F.col("score")], {"n": "upto"})
    assert [r["upto"] for r in upto.orderBy("score").collect()] == list(range(1, 1001))


def test_no_score_ranks_last(spark, many_ranges):
    nan = float("nan")
    rows = spark.createDataFrame([(i, s, int(i % 2)) for i, s in enumerate([0.5, None, nan, 7.0, -3.0, 0.5, None, 0.001])], "drive long, score double, label int")
    ranks = {r.drive: r["rank"] for r in order.score_rank(rows, "score", [F.col("drive")]).collect()}
    assert sorted(ranks.values()) == list(range(1, 9)) and ranks[3] == 1 and ranks[4] == 5 and {ranks[1], ranks[2], ranks[6]} == {6, 7, 8}
    top = rk.precision_at_k(rows, [1, 8], ["drive"]).orderBy("k").collect()
    assert top[0].hits == 1 and top[1].hits == 4
    got = rk.ranking_metrics(rows).first()
    same = rk.ranking_metrics(rows.withColumn("score", F.coalesce(order.known_score("score"), F.lit(-9.0)))).first()
    assert got == same and got.n == 8
    flat = rk.ranking_metrics(rows.withColumn("score", F.lit(0.3))).first()
    assert flat.roc_auc == 0.5

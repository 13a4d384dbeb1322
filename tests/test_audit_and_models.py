import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from fleetgauge.catalog import views as V
from fleetgauge.operators import experiments as ex
from fleetgauge.operators import explain, leakage, models, profile, ranking
from fleetgauge.settings import LeakageRules


def test_sketched_coverage_is_near_the_exact_one(spark):
    days = V.events_days(spark, "/root/testdata/sf0.001")
    exact = {r.attribute: r for r in profile.attribute_coverage(days, V.EVENT_ATTRS).collect()}
    for got in profile.attribute_coverage(days, V.EVENT_ATTRS, rsd=0.02).collect():
        want = exact[got.attribute]
        assert (got.coverage_pct, got.usable, got.constant) == (want.coverage_pct, want.usable, want.constant)
        assert got.distinct_values == pytest.approx(want.distinct_values, rel=0.1, abs=1)


def test_a_restated_label_is_severe(spark):
    days = V.events_days(spark, "/root/testdata/sf0.01")
    got = {r.column: r.verdict for r in leakage.audit_numeric(days, V.EVENT_ATTRS).collect()}
    assert got["m_error"] == leakage.SEVERE and got["n_view"] == leakage.CLEAN


def test_association_edges(spark):
    rows = [(1, 5.0, None, 1.0, None), (1, 5.0, None, 2.0, None), (0, 5.0, None, 3.0, 1.0), (0, 5.0, None, 4.0, 2.0), (0, 5.0, None, float("nan"), 3.0)]
    df = spark.createDataFrame(rows, "failure int, constant double, empty double, reverse double, gone double")
    got = {r.column: r for r in leakage.audit_numeric(df, ["constant", "empty", "reverse", "gone"]).collect()}
    assert got["constant"].auc is None and got["empty"].coverage == 0.0 and got["empty"].n_unique == 0
    assert got["reverse"].auc == 0.0 and got["reverse"].auc_directional == 1.0 and got["reverse"].balanced_acc == 1.0
    assert got["reverse"].coverage == pytest.approx(0.8)
    # Seen on healthy rows only: one class, so no rank metric, but the gap gives it away.
    assert got["gone"].auc is None and got["gone"].missing_gap == 1.0 and got["gone"].reason.startswith("missingness gap")


def test_verdict_precedence(spark):
    rows = [(0.96, 0.99, 0.9, 0.0, None), (0.5, 0.91, 0.9, 0.0, None), (0.5, 0.5, -0.6, 0.3, None), (0.86, 0.5, 0.1, 0.3, None),
            (0.86, 0.5, 0.1, 0.1, None), (0.5, 0.5, 0.1, -0.09, 6.0), (0.5, 0.5, 0.1, 0.0, 6.0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "auc_directional double, balanced_acc double, corr double, missing_gap double, max_lift double")
    got = [(r.verdict, r.reason.rsplit(" ", 1)[0]) for r in leakage.with_verdict(df).collect()]
    assert got == [("SEVERE LEAK", "rank AUC"), ("SEVERE LEAK", "balanced accuracy"), ("SEVERE LEAK", "point-biserial r"),
                   ("SEVERE LEAK", "missingness gap"), ("suspect", "rank AUC"), ("suspect", "missingness gap"),
                   ("suspect", "level lift"), ("clean", "")]


def test_cramers_v_counts_missing_as_a_level(spark):
    rows = [(1, None, "x")] * 4 + [(0, "s", "x")] * 6
    df = spark.createDataFrame(rows, "failure int, site string, flat string")
    got = {r.column: r for r in leakage.audit_categorical(df, ["site", "flat"], rules=LeakageRules(min_support=1)).collect()}
    assert got["site"].cramers_v == pytest.approx(1.0) and got["site"].cardinality == 1 and got["flat"].cramers_v == 0.0
    assert got["site"].max_lift == pytest.approx(2.5)


def test_blocked_names_cover_derived_ones():
    leakage.assert_unblocked(["smart_5_raw"], ["day", "smart_9"])
    with pytest.raises(ValueError):
        leakage.assert_unblocked(["smart_9_raw__last"], ["smart_9_raw"])


def test_early_stop_and_divergence(spark):
    val = [0.1, 0.3, 0.3005, 0.2, None, 0.25, 0.5]
    train = [0.1, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
    rows = [("r", i + 1, t, v) for i, (t, v) in enumerate(zip(train, val))]
    df = spark.createDataFrame(rows, "variation string, epoch int, train_pr_auc double, val_pr_auc double")
    stop = ex.early_stop(df).first()
    assert (stop.best_epoch, stop.stop_epoch) == (2, 5)
    assert ex.divergence(df.where("epoch < 5"), "pr_auc").first().divergence_epoch is None
    worse = spark.createDataFrame([("r", i + 1, t, v) for i, (t, v) in enumerate(zip([.1, .2, .3, .4, .5], [.1, .5, .4, .3, .2]))], df.schema)
    assert ex.divergence(worse, "pr_auc").first().divergence_epoch == 3
    assert ex.divergence(worse, "pr_auc", 4).first().divergence_epoch is None


def test_gap_reasons(spark):
    df = spark.createDataFrame([("r", 1, 0.6, 0.5, 0.1, 0.2), ("r", 2, 0.5, 0.0, 0.0, 0.2)],
                               "variation string, epoch int, train_pr_auc double, val_pr_auc double, train_loss double, val_loss double")
    one, two = ex.with_gaps(df).orderBy("epoch").collect()
    assert one.overfit_reasons == "pr_auc 20.0%>15%; loss 100.0%>25%" and one.overfit_flag == 1
    assert two.pr_auc_gap_pct is None and two.loss_gap_pct is None and two.overfit_flag == 0


@pytest.fixture(scope="module")
def fitted(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] * (x[:, 2] > 0) + r.normal(scale=0.3, size=400)) > 0.5).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "drive bigint, label int, a double, b double, c double")
    train, val = df.where("drive % 4 > 0"), df.where("drive % 4 = 0")
    return models.fit_boosted(train, val, ["a", "b", "c"], rounds=6, step=0.3, depth=3, subsample=1.0, patience=6), val


def test_staged_scores_are_those_of_shorter_models(fitted):
    fit, val = fitted
    gbt = fit.model.stages[-1]
    staged = explain.staged_counts(gbt, val, fit.features).collect()
    for n in range(1, gbt.getNumTrees + 1):
        live = models.probability(PipelineModel([models.assembler(fit.features), models.first_trees(gbt, n)]), val).collect()
        assert sorted(s for r in staged if r["round"] == n for s in [r.score] * r.n) == pytest.approx(sorted(r.score for r in live))
        assert sum(r.pos for r in staged if r["round"] == n) == sum(r.label for r in live)
    history = {r.epoch: r.val_pr_auc for r in fit.history.collect()}
    assert sorted(history) == list(range(1, 7)) and fit.best_round == gbt.getNumTrees
    assert max(history, key=lambda n: (history[n], -n)) == fit.best_round
    assert ranking.ranking_metrics(models.probability(fit.model, val)).first().pr_auc == pytest.approx(history[fit.best_round])


def test_first_trees_are_a_shorter_fit(spark, fitted):
    """Also with rows and columns drawn for each tree."""
    _, rows = fitted
    args = dict(labelCol="label", featuresCol="features", maxDepth=3, stepSize=0.3, subsamplingRate=0.7, featureSubsetStrategy="0.8", seed=5)
    train = models.vectors(rows, ["a", "b", "c"])
    whole, short = GBTClassifier(maxIter=6, **args).fit(train), GBTClassifier(maxIter=4, **args).fit(train)
    cut = models.first_trees(whole, 4)
    assert cut.getNumTrees == 4 and cut.treeWeights == short.treeWeights
    both = [sorted(r.score for r in models.probability(m, train).collect()) for m in (cut, short)]
    assert both[0] == both[1]


def test_correlations_with_gaps_in_one_scan(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 4)) + [0, 1e6, 5, 0]
    x[:, 1] += x[:, 0] * 0.5
    x[r.random((500, 4)) < 0.3] = np.nan
    x = np.column_stack([x, np.full(500, 0.1), np.full(500, np.nan)])
    rows = [[None if np.isnan(v) else float(v) for v in row] for row in x]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(6))).repartition(7)
    got = {(r.a, r.b): r["corr"] for r in profile.correlations(df, df.columns).collect()}
    assert len(got) == 36
    for i in range(6):
        for j in range(6):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = np.corrcoef(x[both, i], x[both, j])[0, 1] if i < 4 and j < 4 else None
            assert got[f"c{i}", f"c{j}"] == (None if want is None else pytest.approx(want, abs=1e-9))
    plan = profile.correlations(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
    assert {r["corr"] for r in profile.correlations(df.limit(0), df.columns).collect()} <= {None}


def shapley(x, leaves, n):
    """Brute force: average gain over every coalition of features."""
    def value(known):
        total = 0.0
        for v, path in leaves:
            p = 1.0
            for f, t, left, share in path:
                p *= ((x[f] <= t) == left) if f in known else share
            total += v * p
        return total

    phi = []
    for i in range(n):
        others = [j for j in range(n) if j != i]
        s = 0.0
        for mask in range(1 << len(others)):
            known = {others[k] for k in range(len(others)) if mask >> k & 1}
            w = math.factorial(len(known)) * math.factorial(n - len(known) - 1) / math.factorial(n)
            s += w * (value(known | {i}) - value(known))
        phi.append(s)
    return phi, value(set())


def test_contributions_are_exact_and_add_up(fitted):
    fit, val = fitted
    gbt = fit.model.stages[-1]
    leaves = explain.ensemble_paths(gbt)
    x = val.select("a", "b", "c").toPandas().to_numpy()[:12]
    phi, base = explain.contributions(x, leaves)
    for row, got in zip(x, phi):
        want, empty = shapley(row, leaves, 3)
        assert list(got) == pytest.approx(want, abs=1e-9) and base == pytest.approx(empty)
    margin = [math.log(r.score / (1 - r.score)) / 2 for r in models.probability(fit.model, val).collect()[:12]]
    assert list(phi.sum(axis=1) + base) == pytest.approx(margin)
    rows = explain.explain_rows(val, gbt, ["a", "b", "c"], ["drive"], top=2)
    assert rows.groupBy("drive").count().agg(F.max("count")).first()[0] <= 2


def test_search_configs():
    grid = models.grid_configs({"a": (1, 2), "b": (3,)})
    assert grid == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]
    assert models.random_configs({"a": range(9)}, 4) == models.random_configs({"a": range(9)}, 4)
    assert [c["variation"] for c in models.one_knob_variations({"a": 1}, {"a": (1, 2, 3)})] == ["base", "a=2", "a=3"]


def test_windows_cannot_carry_the_label(spark):
    from dataclasses import replace
    days = V.events_days(spark, "/root/testdata/sf0.001")
    spec = replace(V.EVENT_SPEC, attrs=("n_click", "n_view"), log_attrs=())
    assert leakage.verify_no_label(days, spec).count() == len(spec.channels)
    with pytest.raises(ValueError):
        leakage.verify_no_label(days.withColumn("failures", F.col("failure")), replace(spec, attrs=("failures",)))


def test_fits_side_by_side_give_the_serial_table(spark, fitted):
    _, rows = fitted
    train, val = rows.where("drive % 8 = 0"), rows.where("drive % 8 = 4")
    configs = models.grid_configs({"maxDepth": (2, 3), "maxIter": (2, 3)})
    serial, beside = (models.search(train, val, ["a", "b", "c"], configs, at_once=n).collect() for n in (1, 4))
    assert serial == beside and len(serial) == 4
    rounds = models.halving_search(train, val, ["a", "b", "c"], configs, parts=(0.5, 1.0)).collect()
    assert [r["round"] for r in rounds] == [2, 2, 1, 1, 1, 1]
    assert {r["config"] for r in rounds[:2]} == {r["config"] for r in rounds[2:4]}


def test_side_by_side_keeps_order_and_bound(spark):
    import threading
    import time
    running, most, lock = [0], [0], threading.Lock()

    def task(i):
        def run():
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            time.sleep(0.05)
            with lock:
                running[0] -= 1
            return [i]
        return run
    assert models.side_by_side(spark, [task(i) for i in range(12)], 3) == [[i] for i in range(12)]
    assert most[0] == 3


def test_log_replaces_single_runs(spark, tmp_path):
    log = ex.ExperimentLog(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "variation string, v int")
    log.put("configs", rows)
    log.put("configs", rows.where("variation = 'a'").withColumn("v", F.lit(9)))
    assert sorted(map(tuple, log.read("configs").collect())) == [("a", 9), ("b", 2)]
    with pytest.raises(ValueError):
        log.put("other", rows)


def test_log_has_few_folders_for_many_runs(spark, tmp_path):
    log = ex.ExperimentLog(spark, str(tmp_path))
    rows = spark.range(500).select(F.when(F.col("id") > 0, F.col("id")).alias("variation"), F.lit(1).alias("v"))
    log.put("configs", rows)
    again = rows.where("variation IS NULL OR variation % 7 = 3").select(F.col("variation").cast("int").alias("variation"), F.lit(2).alias("v"), F.lit("x").alias("note"))
    log.put("configs", again)
    log.put("configs", again.drop("note"))
    got = {r["variation"]: r["v"] for r in log.read("configs").collect()}
    assert log.read("configs").count() == 500
    assert got == {i or None: 2 if i == 0 or i % 7 == 3 else 1 for i in range(500)}
    assert len(list((tmp_path / "configs").glob("run*"))) <= log.BUCKETS

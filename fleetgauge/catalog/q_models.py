"""Model and fleet-scoring queries. Models are small here; the settings for full runs are parameters."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import explain, features, models, ranking, rowlevel
from ..operators.experiments import head_to_head
from ..operators.scaling import Contract, fit_window_scaling
from ..plans import fleet
from ..plans.archive import run_archive, window_table
from ..plans.rows import run_rows
from ..session import settle, work_folder
from ..settings import WindowSpec, cohort_spec
from .base import query
from .q_rows import _scaled_sql, _stats_sql
from .q_timeline import BASE, split_drives
from .views import (EVENT_SPEC, EVENTS_SQL, SUPPLY_SPEC, SUPPLY_SQL, aggregate_sql, dense_sql, events_days, supply_days,
                    label_sql, supply_dense, tiles_sql)

SS = SUPPLY_SPEC
FEATS = [f"{c}__{a}" for a in ("last", "mean", "max", "delta") for c in ("q", "n")] + ["n_real"]
SMALL = dict(rounds=8, step=0.2, depth=4, subsample=1.0, patience=8)


def training_windows(spark, d):
    """Tile features with their split, settled because every fit reads them many times."""
    feats = features.window_aggregates(supply_dense(spark, d), SS, "tile", channels=("q", "n"), carry=("model",))
    return settle(feats.join(split_drives(spark, d).select("drive", "split"), "drive"))


def parts(spark, d):
    t = training_windows(spark, d)
    return {s: t.where(F.col("split") == s) for s in ("train", "val", "test")}


def boosted(spark, d):
    p = parts(spark, d)
    return models.fit_boosted(p["train"], p["val"], FEATS, **SMALL), p


@query("m1_boosted_trees", "n:i n_pos:i roc_auc:r pr_auc:r best_round:i")
def _(spark, d):
    fit, p = boosted(spark, d)
    return ranking.ranking_metrics(models.probability(fit.model, p["test"])).withColumn("best_round", F.lit(fit.best_round))


# What SQL can say about a fitted model: which windows it is tested on, and what must hold on each of them.
_TESTED = f"""{BASE}, {tiles_sql(SS)}, tested AS (SELECT t.drive, t.start, {label_sql(SS, "t")} AS label
FROM tiles t JOIN split s ON s.drive = t.drive WHERE s.split = 'test')"""


@query("m1_test_windows", "n:i n_pos:i round_in_range:i",
       f"{_TESTED} SELECT count(*) AS n, sum(label) AS n_pos, 1 AS round_in_range FROM tested")
def _(spark, d):
    fit, p = boosted(spark, d)
    tested = ranking.ranking_metrics(models.probability(fit.model, p["test"]))
    return tested.withColumn("round_in_range", F.lit(1 <= fit.best_round <= SMALL["rounds"]).cast("int"))


@query("m1_prefix_is_refit", "drive:i start:i label:i same:i", f"{_TESTED} SELECT *, 1 AS same FROM tested")
def _(spark, d):
    """The first trees of a fit score every window as a fit of only so many rounds does."""
    p = parts(spark, d)
    args = {k: v for k, v in SMALL.items() if k != "rounds"}
    whole, short = (models.fit_boosted(p["train"], p["val"], FEATS, rounds=n, **args) for n in (4, 2))
    trees = min(2, whole.best_round, short.best_round)
    cut = [PipelineModel([models.assembler(FEATS), models.first_trees(f.model.stages[-1], trees)]) for f in (whole, short)]
    both = models.probability(cut[0], models.probability(cut[1], p["test"], "alone"))
    return both.withColumn("same", (F.abs(F.col("score") - F.col("alone")) < 1e-12).cast("int"))


@query("m8_saved_scores_same", "drive:i start:i label:i same:i", f"{_TESTED} SELECT *, 1 AS same FROM tested")
def _(spark, d):
    fit, p = boosted(spark, d)
    path = f"{work_folder(spark)}/model"
    fit.model.save(path)
    both = models.probability(PipelineModel.load(path), models.probability(fit.model, p["test"], "live"))
    in_unit = F.col("score").between(0, 1) & (F.col("score") == F.col("live"))
    return both.withColumn("same", in_unit.cast("int"))


@query("m9_contributions_add_up", "drive:i start:i adds_up:i", f"{_TESTED} SELECT drive, start, 1 AS adds_up FROM tested")
def _(spark, d):
    fit, p = boosted(spark, d)
    gbt, keys = fit.model.stages[-1], ["drive", "start"]
    told = explain.explain_rows(p["test"], gbt, FEATS, keys, top=len(FEATS)).groupBy(*keys).agg(F.sum("contribution").alias("told"))
    _, base = explain.contributions(np.zeros((1, len(FEATS))), explain.ensemble_paths(gbt))
    margin = fit.model.transform(p["test"]).select(*keys, vector_to_array("rawPrediction")[1].alias("margin"))
    off = F.abs(F.coalesce("told", F.lit(0.0)) + F.lit(float(base)) - F.col("margin"))
    # Contributions of up to 1e-6 are left out of the explanation.
    return margin.join(told, keys, "left").withColumn("adds_up", (off < 1e-6 * (len(FEATS) + 1)).cast("int"))


@query("e35_round_history", "epoch:i train_pr_auc:r val_pr_auc:r train_roc_auc:r val_roc_auc:r train_loss:r val_loss:r "
       "pr_auc_gap_pct:r overfit_flag:i overfit_reasons:s")
def _(spark, d):
    return boosted(spark, d)[0].history


@query("m2_depth_ladder", "max_depth:i depth:i leaves:i train_accuracy:r train_balanced_accuracy:r train_pr_auc:r test_accuracy:r "
       "test_balanced_accuracy:r test_pr_auc:r")
def _(spark, d):
    p = parts(spark, d)
    return models.depth_ladder(p["train"], p["test"], FEATS, depths=(2, 4, 8))


@query("m3_feed_forward", "n:i n_pos:i roc_auc:r pr_auc:r")
def _(spark, d):
    split = split_drives(spark, d)
    _, feats = window_table(supply_days(spark, d), split, replace(SS, lags=(7,)))
    t = settle(feats)
    names = replace(SS, lags=(7,)).feature_names
    net = models.fit_network(t.where("split = 'train'"), names, hidden=(16,), max_iter=30)
    return ranking.ranking_metrics(models.probability(net, t.where("split = 'test'")))


@query("m3_scores_in_unit", "drive:i start:i label:i in_unit:i", f"{_TESTED} SELECT *, 1 AS in_unit FROM tested")
def _(spark, d):
    """A network scores every test window, and gives each a probability."""
    spec = replace(SS, lags=(7,))
    t = settle(window_table(supply_days(spark, d), split_drives(spark, d), spec)[1])
    net = models.fit_network(t.where("split = 'train'"), spec.feature_names, hidden=(4,), max_iter=5)
    return models.probability(net, t.where("split = 'test'")).withColumn("in_unit", F.col("score").between(0, 1).cast("int"))


@query("m4_remaining_life", "n:i mae:r rmse:r r2:r baseline_mae:r")
def _(spark, d):
    rows = rowlevel.row_features(rowlevel.with_target(supply_days(spark, d), 30), ("q", "n"), (7,), 30)
    life = rowlevel.remaining_life_rows(rows, 60).join(split_drives(spark, d).select("drive", "split"), "drive")
    t = settle(life)
    names = ["q", "n", "q_mean30", "n_mean30", "q_max30", "drive_age_days"]
    filled = t.fillna(0.0, names)
    model = models.fit_remaining_life(filled.where("split <> 'test'"), names, rounds=8, depth=3)
    return ranking.regression_metrics(models.predict_life(model, filled.where("split = 'test'")), "days_to_failure", "prediction")


@query("m5_search", "config:s pr_auc:r roc_auc:r")
def _(spark, d):
    p = parts(spark, d)
    configs = models.one_knob_variations({"maxIter": 4, "maxDepth": 3, "stepSize": 0.2}, {"maxDepth": (2, 4), "stepSize": (0.5,)})
    return models.search(p["train"], p["val"], FEATS, configs)


def _facts(rows, space: int):
    """What must hold for every scored config: a known name once, and metrics between 0 and 1, or none where validation has one class."""
    off = ~F.col("pr_auc").between(0, 1) | ~F.col("roc_auc").between(0, 1)
    return rows.select("config", F.when(off, 0).otherwise(1).alias("in_range"), F.lit(space).alias("configs"))


@query("m5_search_covers_all", "config:s in_range:i configs:i",
       """SELECT 'maxDepth=' || a || ', maxIter=' || b AS config, 1 AS in_range, 4 AS configs FROM (VALUES (2), (3)) x(a), (VALUES (2), (4)) y(b)""")
def _(spark, d):
    p = parts(spark, d)
    return _facts(models.search(p["train"], p["val"], FEATS, models.grid_configs({"maxDepth": (2, 3), "maxIter": (2, 4)})), 4)


@query("m5_halving_rounds", "round:i configs:i best_goes_on:i", "SELECT * FROM (VALUES (1, 4, 1), (2, 2, 1), (3, 1, 1)) t(round, configs, best_goes_on)")
def _(spark, d):
    """Of four configs two reach the second round and one the last, always the better ones."""
    p = parts(spark, d)
    found = settle(models.halving_search(p["train"], p["val"], FEATS, models.grid_configs({"maxDepth": (2, 3), "maxIter": (2, 4)})))
    later = found.select((F.col("round") - 1).alias("round"), "config", F.lit(1).alias("on"))
    place = F.row_number().over(Window.partitionBy("round").orderBy(F.col("pr_auc").desc_nulls_last(), "config"))      # a row per config
    best = found.withColumn("place", place).join(later, ["round", "config"], "left")
    return best.groupBy("round").agg(F.count(F.lit(1)).alias("configs"), F.max(F.when(F.col("place") == 1, F.when((F.col("on") == 1) | (F.col("round") == 3), 1).otherwise(0))).alias("best_goes_on"))


@query("m6_family_study", "family:s trained_on:s n:i n_pos:i pr_auc:r roc_auc:r")
def _(spark, d):
    p = parts(spark, d)
    return models.family_study(p["train"], p["test"], FEATS, ("M0", "M1"), max_iter=4, depth=3)


_PARTED = f"""{BASE}, {tiles_sql(SS)}, parted AS (SELECT t.drive, t.start, 'M' || (t.drive % 4) AS model, s.split, {label_sql(SS, "t")} AS label
FROM tiles t JOIN split s ON s.drive = t.drive)"""
_BOTH = "(SELECT count(DISTINCT label) FROM parted WHERE split = 'train'{0}) = 2"


@query("m6_families_tested", "family:s trained_on:s n:i n_pos:i",
       _PARTED + " UNION ALL ".join(
           f" SELECT model AS family, '{kind}' AS trained_on, count(*) AS n, sum(label) AS n_pos FROM parted "
           f"WHERE split = 'test' AND model = '{name}' AND {_BOTH.format(where)} GROUP BY model"
           for name in ("M0", "M1") for kind, where in (("pooled", ""), ("own", f" AND model = '{name}'"), ("unseen", f" AND model <> '{name}'"))))
def _(spark, d):
    """Which windows each family's three models are tested on."""
    p = parts(spark, d)
    return models.family_study(p["train"], p["test"], FEATS, ("M0", "M1"), max_iter=2, depth=2)


@query("m7_importance_sums", "features:i total:r nonnegative:i", f"SELECT {len(FEATS)} AS features, 1.0 AS total, {len(FEATS)} AS nonnegative FROM (SELECT count(*) FROM lineitem)")
def _(spark, d):
    fit, _ = boosted(spark, d)
    gains = models.feature_importance(fit.model, FEATS, spark)
    return gains.agg(F.count(F.lit(1)).alias("features"), F.sum("gain").alias("total"), F.sum((F.col("gain") >= 0).cast("int")).alias("nonnegative"))


@query("m7_feature_importance", "feature:s gain:r")
def _(spark, d):
    fit, _ = boosted(spark, d)
    return models.feature_importance(fit.model, FEATS, spark, top=20)


@query("m8_saved_model_scoring", "drive:i start:i label:i score:r same:i")
def _(spark, d):
    fit, p = boosted(spark, d)
    path = f"{work_folder(spark)}/model"
    fit.model.save(path)
    loaded = PipelineModel.load(path)
    live = models.probability(fit.model, p["test"], "_live")
    return models.probability(loaded, live).select(
        "drive", "start", "label", "score", (F.col("score") == F.col("_live")).cast("int").alias("same"))


@query("m8_batch_scorer", "drive:i start:i score:r",
       f"""WITH {SUPPLY_SQL}, {dense_sql(SS)}, {tiles_sql(SS)}, {aggregate_sql(SS, ("q", "n"))}
       SELECT drive, start, (q__max / 160.0 + n__mean) / 2 AS score FROM feat""")
def _(spark, d):
    feats = features.window_aggregates(supply_dense(spark, d), SS, "tile", channels=("q", "n"), aggregates=("max", "mean"))
    return models.batch_scorer(lambda b: (b["q__max"] / 160 + b["n__mean"]) / 2, ["q__max", "n__mean"])(feats)


@query("m9_contributions", "drive:i start:i feature:s contribution:r value:r")
def _(spark, d):
    fit, p = boosted(spark, d)
    return explain.explain_rows(p["test"], fit.model.stages[-1], FEATS, ["drive", "start"])


@query("m10_model_winner", "metric:s first:r second:r winner:s")
def _(spark, d):
    fit, p = boosted(spark, d)
    net = models.fit_network(p["train"], FEATS, hidden=(8,), max_iter=20)
    a = ranking.ranking_metrics(models.probability(fit.model, p["test"])).select("roc_auc", "pr_auc")
    b = ranking.ranking_metrics(models.probability(net, p["test"])).select("roc_auc", "pr_auc")
    return head_to_head(a, b, ("trees", "network"))


@query("plan_archive_run", "tp:i fp:i fn:i tn:i precision:r recall:r f1:r roc_auc:r pr_auc:r")
def _(spark, d):
    # The supply label is built from q, so the audit would block it; the run is asked to use it anyway.
    spec = replace(SS, attrs=("n", "disc"), lags=(7,))
    return run_archive(supply_days(spark, d), spec, **SMALL).metrics


@query("plan_archive_counts", "n:i n_pos:i", f"{_TESTED} SELECT count(*) AS n, sum(label) AS n_pos FROM tested")
def _(spark, d):
    done = run_archive(supply_days(spark, d), replace(SS, attrs=("n", "disc"), lags=(7,)), **SMALL).metrics
    return done.select((F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), (F.col("tp") + F.col("fn")).alias("n_pos"))


@query("plan_cohort_run", "tp:i fp:i fn:i tn:i precision:r recall:r f1:r roc_auc:r pr_auc:r")
def _(spark, d):
    spec = cohort_spec(("n", "disc"), horizon=30, stride=30, lags=(7,))
    return run_archive(supply_days(spark, d), spec, cover="stride", **SMALL).metrics


@query("plan_row_run", "tp:i fp:i fn:i tn:i precision:r recall:r f1:r roc_auc:r pr_auc:r")
def _(spark, d):
    return run_rows(supply_days(spark, d), ("q", "n"), (7,), 30, tolerance=400, life_rounds=4, **SMALL).metrics


# ---- fleet scoring -------------------------------------------------------------------------------

WIN = 20
_PAD = WindowSpec(attrs=("n_click", "n_view"), days=WIN, horizon=3, min_days=WIN, lags=(1,))
_SERVE = replace(_PAD, pad_short=True, min_days=fleet.padded_floor(WIN))


def fleet_contract(spark, d):
    dense = cal.densify(events_days(spark, d), _SERVE)
    return Contract(_PAD, fit_window_scaling(dense, _PAD), 0.6)


def _first(rows):
    z = F.col("n_click__mean") * 2 + F.col("n_view__max") * 0.3 + F.col("observed__mean") - 1
    return rows.withColumn("first", F.round(1 / (1 + F.exp(-z)), 6))


def _second(rows):
    z = F.col("n_click__last") - F.col("n_view__delta") * 0.5
    return rows.withColumn("second", F.round(1 / (1 + F.exp(-z)), 6))


SCORERS = {"first": (_first, 0.6), "second": (_second, 0.5)}


def upload(spark, d):
    """The event drive-days under foreign headers, without one attribute's canonical spelling."""
    days = events_days(spark, d)
    return days.select(F.col("drive").alias("Serial"), F.col("day").alias("timestamp"), F.col("model").alias("drive_model"),
                       F.col("failure").alias("Failed"), F.col("n_click").alias("N_CLICK"), "n_view")


def scored_fleet(spark, d):
    return fleet.score_fleet(upload(spark, d), fleet_contract(spark, d), SCORERS)


_CH = _SERVE.channels
FLEET_SQL = f"""{EVENTS_SQL}, {dense_sql(_SERVE)},
seen AS (SELECT * FROM chan WHERE observed = 1), stats AS ({_stats_sql("seen", _CH)}),
sc AS (SELECT drive, pos, n_days, day, observed AS obs, {_scaled_sql("chan", _CH)} FROM chan),
lw AS (SELECT *, n_days < {WIN} AS short FROM sc WHERE pos >= n_days - {WIN}),
agg AS (SELECT drive, max(n_days) AS days_available, min(day) AS start_day, max(day) AS end_day, sum(obs) AS n_real,
          count(*) - sum(obs) AS n_filled, {WIN} - count(*) AS n_padded,
          sum(n_click) / {WIN}.0::DOUBLE AS n_click__mean, sum(observed) / {WIN}.0::DOUBLE AS observed__mean,
          CASE WHEN bool_or(short) THEN greatest(max(n_view), 0) ELSE max(n_view) END AS n_view__max,
          max(CASE WHEN pos = n_days - 1 THEN n_click END) AS n_click__last,
          max(CASE WHEN pos = n_days - 1 THEN n_view END) - CASE WHEN bool_or(short) THEN 0 ELSE max(CASE WHEN pos = n_days - {WIN} THEN n_view END) END AS n_view__delta
        FROM lw GROUP BY drive),
meta AS (SELECT drive, max(model) AS model, max(failure) AS recorded_failure FROM dd GROUP BY drive),
scored AS (SELECT CAST(agg.drive AS VARCHAR) AS drive, agg.* EXCLUDE (drive), meta.model, meta.recorded_failure,
   round(1 / (1 + exp(-(n_click__mean * 2 + n_view__max * 0.3 + observed__mean - 1))), 6) AS first,
   round(1 / (1 + exp(-(n_click__last - n_view__delta * 0.5))), 6) AS second FROM agg JOIN meta ON meta.drive = agg.drive),
fleet AS (SELECT *, CASE WHEN first >= 0.6 THEN 'inspect' ELSE 'hold' END AS call_first, CASE WHEN second >= 0.5 THEN 'inspect' ELSE 'hold' END AS call_second,
   row_number() OVER (ORDER BY first DESC, md5(drive), drive) AS rank FROM scored)"""

_ROWS = ("rank:i drive:s first:r second:r call_first:s call_second:s model:s recorded_failure:i start_day:d end_day:d n_real:i "
         "n_filled:i n_padded:i days_available:i")


@query("a1_score_fleet", _ROWS, f"WITH {FLEET_SQL} SELECT * FROM fleet")
def _(spark, d):
    return scored_fleet(spark, d).rows


@query("a1_score_fleet_strict", "rank:i drive:s first:r n_padded:i",
       f"WITH {FLEET_SQL} SELECT row_number() OVER (ORDER BY first DESC, md5(drive), drive) AS rank, drive, first, n_padded "
       f"FROM scored WHERE days_available >= {WIN}")
def _(spark, d):
    return fleet.score_fleet(upload(spark, d), fleet_contract(spark, d), SCORERS, pad_short=False).rows


@query("a2_too_short", "drive:s days:i",
       f"""WITH {EVENTS_SQL} SELECT CAST(drive AS VARCHAR) AS drive, datediff('day', min(day), max(day)) + 1 AS days FROM dd
       GROUP BY drive HAVING datediff('day', min(day), max(day)) + 1 < 25""")
def _(spark, d):
    readings, _, _ = fleet.coerce_upload(upload(spark, d), _PAD.attrs)
    return fleet.eligibility(readings, 25)[1]


@query("a3_diagnostics", "rows:i drives_in_file:i date_min:d date_max:d has_truth:i drives_scored:i drives_padded:i drives_skipped:i "
       "attributes_found:s attributes_missing:s",
       f"""WITH {FLEET_SQL} SELECT (SELECT count(*) FROM dd) AS rows, (SELECT count(DISTINCT drive) FROM dd) AS drives_in_file,
       (SELECT min(day) FROM dd) AS date_min, (SELECT max(day) FROM dd) AS date_max, (SELECT max(failure) FROM dd) AS has_truth,
       count(*) AS drives_scored, count(*) FILTER (WHERE n_padded > 0) AS drives_padded,
       (SELECT count(DISTINCT drive) FROM dd) - count(*) AS drives_skipped, 'n_click,n_view' AS attributes_found, '' AS attributes_missing FROM fleet""")
def _(spark, d):
    return scored_fleet(spark, d).diagnostics


@query("a4_call_summary", "scorer:s inspect:i hold:i max_risk:r",
       f"""WITH {FLEET_SQL} SELECT 'first' AS scorer, count(*) FILTER (WHERE call_first = 'inspect') AS inspect,
       count(*) FILTER (WHERE call_first = 'hold') AS hold, max(first) AS max_risk FROM fleet UNION ALL
       SELECT 'second', count(*) FILTER (WHERE call_second = 'inspect'), count(*) FILTER (WHERE call_second = 'hold'), max(second) FROM fleet""")
def _(spark, d):
    return scored_fleet(spark, d).summary


@query("a4_fleet_agreement", "n:i both:i only_first:i only_second:i",
       f"""WITH {FLEET_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE first >= 0.6 AND second >= 0.5) AS both,
       count(*) FILTER (WHERE first >= 0.6 AND second < 0.5) AS only_first, count(*) FILTER (WHERE first < 0.6 AND second >= 0.5) AS only_second FROM fleet""")
def _(spark, d):
    return scored_fleet(spark, d).agreement


@query("a5_top_rows", "rank:i drive:s first:r", f"WITH {FLEET_SQL} SELECT * FROM fleet WHERE rank <= 500")
def _(spark, d):
    return scored_fleet(spark, d).top()


@query("a6_latest_values", "drive:i readings:i n_click:i m_error:r m_view:r",
       f"""WITH {EVENTS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY day DESC) AS back FROM dd)
       SELECT drive, count(*) AS readings, arg_max(n_click, day) AS n_click, arg_max(m_error, day) AS m_error, arg_max(m_view, day) AS m_view
       FROM b WHERE back <= 7 GROUP BY drive""")
def _(spark, d):
    return fleet.latest_values(events_days(spark, d), ("n_click", "m_error", "m_view"), EVENT_SPEC.days)


_TW = replace(_PAD, days=10, min_days=10)


@query("a6_trajectory", "drive:i start:i end_day:d second:r",
       f"""WITH {EVENTS_SQL}, {dense_sql(replace(_TW, pad_short=False))}, seen AS (SELECT * FROM chan WHERE observed = 1), stats AS ({_stats_sql("seen", _TW.channels)}),
       sc AS (SELECT drive, pos, n_days, day, {_scaled_sql("chan", ("n_click", "n_view"))} FROM chan)
       SELECT e.drive, e.pos - 9 AS start, e.day AS end_day, round(1 / (1 + exp(-(e.n_click - (e.n_view - s.n_view) * 0.5))), 6) AS second
       FROM sc e JOIN sc s ON s.drive = e.drive AND s.pos = e.pos - 9 WHERE e.pos >= e.n_days - 20""")
def _(spark, d):
    days = events_days(spark, d)
    contract = Contract(_TW, fit_window_scaling(cal.densify(days, _TW), _TW), 0.5)
    return fleet.trajectory(days, contract, _second, days=20, pad_short=False)

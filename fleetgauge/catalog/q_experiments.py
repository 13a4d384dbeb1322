"""Experiment-log queries. Each event user stands for a training run and each of its days for an epoch;
the metrics are fixed arithmetic of the day's events, so the log grows with the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import experiments as ex
from ..operators import ranking as rk
from ..session import settle, work_folder
from .base import query
from .q_ranking import conf_sql
from .views import EVENTS_SQL, SCORED_SQL, events_days, scored_windows

EPOCHS_SQL = f"""{EVENTS_SQL},
ep0 AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY day) AS epoch FROM dd),
ep AS (SELECT drive AS variation, epoch, model,
   round(0.3 + 0.02 * epoch + coalesce(m_view, 0) / 1000, 6) AS train_pr_auc, round(0.3 + m_click / 500, 6) AS val_pr_auc,
   round(0.7 + 0.01 * epoch, 6) AS train_roc_auc, round(0.7 + coalesce(m_purchase, 0) / 2000, 6) AS val_roc_auc,
   round(0.5 + 0.01 * epoch, 6) AS train_bal_acc, round(0.5 + coalesce(m_view, 0) / 2000, 6) AS val_bal_acc,
   round(1.0::DOUBLE / (1 + epoch), 6) AS train_loss, round(0.1 + coalesce(m_signup, 0) / 1000, 6) AS val_loss FROM ep0)"""
WITH = f"WITH {EPOCHS_SQL}"
METRICS = {"pr_auc": 1, "roc_auc": 1, "bal_acc": 1, "loss": -1}
LIMITS = {"pr_auc": 15, "roc_auc": 3, "bal_acc": 10, "loss": 25}


def epochs(spark, d):
    days = events_days(spark, d).withColumn("epoch", F.row_number().over(Window.partitionBy("drive").orderBy("day")))

    def m(name, default=0.0):
        return F.coalesce(F.col(name), F.lit(default))

    e = F.col("epoch")
    exprs = {"train_pr_auc": 0.3 + 0.02 * e + m("m_view") / 1000, "val_pr_auc": 0.3 + F.col("m_click") / 500,
             "train_roc_auc": 0.7 + 0.01 * e, "val_roc_auc": 0.7 + m("m_purchase") / 2000,
             "train_bal_acc": 0.5 + 0.01 * e, "val_bal_acc": 0.5 + m("m_view") / 2000,
             "train_loss": 1.0 / (1 + e), "val_loss": 0.1 + m("m_signup") / 1000}
    return days.select(F.col("drive").alias("variation"), "epoch", "model",
                       *[F.round(x, 6).alias(c) for c, x in exprs.items()])


def _gap(m: str) -> str:
    t, v = f"train_{m}", f"val_{m}"
    return (f"100 * (({t} - {v}) / nullif({v}, 0))" if METRICS[m] == 1 else f"100 * (({v} - {t}) / nullif({t}, 0))")


_GAPS = f"""gp AS (SELECT *, {", ".join(f"{_gap(m)} AS {m}_gap_pct" for m in METRICS)} FROM ep),
fl AS (SELECT *, CASE WHEN {" OR ".join(f"{m}_gap_pct > {x}" for m, x in LIMITS.items())} THEN 1 ELSE 0 END AS overfit_flag,
  concat_ws('; ', {", ".join(f"CASE WHEN {m}_gap_pct > {x} THEN '{m} ' || printf('%.1f', {m}_gap_pct) || '%>{x}%' END" for m, x in LIMITS.items())}) AS overfit_reasons
  FROM gp)"""


@query("e22_overfit_gaps", "variation:i epoch:i pr_auc_gap_pct:r roc_auc_gap_pct:r bal_acc_gap_pct:r loss_gap_pct:r overfit_flag:i overfit_reasons:s",
       f"{WITH}, {_GAPS} SELECT * FROM fl")
def _(spark, d):
    return ex.with_gaps(epochs(spark, d))


def _div_sql(m: str) -> str:
    s = METRICS[m]
    return f"""d1_{m} AS (SELECT variation, epoch, {s} * train_{m} AS t, {s} * val_{m} AS v FROM ep),
d2_{m} AS (SELECT *, lag(t) OVER w AS pt, lag(v) OVER w AS pv FROM d1_{m} WINDOW w AS (PARTITION BY variation ORDER BY epoch)),
b_{m} AS (SELECT variation, min(epoch) AS b FROM d1_{m} x WHERE v = (SELECT max(v) FROM d1_{m} y WHERE y.variation = x.variation) GROUP BY variation),
d3_{m} AS (SELECT d.variation, d.epoch, CASE WHEN d.epoch > b AND t >= pt AND t - v > pt - pv THEN 1 ELSE 0 END AS dv
           FROM d2_{m} d JOIN b_{m} ON b_{m}.variation = d.variation),
d4_{m} AS (SELECT variation, epoch, dv, lead(dv, 1) OVER (PARTITION BY variation ORDER BY epoch) AS dn FROM d3_{m}),
div_{m} AS (SELECT e.variation, min(CASE WHEN dv = 1 AND dn = 1 THEN d4_{m}.epoch END) AS divergence_epoch_{m}
            FROM (SELECT DISTINCT variation FROM ep) e LEFT JOIN d4_{m} ON d4_{m}.variation = e.variation GROUP BY e.variation)"""


_DIVS = ", ".join(_div_sql(m) for m in METRICS)


@query("e23_divergence", "variation:i divergence_epoch:i",
       f"{WITH}, {_div_sql('pr_auc')} SELECT variation, divergence_epoch_pr_auc AS divergence_epoch FROM div_pr_auc")
def _(spark, d):
    return ex.divergence(epochs(spark, d), "pr_auc")


@query("e23_divergence_loss", "variation:i divergence_epoch:i",
       f"{WITH}, {_div_sql('loss')} SELECT variation, divergence_epoch_loss AS divergence_epoch FROM div_loss")
def _(spark, d):
    return ex.divergence(epochs(spark, d), "loss")


_DIAG = f"""{_GAPS}, {_DIVS},
best AS (SELECT variation, epoch AS best_epoch FROM (SELECT variation, epoch, row_number() OVER (PARTITION BY variation ORDER BY val_pr_auc DESC, epoch) AS rn
         FROM ep WHERE val_pr_auc IS NOT NULL) x WHERE rn = 1),
run AS (SELECT f.variation, best_epoch, count(*) AS epochs_run, max(epoch) AS stopped_epoch,
          min(epoch) FILTER (WHERE overfit_flag = 1) AS first_flagged_epoch, sum(overfit_flag) AS n_flagged_epochs,
          max(overfit_flag) FILTER (WHERE epoch = best_epoch) AS flagged_at_best,
          arg_max(overfit_flag, epoch) AS flagged_at_stop, arg_max(overfit_reasons, epoch) AS reasons_at_stop,
          max(overfit_reasons) FILTER (WHERE epoch = best_epoch) AS reasons_at_best,
          arg_max(CASE WHEN val_pr_auc > 0.5 THEN 'target reached' ELSE 'epochs used up' END, epoch) AS stop_reason,
          max(pr_auc_gap_pct) FILTER (WHERE epoch = best_epoch) AS pr_auc_gap_pct_at_best,
          max(loss_gap_pct) FILTER (WHERE epoch = (SELECT max(epoch) FROM ep z WHERE z.variation = f.variation)) AS loss_gap_pct_at_stop
        FROM fl f JOIN best ON best.variation = f.variation GROUP BY f.variation, best_epoch),
dg AS (SELECT run.*, least(divergence_epoch_pr_auc, divergence_epoch_roc_auc, divergence_epoch_bal_acc, divergence_epoch_loss) AS divergence_epoch,
          divergence_epoch_pr_auc AS e1, divergence_epoch_roc_auc AS e2, divergence_epoch_bal_acc AS e3, divergence_epoch_loss AS e4
       FROM run {" ".join(f"JOIN div_{m} ON div_{m}.variation = run.variation" for m in METRICS)}),
diag AS (SELECT *, CASE divergence_epoch WHEN e1 THEN 'pr_auc' WHEN e2 THEN 'roc_auc' WHEN e3 THEN 'bal_acc' WHEN e4 THEN 'loss' END AS divergence_metric,
       CASE WHEN flagged_at_best = 1 THEN 'overfit at best epoch' WHEN n_flagged_epochs > 0 THEN 'overfit after best epoch'
            WHEN divergence_epoch IS NOT NULL THEN 'early divergence' ELSE 'no overfitting' END AS status FROM dg)"""


@query("e24_diagnostics", "variation:i best_epoch:i epochs_run:i stopped_epoch:i first_flagged_epoch:i n_flagged_epochs:i flagged_at_best:i "
       "flagged_at_stop:i pr_auc_gap_pct_at_best:r loss_gap_pct_at_stop:r divergence_epoch:i divergence_metric:s status:s "
       "reasons_at_best:s reasons_at_stop:s stop_reason:s",
       f"{WITH}, {_DIAG} SELECT * FROM diag")
def _(spark, d):
    reason = F.when(F.col("val_pr_auc") > 0.5, "target reached").otherwise("epochs used up")
    return ex.diagnose(epochs(spark, d).withColumn("stop_reason", reason))


@query("e25_early_stop", "variation:i best_epoch:i stop_epoch:i",
       f"""WITH RECURSIVE {EPOCHS_SQL}, walk AS (
         SELECT variation, 0 AS epoch, CAST('-inf' AS DOUBLE) AS best, 0 AS hit, 0 AS bad, 0 AS stopped FROM (SELECT DISTINCT variation FROM ep) v
         UNION ALL
         SELECT w.variation, e.epoch, CASE WHEN coalesce(e.val_pr_auc > best + 0.001, false) THEN e.val_pr_auc ELSE best END,
                CASE WHEN coalesce(e.val_pr_auc > best + 0.001, false) THEN e.epoch ELSE hit END,
                CASE WHEN coalesce(e.val_pr_auc > best + 0.001, false) THEN 0 ELSE bad + 1 END,
                CASE WHEN coalesce(e.val_pr_auc > best + 0.001, false) THEN 0 WHEN bad + 1 >= 3 THEN 1 ELSE 0 END
         FROM walk w JOIN ep e ON e.variation = w.variation AND e.epoch = w.epoch + 1 WHERE w.stopped = 0)
       SELECT variation, arg_max(hit, epoch) AS best_epoch, max(CASE WHEN stopped = 1 THEN epoch END) AS stop_epoch FROM walk GROUP BY variation""")
def _(spark, d):
    return ex.early_stop(epochs(spark, d))


# A leaderboard has one row per model: runs are pooled into 50 models, whatever the size of the log.
MODELS_SQL = f"""{EPOCHS_SQL}, models AS (SELECT variation % 50 AS model, 'F' || (variation % 50 % 4) AS family,
  round(avg(val_pr_auc), 3) AS val_pr_auc, max(val_roc_auc) AS test_pr_auc, round(1 - 1 / sqrt(count(*)), 2) AS drive_p100,
  CASE WHEN variation % 50 % 5 = 0 THEN 'tiling' ELSE 'stride' END AS protocol FROM ep GROUP BY variation % 50),
board AS (SELECT *, row_number() OVER (ORDER BY drive_p100 DESC NULLS LAST, test_pr_auc DESC NULLS LAST, model) AS rank,
  CASE WHEN max(val_pr_auc) OVER (PARTITION BY family) IS NULL OR val_pr_auc = max(val_pr_auc) OVER (PARTITION BY family) THEN 1 ELSE 0 END AS family_winner
  FROM models)"""


def models(spark, d):
    e = epochs(spark, d)
    got = e.groupBy((F.col("variation") % 50).alias("model")).agg(
        F.round(F.avg("val_pr_auc"), 3).alias("val_pr_auc"), F.max("val_roc_auc").alias("test_pr_auc"),
        F.round(1 - 1 / F.sqrt(F.count(F.lit(1))), 2).alias("drive_p100"))
    return got.withColumn("family", F.concat(F.lit("F"), F.col("model") % 4)).withColumn(
        "protocol", F.when(F.col("model") % 5 == 0, "tiling").otherwise("stride"))


_BOARD = "model:i family:s val_pr_auc:r test_pr_auc:r drive_p100:r rank:i family_winner:i"


@query("e18_leaderboard", _BOARD, f"WITH {MODELS_SQL} SELECT * FROM board")
def _(spark, d):
    return ex.leaderboard(models(spark, d))


@query("e19_family_winners", _BOARD, f"WITH {MODELS_SQL} SELECT * FROM board WHERE family_winner = 1")
def _(spark, d):
    return ex.family_winners(ex.leaderboard(models(spark, d)))


@query("e19_selected_models", _BOARD,
       f"""WITH {MODELS_SQL} SELECT * REPLACE (row_number() OVER (ORDER BY drive_p100 DESC NULLS LAST, test_pr_auc DESC NULLS LAST, model) AS rank)
       FROM board WHERE family IN ('F0', 'F1', 'F2') AND (family <> 'F2' OR family_winner = 1)""")
def _(spark, d):
    return ex.select_models(ex.leaderboard(models(spark, d)), ("F0", "F1", "F2"), ("F2",))


def _verdict_sql(col: str) -> str:
    return f"""t AS (SELECT model, {col} AS v, row_number() OVER (ORDER BY {col} DESC, model) AS r FROM board WHERE {col} IS NOT NULL),
    ab AS (SELECT a.model AS ma, a.v AS va, b.model AS mb, b.v AS vb FROM t a, t b WHERE a.r = 1 AND b.r = 2)
    SELECT CASE WHEN va <= 0 OR 100 * (va - vb) / va < 5 THEN ma || ' and ' || mb || ' are tied (' || printf('%.4f', va) || ' vs ' || printf('%.4f', vb) || ')'
           ELSE ma || ' (' || printf('%.4f', va) || ', next best ' || mb || ' at ' || printf('%.4f', vb) || ')' END AS verdict FROM ab"""


@query("e20_verdict", "verdict:s", f"WITH {MODELS_SQL}, {_verdict_sql('test_pr_auc')}")
def _(spark, d):
    return ex.verdict(ex.leaderboard(models(spark, d)), "test_pr_auc")


@query("e20_verdict_by_rank", "verdict:s", f"WITH {MODELS_SQL}, {_verdict_sql('drive_p100')}")
def _(spark, d):
    return ex.verdict(ex.leaderboard(models(spark, d)), "drive_p100")


@query("e21_merge_results", "model:i family:s val_pr_auc:r test_pr_auc:r",
       f"""WITH {MODELS_SQL}, fresh AS (SELECT model, family, val_pr_auc + 0.1 AS val_pr_auc, test_pr_auc FROM models WHERE model % 3 = 0),
       old AS (SELECT * FROM models WHERE model % 2 = 0)
       SELECT model, family, val_pr_auc, test_pr_auc FROM old WHERE model NOT IN (SELECT model FROM fresh)
       UNION ALL SELECT * FROM fresh""")
def _(spark, d):
    m = models(spark, d)
    fresh = m.where("model % 3 = 0").withColumn("val_pr_auc", F.col("val_pr_auc") + 0.1)
    return ex.merge_results(m.where("model % 2 = 0"), fresh)


@query("e26_run_summary", "variation:i protocol:s val_pr_auc:r rank_by_val:i",
       f"""WITH {MODELS_SQL} SELECT model AS variation, protocol, val_pr_auc,
       row_number() OVER (PARTITION BY protocol ORDER BY val_pr_auc DESC NULLS LAST, model) AS rank_by_val FROM models""")
def _(spark, d):
    return ex.summarise_runs(models(spark, d).withColumnRenamed("model", "variation"))


@query("e26_best_run", "variation:i protocol:s val_pr_auc:r",
       f"""WITH {MODELS_SQL} SELECT model AS variation, protocol, val_pr_auc FROM models
       WHERE protocol = (SELECT protocol FROM models GROUP BY protocol ORDER BY count(*) DESC, protocol LIMIT 1)
       ORDER BY val_pr_auc DESC NULLS LAST, model LIMIT 1""")
def _(spark, d):
    return ex.best_run(models(spark, d).withColumnRenamed("model", "variation"))


@query("e27_experiment_log", "variation:i best_epoch:i stopped_epoch:i divergence_epoch:i overfitting_triggered:s status:s train_pr_auc:r val_pr_auc:r pr_auc_gap_pct:r",
       f"""{WITH}, {_DIAG} SELECT diag.variation, diag.best_epoch, stopped_epoch, divergence_epoch,
       CASE WHEN n_flagged_epochs > 0 THEN 'Yes' ELSE 'No' END AS overfitting_triggered, status, train_pr_auc, val_pr_auc, pr_auc_gap_pct
       FROM diag JOIN fl ON fl.variation = diag.variation AND fl.epoch = diag.best_epoch""")
def _(spark, d):
    log = ex.ExperimentLog(spark, work_folder(spark))
    runs = epochs(spark, d).drop("model")
    log.add(runs.where("variation % 2 = 0").withColumn("val_pr_auc", F.col("val_pr_auc") / 2))
    return log.add(runs)                    # the second add replaces the even runs


_M = ("precision", "recall", "f1", "balanced_accuracy", "base_rate")


@query("m10_head_to_head", "metric:s first:r second:r winner:s",
       f"""WITH {SCORED_SQL}, a AS ({conf_sql('scored', '>=', 0.35)}),
       b AS (SELECT * FROM ({conf_sql("(SELECT score_b AS score, label FROM scored)", ">=", 0.6)}) x),
       l AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, round(a.{m}, 4) AS first, round(b.{m}, 4) AS second FROM a, b" for m in _M)})
       SELECT *, CASE WHEN first > second THEN 'trees' WHEN first < second THEN 'network' ELSE 'Tie' END AS winner FROM l""")
def _(spark, d):
    rows = settle(scored_windows(spark, d).select("label", "score", "score_b"))
    a = rk.confusion(rows, 0.35).select(*_M)
    b = rk.confusion(rows, 0.6, score="score_b").select(*_M)
    return ex.head_to_head(a, b, ("trees", "network"))

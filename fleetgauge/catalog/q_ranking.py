"""Evaluation queries over the scored windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import ranking as rk
from ..session import settle
from .base import query
from .views import (DRIVE_SCORES_SQL, SCORED_SQL, SUPPLY_SPEC, SUPPLY_SQL, census_sql, scored_windows, supply_days)

WITH = f"WITH {SCORED_SQL}"
WITH_DRIVES = f"{WITH}, {DRIVE_SCORES_SQL}"
T = 0.35
_CONF = """count(*) FILTER (WHERE score {op} {t} AND label = 1) AS tp, count(*) FILTER (WHERE score {op} {t} AND label = 0) AS fp,
 count(*) FILTER (WHERE NOT score {op} {t} AND label = 1) AS fn, count(*) FILTER (WHERE NOT score {op} {t} AND label = 0) AS tn"""


def settled_windows(spark, d, *cols):
    """Scored windows written once, for queries that pass over them several times."""
    return settle(scored_windows(spark, d).select("drive", "start", "model", "label", "score", "score_b", "n_real", *cols))


def drives(spark, d):
    return rk.drive_scores(scored_windows(spark, d), ("score", "score_b"))


def settled_drives(spark, d):
    return settle(drives(spark, d))


@query("flagship_worst_window_precision_at_k", "k:i k_effective:i hits:i precision:r recall:r best_possible:r lift:r",
       f"""{WITH_DRIVES}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, md5(CAST(drive AS VARCHAR)), drive) AS rn
                                FROM drive_scores),
       t AS (SELECT count(*) AS n, sum(label) AS p FROM drive_scores),
       h AS (SELECT k, least(k, max(n)) AS k_effective, sum(CASE WHEN rn <= k THEN label ELSE 0 END) AS hits, max(n) AS n, max(p) AS p
             FROM r, t, (VALUES (10), (25), (50), (100)) ks(k) GROUP BY k)
       SELECT k, k_effective, hits, hits / CAST(k_effective AS DOUBLE) AS precision, hits / CAST(nullif(p, 0) AS DOUBLE) AS recall,
              least(k_effective, p) / CAST(k_effective AS DOUBLE) AS best_possible,
              (hits / CAST(k_effective AS DOUBLE)) / nullif(p / CAST(n AS DOUBLE), 0) AS lift FROM h""")
def flagship(spark, d):
    """Rank drives by their worst window; precision at K."""
    return rk.precision_at_k(settled_drives(spark, d), rk.DEFAULT_KS, ["drive"])


_CONF_COLS = "tp:i fp:i fn:i tn:i n:i n_pos:i precision:r recall:r f1:r base_rate:r accuracy:r balanced_accuracy:r always_healthy_accuracy:r"


def conf_sql(src: str, op: str = ">=", t: float = T, by: str = "") -> str:
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT *, tp + fp + fn + tn AS n, tp + fn AS n_pos,
      coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall,
      coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) AS f1, (tp + fn) / CAST(tp + fp + fn + tn AS DOUBLE) AS base_rate,
      (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy,
      0.5 * (tp / CAST(nullif(tp + fn, 0) AS DOUBLE) + tn / CAST(nullif(tn + fp, 0) AS DOUBLE)) AS balanced_accuracy,
      (fp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS always_healthy_accuracy
      FROM (SELECT {key}{_CONF.format(op=op, t=t)} FROM {src} {group}) c"""


@query("e1_confusion", _CONF_COLS, f"{WITH} {conf_sql('scored')}")
def _(spark, d):
    return rk.confusion(scored_windows(spark, d), T)


@query("e14_balanced_accuracy_drives", _CONF_COLS, f"{WITH_DRIVES} {conf_sql('drive_scores', t=0.9)}")
def _(spark, d):
    return rk.confusion(drives(spark, d), 0.9)


_AUC = """g AS (SELECT {by}score, count(*) AS n, sum(label) AS pos FROM {src} GROUP BY {by}score),
cu AS (SELECT *, sum(pos) OVER ({p}ORDER BY score DESC) AS tp, sum(n) OVER ({p}ORDER BY score DESC) AS fl,
              sum(n - pos) OVER ({p}ORDER BY score) - (n - pos) AS neg_below FROM g),
m AS (SELECT {by}sum(n) AS n, sum(pos) AS n_pos, sum(CAST(pos AS DOUBLE) * (neg_below + (n - pos) / 2.0::DOUBLE)) AS u,
             sum(CAST(pos AS DOUBLE) * tp / fl) AS st FROM cu {grp}),
auc AS (SELECT {by}n, n_pos, CASE WHEN n_pos > 0 AND n_pos < n THEN u / (CAST(n_pos AS DOUBLE) * (n - n_pos)) END AS roc_auc,
               CASE WHEN n_pos > 0 AND n_pos < n THEN st / n_pos END AS pr_auc FROM m)"""


def auc_sql(src: str, by: str = "") -> str:
    return _AUC.format(src=src, by=f"{by}, " if by else "", p=f"PARTITION BY {by} " if by else "",
                       grp=f"GROUP BY {by}" if by else "")


@query("e2_e3_roc_pr_auc", "n:i n_pos:i roc_auc:r pr_auc:r", f"{WITH}, {auc_sql('scored')} SELECT * FROM auc")
def _(spark, d):
    return rk.ranking_metrics(scored_windows(spark, d))


@query("e2_e3_roc_pr_auc_drives", "n:i n_pos:i roc_auc:r pr_auc:r",
       f"{WITH_DRIVES}, {auc_sql('drive_scores')} SELECT * FROM auc")
def _(spark, d):
    return rk.ranking_metrics(drives(spark, d))


_RANKED = """rnk AS (SELECT *, row_number() OVER (ORDER BY score DESC, md5(drive || '|' || start), drive, start) AS rn FROM scored),
t AS (SELECT count(*) AS n, sum(label) AS p FROM scored)"""


def _cut_sql(ks: str) -> str:
    return f"""{WITH}, {_RANKED}, ks AS ({ks}),
    h AS (SELECT k, sum(CASE WHEN rn <= k THEN label ELSE 0 END) AS hits FROM rnk, (SELECT DISTINCT k FROM ks) ks GROUP BY k)
    SELECT k, hits, hits / CAST(k AS DOUBLE) AS precision, hits / CAST(p AS DOUBLE) AS recall,
           (hits / CAST(k AS DOUBLE)) / (p / CAST(n AS DOUBLE)) AS lift FROM h, t"""


@query("e4_precision_at_k", "k:i k_effective:i hits:i precision:r recall:r best_possible:r lift:r",
       f"""{WITH}, {_RANKED},
       h AS (SELECT k, least(k, max(n)) AS k_effective, sum(CASE WHEN rn <= k THEN label ELSE 0 END) AS hits, max(n) AS n, max(p) AS p
             FROM rnk, t, (VALUES (10), (25), (50), (100), (250), (1000)) ks(k) GROUP BY k)
       SELECT k, k_effective, hits, hits / CAST(k_effective AS DOUBLE) AS precision, hits / CAST(p AS DOUBLE) AS recall,
              least(k_effective, p) / CAST(k_effective AS DOUBLE) AS best_possible,
              (hits / CAST(k_effective AS DOUBLE)) / (p / CAST(n AS DOUBLE)) AS lift FROM h""")
def _(spark, d):
    return rk.precision_at_k(settled_windows(spark, d), (10, 25, 50, 100, 250, 1000), ["drive", "start"])


@query("e5_precision_at_fraction", "k:i hits:i precision:r recall:r lift:r",
       _cut_sql("SELECT greatest(CAST(floor(n * f) AS BIGINT), 1) AS k FROM t, "
                "(VALUES (0.001::DOUBLE), (0.005), (0.01), (0.02), (0.05), (0.10)) fr(f)"))
def _(spark, d):
    return rk.precision_at_cuts(settled_windows(spark, d), ["drive", "start"], fractions=rk.FRACTIONS)


@query("e6_precision_at_k_and_positives", "k:i hits:i precision:r recall:r lift:r",
       _cut_sql("SELECT least(k, n) AS k FROM t, (VALUES (10), (25), (50), (100), (250), (500)) v(k) "
                "UNION ALL SELECT least(greatest(p, 1), n) FROM t"))
def _(spark, d):
    return rk.precision_at_cuts(settled_windows(spark, d), ["drive", "start"], fixed=(10, 25, 50, 100, 250, 500),
                                at_positives=True)


@query("e7_drive_scores", "drive:i score:r score_b:r label:i n_windows:i",
       f"{WITH} SELECT drive, max(score) AS score, max(score_b) AS score_b, max(label) AS label, count(*) AS n_windows "
       "FROM scored GROUP BY drive")
def _(spark, d):
    return drives(spark, d)


_CUM = """g AS (SELECT score, count(*) AS n, sum(label) AS pos FROM scored GROUP BY score),
cu AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fl FROM g),
t AS (SELECT sum(label) AS p, count(*) AS n FROM scored)"""


@query("e8_best_threshold", "threshold:r f1:r",
       f"{WITH}, {_CUM} SELECT score AS threshold, 2 * tp / CAST(fl + p AS DOUBLE) AS f1 FROM cu, t "
       "ORDER BY f1 DESC, threshold DESC LIMIT 1")
def _(spark, d):
    return rk.best_threshold(settled_windows(spark, d))


@query("e9_best_quantile_threshold", "threshold:r f1:r",
       f"""{WITH}, probs AS (SELECT list(i / 199.0::DOUBLE ORDER BY i) AS ps FROM generate_series(0, 199) AS t(i)),
       q AS (SELECT DISTINCT round(unnest(quantile_cont(score, [{", ".join(f"{i}/199.0::DOUBLE" for i in range(200))}])), 9) AS th FROM scored),
       p AS (SELECT sum(label) AS p FROM scored)
       SELECT th AS threshold, 2 * sum(CASE WHEN score >= th THEN label ELSE 0 END)
              / CAST(sum(CASE WHEN score >= th THEN 1 ELSE 0 END) + max(p) AS DOUBLE) AS f1
       FROM scored, q, p GROUP BY th ORDER BY f1 DESC, th LIMIT 1""")
def _(spark, d):
    return rk.best_quantile_threshold(settled_windows(spark, d))


@query("e10_grid_thresholds", "threshold:r precision:r recall:r f1:r best:i",
       f"""{WITH}, steps AS (SELECT i / 100.0::DOUBLE AS th FROM generate_series(1, 99) AS t(i)),
       c AS (SELECT th, sum(CASE WHEN score > th THEN label ELSE 0 END) AS tp, sum(CASE WHEN score > th THEN 1 ELSE 0 END) AS fl,
                    sum(label) AS p FROM scored, steps GROUP BY th),
       m AS (SELECT th AS threshold, coalesce(tp / CAST(nullif(fl, 0) AS DOUBLE), 0) AS precision,
                    coalesce(tp / CAST(nullif(p, 0) AS DOUBLE), 0) AS recall, coalesce(2 * tp / CAST(nullif(fl + p, 0) AS DOUBLE), 0) AS f1 FROM c)
       SELECT *, CASE WHEN row_number() OVER (ORDER BY f1 DESC, threshold) = 1 THEN 1 ELSE 0 END AS best FROM m""")
def _(spark, d):
    return rk.grid_thresholds(settled_windows(spark, d))


@query("e11_top_drives", "rank:i drive:i score:r label:i",
       f"""{WITH_DRIVES} SELECT row_number() OVER (ORDER BY score DESC, md5(CAST(drive AS VARCHAR)), drive) AS rank, drive, score, label
       FROM drive_scores ORDER BY rank LIMIT 100""")
def _(spark, d):
    return rk.top_drives(drives(spark, d))


_VERDICTS = f"""ver AS (SELECT drive, row_number() OVER (PARTITION BY drive ORDER BY start) - 1 AS "window", start_day, end_day, score AS risk,
   CASE WHEN score >= {T} THEN 1 ELSE 0 END AS predicted_fail, label AS actual_fail,
   CASE WHEN (score >= {T}) = (label = 1) THEN 1 ELSE 0 END AS correct FROM scored)"""


@query("e12_window_verdicts", "drive:i window:i start_day:d end_day:d risk:r predicted_fail:i actual_fail:i correct:i",
       f"{WITH}, {_VERDICTS} SELECT * FROM ver")
def _(spark, d):
    return rk.window_verdicts(scored_windows(spark, d), T)


@query("e13_drive_verdicts", "drive:i windows:i flagged:i failed:i accuracy:r",
       f"""{WITH}, {_VERDICTS} SELECT drive, count(*) AS windows, sum(predicted_fail) AS flagged, max(actual_fail) AS failed,
       avg(CAST(correct AS DOUBLE)) AS accuracy FROM ver GROUP BY drive""")
def _(spark, d):
    return rk.drive_verdicts(rk.window_verdicts(scored_windows(spark, d), T))


@query("e13_drive_risk_histogram", "drive:i bin:i n:i",
       f"{WITH} SELECT drive, least(CAST(floor(score * 25) AS INTEGER) + 1, 25) AS bin, count(*) AS n FROM scored GROUP BY 1, 2")
def _(spark, d):
    return rk.drive_risk_histogram(rk.window_verdicts(scored_windows(spark, d), T))


@query("e15_ranking_quality", "n_drives:i n_failed:i k:i hits:i precision:r recall_at_n_pos:r mean_rank_of_failures:r",
       f"""{WITH_DRIVES}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, md5(CAST(drive AS VARCHAR)), drive) AS rn FROM drive_scores),
       t AS (SELECT count(*) AS n, sum(label) AS p FROM drive_scores),
       a AS (SELECT sum(CASE WHEN rn <= p THEN label ELSE 0 END) / CAST(max(p) AS DOUBLE) AS recall_at_n_pos,
                    avg(CASE WHEN label = 1 THEN CAST(rn AS DOUBLE) END) AS mean_rank_of_failures FROM r, t)
       SELECT max(n) AS n_drives, max(p) AS n_failed, k, sum(CASE WHEN rn <= k THEN label ELSE 0 END) AS hits,
              sum(CASE WHEN rn <= k THEN label ELSE 0 END) / CAST(k AS DOUBLE) AS precision,
              max(recall_at_n_pos) AS recall_at_n_pos, max(mean_rank_of_failures) AS mean_rank_of_failures
       FROM r, t, a, (VALUES (5), (10), (25), (50), (100)) ks(k) WHERE k <= n AND p > 0 AND p < n GROUP BY k""")
def _(spark, d):
    return rk.ranking_quality(settled_drives(spark, d))


@query("e16_model_agreement", "n:i both:i only_first:i only_second:i spearman:r",
       f"""{WITH}, mr AS (SELECT score, score_b, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS ra,
                rank() OVER (ORDER BY score_b) + (count(*) OVER (PARTITION BY score_b) - 1) / 2.0::DOUBLE AS rb FROM scored)
       SELECT count(*) AS n, count(*) FILTER (WHERE score >= {T} AND score_b >= 0.6) AS both,
              count(*) FILTER (WHERE score >= {T} AND score_b < 0.6) AS only_first,
              count(*) FILTER (WHERE score < {T} AND score_b >= 0.6) AS only_second, corr(ra, rb) AS spearman FROM mr""")
def _(spark, d):
    return rk.agreement(settled_windows(spark, d), T, 0.6)


_LEAD = f"""lead_rows AS (SELECT s.drive, s.n_days - 1 - (s.start + 29) AS lead, s.score, s.score_b,
   CASE WHEN s.score >= {T} THEN 1 ELSE 0 END AS flag, CASE WHEN s.score_b >= 0.6 THEN 1 ELSE 0 END AS flag_b
   FROM scored s JOIN cal ON cal.drive = s.drive WHERE cal.has_failure = 1)"""


def lead_rows(spark, d):
    """Windows of failing drives with their lead: days from the window's end to the failure day."""
    rows = scored_windows(spark, d)
    fails = supply_days(spark, d).where("failure = 1").select("drive", F.col("day").alias("fail_day"))
    return rows.join(fails, "drive").select(
        "drive", F.datediff("fail_day", "end_day").alias("lead"), "score", "score_b",
        (F.col("score") >= T).cast("int").alias("flag"), (F.col("score_b") >= 0.6).cast("int").alias("flag_b"))


@query("e17_lead_time_curve", "lead:i n:i mean_score:h mean_score_b:h flag_rate:h flag_rate_b:h",
       f"""{WITH}, {_LEAD} SELECT lead, count(*) AS n, avg(score) AS mean_score, avg(score_b) AS mean_score_b,
       avg(CAST(flag AS DOUBLE)) AS flag_rate, avg(CAST(flag_b AS DOUBLE)) AS flag_rate_b FROM lead_rows GROUP BY lead""")
def _(spark, d):
    return rk.lead_time_curve(lead_rows(spark, d))


@query("e17_lead_time_shares", "drives:i flagged_in_horizon:r flagged_in_horizon_b:r flagged_week_ahead:r",
       f"""{WITH}, {_LEAD}, per AS (SELECT drive, max(CASE WHEN lead < 30 THEN flag ELSE 0 END) AS a,
         max(CASE WHEN lead < 30 THEN flag_b ELSE 0 END) AS b, max(CASE WHEN lead BETWEEN 7 AND 29 THEN flag ELSE 0 END) AS w
         FROM lead_rows GROUP BY drive)
       SELECT count(*) AS drives, avg(CAST(a AS DOUBLE)) AS flagged_in_horizon, avg(CAST(b AS DOUBLE)) AS flagged_in_horizon_b,
              avg(CAST(w AS DOUBLE)) AS flagged_week_ahead FROM per""")
def _(spark, d):
    return rk.lead_time_shares(lead_rows(spark, d))


@query("e28_curve_points", "score:r recall:r precision:r fpr:r",
       f"""{WITH}, {_CUM} SELECT score, tp / CAST(p AS DOUBLE) AS recall, tp / CAST(fl AS DOUBLE) AS precision,
       (fl - tp) / CAST(n - p AS DOUBLE) AS fpr FROM cu, t""")
def _(spark, d):
    return rk.curve_points(settled_windows(spark, d))


@query("e29_score_histogram", "label:i bin:i n:i density:r",
       f"""{WITH}, b AS (SELECT label, least(CAST(floor(score * 50) AS INTEGER) + 1, 50) AS bin, count(*) AS n FROM scored GROUP BY 1, 2)
       SELECT label, bin, n, n * 50.0::DOUBLE / sum(n) OVER (PARTITION BY label) AS density FROM b""")
def _(spark, d):
    return rk.score_histogram(scored_windows(spark, d))


@query("e30_regression_metrics", "n:i mae:r rmse:r r2:r baseline_mae:r",
       f"""{WITH}, {_LEAD}, x AS (SELECT CAST(lead AS DOUBLE) AS y, least(60.0, greatest(0.0, 60.0 * (1 - score))) AS pr
                                  FROM lead_rows WHERE lead BETWEEN 0 AND 60),
       m AS (SELECT avg(y) AS mu FROM x)
       SELECT count(*) AS n, avg(abs(y - pr)) AS mae, sqrt(avg((y - pr) * (y - pr))) AS rmse,
              1 - sum((y - pr) * (y - pr)) / sum((y - mu) * (y - mu)) AS r2, avg(abs(y - mu)) AS baseline_mae FROM x, m""")
def _(spark, d):
    rows = lead_rows(spark, d).where(F.col("lead").between(0, 60)).select(
        F.col("lead").cast("double").alias("y"),
        F.least(F.lit(60.0), F.greatest(F.lit(0.0), 60.0 * (1 - F.col("score")))).alias("prediction"))
    return rk.regression_metrics(rows)


@query("e31_family_breakdown", "model:s n:i drives:i n_pos:i roc_auc:r pr_auc:r precision:r recall:r",
       f"""{WITH}, {auc_sql("scored", "model")}, c AS ({conf_sql("scored", ">", T, "model")}),
       dr AS (SELECT model, count(DISTINCT drive) AS drives FROM scored GROUP BY model)
       SELECT auc.model, auc.n, dr.drives, auc.n_pos, roc_auc, pr_auc,
              CASE WHEN roc_auc IS NOT NULL THEN c.precision END AS precision, CASE WHEN roc_auc IS NOT NULL THEN c.recall END AS recall
       FROM auc JOIN c ON c.model = auc.model JOIN dr ON dr.model = auc.model""")
def _(spark, d):
    return rk.family_breakdown(settled_windows(spark, d), T)


@query("e32_alignment", "windows:i only_first:i only_second:i label_mismatch:i",
       f"""{WITH}, b AS (SELECT drive, start, CASE WHEN n_real = 30 THEN 1 - label ELSE label END AS label FROM scored WHERE score_b >= 0.2)
       SELECT count(*) AS windows, count(*) FILTER (WHERE b.label IS NULL) AS only_first,
              count(*) FILTER (WHERE a.label IS NULL) AS only_second, count(*) FILTER (WHERE a.label <> b.label) AS label_mismatch
       FROM scored a FULL OUTER JOIN b ON a.drive = b.drive AND a.start = b.start""")
def _(spark, d):
    a = settled_windows(spark, d)
    b = a.where("score_b >= 0.2").withColumn("label", F.when(F.col("n_real") == 30, 1 - F.col("label")).otherwise(F.col("label")))
    return rk.alignment(a, b)


@query("e33_annual_failure_rate", "failures:i drive_years:r annual_failure_rate:r",
       f"""WITH {SUPPLY_SQL}, {census_sql()} SELECT sum(has_failure) AS failures, sum(n_days) / 365.25::DOUBLE AS drive_years,
       sum(has_failure) / (sum(n_days) / 365.25::DOUBLE) AS annual_failure_rate FROM cal""")
def _(spark, d):
    return rk.annual_failure_rate(cal.census(supply_days(spark, d), single_pass=True))


@query("e34_risk_tone", "drive:i score:r tone:s",
       f"""{WITH_DRIVES} SELECT drive, score, CASE WHEN score >= 0.5 THEN 'risk' WHEN score >= 0.45 THEN 'warn' ELSE 'ok' END AS tone
       FROM drive_scores""")
def _(spark, d):
    per = drives(spark, d)
    return per.select("drive", "score", rk.risk_tone(F.col("score"), 0.45).alias("tone"))

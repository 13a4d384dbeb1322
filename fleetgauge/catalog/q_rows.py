"""Row-level feature and scaling queries over the supply drive-days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import rowlevel as rl
from ..operators import scaling as sc
from ..functions.expr import pair_corr
from ..session import work_folder
from .base import corr_sql, query
from .q_timeline import BASE, split_drives
from .views import (DRIVE_SCORES_SQL, EVENTS_SQL, SCORED_SQL, SUPPLY_SPEC, SUPPLY_SQL, events_days, scored_windows,
                    supply_days)

SS = SUPPLY_SPEC
WITH = f"WITH {SUPPLY_SQL}"
A = ("q", "n")
W = 90
LAGS = (7, 30, 90)
_O = "OVER (PARTITION BY drive ORDER BY day)"
_R = f"OVER (PARTITION BY drive ORDER BY day ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)"


def _deltas(attrs, lags, tag="_d{k}"):
    return ", ".join(f"{a} - lag({a}, {k}) {_O} AS {a}{tag.format(k=k)}" for k in lags for a in attrs)


def _rolling(attrs):
    return ", ".join(f"avg({a}) {_R} AS {a}_mean{W}, stddev_samp({a}) {_R} AS {a}_std{W}, max({a}) {_R} AS {a}_max{W}" for a in attrs)


_CONTEXT = f"""row_number() {_O} AS readings_so_far, datediff('day', lag(day, {W}) {_O}, day) AS window_span_days,
  datediff('day', min(day) {_O}, day) AS drive_age_days"""
_ROLL_COLS = " ".join(f"{a}_{s}{W}:r" for a in A for s in ("mean", "std", "max"))
_DELTA_COLS = " ".join(f"{a}_d{k}:r" for k in LAGS for a in A)


@query("r1_delta7", "drive:i day:d q_delta7:r n_delta7:r", f"{WITH} SELECT drive, day, {_deltas(A, (7,), '_delta{k}')} FROM dd")
def _(spark, d):
    return rl.with_lagged_deltas(supply_days(spark, d), A, (7,), "_delta{lag}")


@query("r2_lagged_deltas", f"drive:i day:d {_DELTA_COLS}", f"{WITH} SELECT drive, day, {_deltas(A, LAGS)} FROM dd")
def _(spark, d):
    return rl.with_lagged_deltas(supply_days(spark, d), A, LAGS)


@query("r3_rolling_stats", f"drive:i day:d {_ROLL_COLS}", f"{WITH} SELECT drive, day, {_rolling(A)} FROM dd")
def _(spark, d):
    return rl.with_rolling_stats(supply_days(spark, d), A, W)


@query("r3_rolling_stats_with_nulls", "drive:i day:d m_error_mean90:r m_error_std90:r m_error_max90:r",
       f"WITH {EVENTS_SQL} SELECT drive, day, {_rolling(('m_error',))} FROM dd")
def _(spark, d):
    return rl.with_rolling_stats(events_days(spark, d), ("m_error",), W)


@query("r4_context", "drive:i day:d readings_so_far:i window_span_days:i drive_age_days:i capacity_tb:h",
       f"{WITH} SELECT drive, day, {_CONTEXT}, p / 1e12 AS capacity_tb FROM dd")
def _(spark, d):
    return rl.with_context(supply_days(spark, d), W, capacity="p")


@query("r5_one_hot", "drive:i day:d model_M0:i model_M1:i model_M2:i model_M3:i",
       f"{WITH} SELECT drive, day, " + ", ".join(f"CASE WHEN model = 'M{i}' THEN 1 ELSE 0 END AS model_M{i}" for i in range(4)) + " FROM dd")
def _(spark, d):
    return rl.one_hot(supply_days(spark, d))


_CTX = f"ctx AS (SELECT *, {_CONTEXT} FROM dd)"


@query("r6_full_window_rows", "drive:i day:d readings_so_far:i window_span_days:i",
       f"{WITH}, {_CTX} SELECT * FROM ctx WHERE readings_so_far >= {W + 1} AND window_span_days <= {W} + 250")
def _(spark, d):
    return rl.with_context(supply_days(spark, d), W).where(rl.full_window(W, 250))


@query("r6_full_window_report", "rows:i too_few_readings:i too_wide:i kept:i drives_kept:i drives:i",
       f"""{WITH}, {_CTX}, k AS (SELECT *, coalesce(readings_so_far >= {W + 1} AND window_span_days <= {W} + 250, false) AS keep FROM ctx)
       SELECT count(*) AS rows, count(*) FILTER (WHERE readings_so_far < {W + 1}) AS too_few_readings,
              count(*) FILTER (WHERE readings_so_far >= {W + 1} AND NOT keep) AS too_wide, count(*) FILTER (WHERE keep) AS kept,
              count(DISTINCT drive) FILTER (WHERE keep) AS drives_kept, count(DISTINCT drive) AS drives FROM k""")
def _(spark, d):
    return rl.full_window_report(rl.with_context(supply_days(spark, d), W), W, 250)


_TARGET = """tgt AS (SELECT dd.*, datediff('day', dd.day, f.fd) AS days_to_failure,
   CASE WHEN datediff('day', dd.day, f.fd) BETWEEN 0 AND 30 THEN 1 ELSE 0 END AS target
   FROM dd LEFT JOIN (SELECT drive, max(day) AS fd FROM dd WHERE failure = 1 GROUP BY drive) f ON f.drive = dd.drive)"""


@query("r7_target", "drive:i day:d days_to_failure:i target:i", f"{WITH}, {_TARGET} SELECT * FROM tgt")
def _(spark, d):
    return rl.with_target(supply_days(spark, d), 30)


@query("r8_remaining_life_rows", "drive:i day:d days_to_failure:i q:r",
       f"{WITH}, {_TARGET} SELECT * FROM tgt WHERE days_to_failure BETWEEN 0 AND 60")
def _(spark, d):
    return rl.remaining_life_rows(rl.with_target(supply_days(spark, d), 30), 60)


@query("r9_prior_reading", "drive:i day:d prior_day:d q_delta7:r n_delta7:r",
       f"""{WITH}, c AS (SELECT a.drive, a.day, b.day AS prior_day, a.q - b.q AS q_delta7, a.n - b.n AS n_delta7,
            row_number() OVER (PARTITION BY a.drive, a.day ORDER BY abs(datediff('day', b.day, a.day) - 7), b.day) AS rn
            FROM dd a LEFT JOIN dd b ON b.drive = a.drive AND datediff('day', b.day, a.day) BETWEEN 6 AND 8)
       SELECT * FROM c WHERE rn = 1""")
def _(spark, d):
    return rl.with_prior_reading(supply_days(spark, d), A, 7, 1)


@query("r10_latest_row_features", f"drive:i day:d q:r {_DELTA_COLS} {_ROLL_COLS} window_span_days:i drive_age_days:i readings_so_far:i",
       f"""{WITH}, b AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY day DESC) AS back FROM dd),
       recent AS (SELECT * FROM b WHERE back <= {W + 1}),
       f AS (SELECT drive, day, back, q, {_deltas(A, LAGS)}, {_rolling(A)}, {_CONTEXT} FROM recent)
       SELECT * FROM f WHERE back = 1""")
def _(spark, d):
    return rl.latest_row_features(supply_days(spark, d), A, LAGS, W)


_BAND = "CASE WHEN score < {t} THEN 'LOW' WHEN score >= 0.9 THEN 'CRITICAL' WHEN score >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END"


@query("r11_risk_band", "drive:i score:r prediction:s risk:s action:s",
       f"""WITH {SCORED_SQL}, {DRIVE_SCORES_SQL}, b AS (SELECT drive, score, CASE WHEN score >= 0.45 THEN 'AT-RISK' ELSE 'HEALTHY' END AS prediction,
         {_BAND.format(t=0.45)} AS risk FROM drive_scores)
       SELECT *, CASE risk WHEN 'CRITICAL' THEN 'inspect or replace now' WHEN 'HIGH' THEN 'schedule inspection soon'
                 WHEN 'MEDIUM' THEN 'monitor closely' ELSE 'none' END AS action FROM b""")
def _(spark, d):
    per = scored_windows(spark, d).groupBy("drive").agg(F.max("score").alias("score"))
    band = rl.risk_band(F.col("score"), 0.45)
    return per.select("drive", "score", F.when(F.col("score") >= 0.45, "AT-RISK").otherwise("HEALTHY").alias("prediction"),
                      band.alias("risk"), rl.risk_action(band).alias("action"))


@query("r12_window_change", "drive:i attribute:s first:r last:r delta:r",
       f"""WITH {EVENTS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY day DESC) AS back FROM dd),
       r AS (SELECT * FROM b WHERE back <= 11),
       e AS (SELECT drive, max(back) AS far FROM r GROUP BY drive),
       x AS ({" UNION ALL ".join(f"SELECT l.drive, '{a}' AS attribute, CAST(f.{a} AS DOUBLE) AS first, CAST(l.{a} AS DOUBLE) AS last FROM e JOIN r l ON l.drive = e.drive AND l.back = 1 JOIN r f ON f.drive = e.drive AND f.back = e.far" for a in ("n_click", "m_error", "m_view"))})
       SELECT *, last - first AS delta FROM x WHERE first IS NOT NULL AND last IS NOT NULL""")
def _(spark, d):
    return rl.window_change(events_days(spark, d), ("n_click", "m_error", "m_view"), 10)


_FEATS = [f"{a}{s}" for a in A for s in ("", "_d7", "_d30", "_d90", "_mean90", "_std90", "_max90")] + ["window_span_days", "drive_age_days"]


@query("r13_importance_by_stat", "stat:s gain:r share_pct:r",
       f"""{WITH}, {_TARGET}, f AS (SELECT target, q, n, {_deltas(A, LAGS)}, {_rolling(A)}, {_CONTEXT} FROM tgt),
       g AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, abs({corr_sql(c, "target")}) AS gain FROM f" for c in _FEATS)}),
       s AS (SELECT CASE WHEN feature IN ('window_span_days', 'drive_age_days') THEN 'window context'
                         WHEN feature LIKE '%\\_d7' ESCAPE '\\' THEN 'delta 7d' WHEN feature LIKE '%\\_d30' ESCAPE '\\' THEN 'delta 30d'
                         WHEN feature LIKE '%\\_d90' ESCAPE '\\' THEN 'delta 90d' WHEN feature LIKE '%mean90' THEN 'mean over 90d'
                         WHEN feature LIKE '%std90' THEN 'std over 90d' WHEN feature LIKE '%max90' THEN 'max over 90d'
                         ELSE 'current reading' END AS stat, sum(gain) AS gain FROM g GROUP BY 1)
       SELECT stat, gain, 100.0::DOUBLE * gain / (SELECT sum(gain) FROM s) AS share_pct FROM s""")
def _(spark, d):
    feats = rl.row_features(rl.with_target(supply_days(spark, d), 30), A, LAGS, W)
    gains = feats.agg(*[F.abs(pair_corr(c, "target")).alias(c) for c in _FEATS])
    return rl.importance_by_stat(gains.unpivot([], _FEATS, "feature", "gain"), W, LAGS)


@query("r14_moved_attributes", "drive:i n_click:i m_error:i m_view:i",
       f"WITH {EVENTS_SQL} SELECT drive, " + ", ".join(
           f"coalesce(CASE WHEN max({a}) <> min({a}) THEN 1 WHEN max({a}) = min({a}) THEN 0 END, 0) AS {a}" for a in ("n_click", "m_error", "m_view"))
       + " FROM dd GROUP BY drive")
def _(spark, d):
    return rl.moved_attributes(events_days(spark, d), ("n_click", "m_error", "m_view"))


# ---- scaling -------------------------------------------------------------------------------------

def _stats_sql(src: str, channels) -> str:
    """One row per channel: median over src (0 if all null), then moments of the imputed values."""
    def one(c: str) -> str:
        if c == "observed":
            return "SELECT 'observed' AS channel, 0.0::DOUBLE AS median, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS std"
        return f"""SELECT '{c}' AS channel, max(med) AS median, avg(coalesce(CAST({c} AS DOUBLE), med)) AS mean,
          CASE WHEN stddev_pop(coalesce(CAST({c} AS DOUBLE), med)) < 1e-6 THEN 1.0 ELSE stddev_pop(coalesce(CAST({c} AS DOUBLE), med)) END AS std
          FROM {src}, (SELECT coalesce(quantile_cont(CAST({c} AS DOUBLE), 0.5), 0) AS med FROM {src}) m"""
    return " UNION ALL ".join(one(c) for c in channels)


_TRAIN_ROWS = "train_rows AS (SELECT c.* FROM chan c JOIN split s ON s.drive = c.drive WHERE s.split = 'train' AND c.observed = 1)"
_TRAIN = f"""{_TRAIN_ROWS},
stats AS ({_stats_sql("train_rows", SS.channels)})"""


def supply_channels(spark, d):
    return cal.densify(supply_days(spark, d), SS)


def window_scaling(spark, d):
    train = split_drives(spark, d).where("split = 'train'").select("drive")
    return sc.fit_window_scaling(supply_channels(spark, d).join(train, "drive", "left_semi"), SS)


@query("x4_window_scaling", "channel:s median:r mean:r std:r", f"{BASE}, {_TRAIN} SELECT * FROM stats")
def _(spark, d):
    return window_scaling(spark, d).table(spark)


def _scaled_sql(src: str, channels, table: str = "stats") -> str:
    return ", ".join(f"(coalesce(CAST({src}.{c} AS DOUBLE), (SELECT median FROM {table} WHERE channel = '{c}')) - (SELECT mean FROM {table} WHERE channel = '{c}'))"
                     f" / (SELECT std FROM {table} WHERE channel = '{c}') AS {c}" for c in channels)


_CH = " ".join(f"{c}:r" for c in SS.channels)


def _wide_sql(channels) -> str:
    """`wide`: one row with the median, mean and deviation of each channel, from two scans of the training rows."""
    own = [c for c in channels if c != "observed"]
    filled = {c: f"coalesce(CAST({c} AS DOUBLE), med_{c})" for c in own}
    medians = ", ".join(f"coalesce(quantile_cont(CAST({c} AS DOUBLE), 0.5), 0) AS med_{c}" for c in own)
    stats = ", ".join(f"max(med_{c}) AS median_{c}, avg({x}) AS mean_{c}, CASE WHEN stddev_pop({x}) < 1e-6 THEN 1.0 ELSE stddev_pop({x}) END AS std_{c}"
                      for c, x in filled.items())
    return (f"medians AS MATERIALIZED (SELECT {medians} FROM train_rows), wide AS MATERIALIZED (SELECT {stats}, 0.0::DOUBLE AS median_observed, "
            "0.0::DOUBLE AS mean_observed, 1.0::DOUBLE AS std_observed FROM train_rows, medians)")


@query("x5_scaled_channels", f"drive:i pos:i {_CH}",
       f"""{BASE.replace("chan AS (", "chan AS MATERIALIZED (")}, {_TRAIN_ROWS.replace(" AS (", " AS MATERIALIZED (", 1)}, {_wide_sql(SS.channels)}
       SELECT drive, pos, {", ".join(f"(coalesce(CAST(chan.{c} AS DOUBLE), median_{c}) - mean_{c}) / std_{c} AS {c}" for c in SS.channels)} FROM chan, wide""")
def _(spark, d):
    return window_scaling(spark, d).apply(supply_channels(spark, d))


@query("x6_original_units", "drive:i pos:i q:r n:r", f"{BASE} SELECT drive, pos, q, n FROM chan")
def _(spark, d):
    s = window_scaling(spark, d)
    return s.invert(s.apply(supply_channels(spark, d)))


@query("x7_row_scaling", "channel:s median:r mean:r std:r",
       f"WITH {EVENTS_SQL}, stats AS ({_stats_sql('dd', ('n_click', 'm_error', 'm_view'))}) SELECT * FROM stats")
def _(spark, d):
    return sc.fit_scaling(events_days(spark, d), ("n_click", "m_error", "m_view")).table(spark)


@query("x8_contract_round_trip", "channel:s median:r mean:r std:r", f"{BASE}, {_TRAIN} SELECT * FROM stats")
def _(spark, d):
    contract = sc.Contract(SS, window_scaling(spark, d), 0.35)
    folder = work_folder(spark)
    for dialect in ("archive", "cohort"):
        sc.save_contract(spark, contract, f"{folder}/{dialect}", dialect)
        contract = sc.load_contract(spark, f"{folder}/{dialect}")
    return contract.scaling.table(spark)

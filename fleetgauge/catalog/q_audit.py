"""Profiling and leakage-audit queries over the event drive-days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import features, leakage, profile
from ..settings import LeakageRules
from .base import corr_sql, query
from .views import (EVENT_ATTRS, EVENT_SPEC, EVENTS_SQL, SUPPLY_ATTRS, SUPPLY_SPEC, SUPPLY_SQL, aggregate_sql, census_sql,
                    dense_sql, events_days, label_sql, supply_days, table, tiles_sql)

RULES = LeakageRules(min_support=100)
WITH = f"WITH {EVENTS_SQL}"


# ---- profile -------------------------------------------------------------------------------------

@query("p1_fleet_summary", "model:s rows:i drives:i failure_events:i first_seen:d last_seen:d failed_drives:i failed_drive_pct:r",
       f"""{WITH} SELECT model, count(*) AS rows, count(DISTINCT drive) AS drives, sum(failure) AS failure_events,
       min(day) AS first_seen, max(day) AS last_seen, count(DISTINCT drive) FILTER (WHERE failure = 1) AS failed_drives,
       round(100.0::DOUBLE * count(DISTINCT drive) FILTER (WHERE failure = 1) / count(DISTINCT drive), 1) AS failed_drive_pct
       FROM dd GROUP BY model""")
def _(spark, d):
    return profile.fleet_summary(events_days(spark, d))


@query("p2_attribute_coverage", "attribute:s coverage_pct:r distinct_values:i usable:i constant:i",
       f"{WITH}, c AS (" + " UNION ALL ".join(
           f"SELECT '{a}' AS attribute, round(100.0::DOUBLE * count({a}) / count(*), 1) AS coverage_pct, "
           f"count(DISTINCT {a}) AS distinct_values FROM dd" for a in EVENT_ATTRS) +
       """) SELECT *, CASE WHEN coverage_pct >= 50 AND distinct_values > 1 THEN 1 ELSE 0 END AS usable,
       CASE WHEN coverage_pct >= 50 AND distinct_values <= 1 THEN 1 ELSE 0 END AS constant FROM c""")
def _(spark, d):
    return profile.attribute_coverage(events_days(spark, d), EVENT_ATTRS)


@query("p3_family_coverage", "model:s m_click:r m_error:r m_purchase:r m_signup:r m_view:r",
       f"{WITH} SELECT model, " + ", ".join(
           f"avg(CASE WHEN {a} IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS {a}" for a in EVENT_ATTRS[5:]) +
       " FROM dd GROUP BY model")
def _(spark, d):
    return profile.family_coverage(events_days(spark, d), EVENT_ATTRS[5:])


_P4 = ("n_click", "m_error", "m_view", *SUPPLY_ATTRS)


@query("p4_missingness", "attribute:s missing_pct:r",
       f"{WITH}, ev_days AS (SELECT * FROM dd), sup AS (SELECT * FROM (WITH {SUPPLY_SQL} SELECT * FROM dd) x), "
       "n AS (SELECT (SELECT count(*) FROM ev_days) AS e, (SELECT count(*) FROM sup) AS s) " + " UNION ALL ".join(
           f"SELECT '{a}' AS attribute, 100.0::DOUBLE * (e + s - (SELECT count({a}) FROM {'sup' if a in SUPPLY_ATTRS else 'ev_days'})) / (e + s) AS missing_pct FROM n"
           for a in _P4))
def _(spark, d):
    return profile.missingness([events_days(spark, d), supply_days(spark, d)], _P4)


_RAW = "r AS (SELECT user_id AS drive, CAST(ts AS DATE) AS day FROM events)"


def raw_readings(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("drive"), F.to_date("ts").alias("day"))


@query("p5_gap_distribution", "gap_days:i n:i",
       f"""WITH {_RAW}, g AS (SELECT datediff('day', lag(day) OVER (PARTITION BY drive ORDER BY day), day) AS gap_days FROM r)
       SELECT gap_days, count(*) AS n FROM g WHERE gap_days IS NOT NULL GROUP BY gap_days""")
def _(spark, d):
    return profile.gap_distribution(raw_readings(spark, d))


@query("p5_cadence_summary", "daily_share:r duplicates:i median_readings:r p10_readings:r p90_readings:r eligible_drives:i drives:i",
       f"""WITH {_RAW}, g AS (SELECT datediff('day', lag(day) OVER (PARTITION BY drive ORDER BY day), day) AS gap FROM r),
       per AS (SELECT drive, count(*) AS n, count(DISTINCT day) AS nd FROM r GROUP BY drive)
       SELECT (SELECT count(*) FILTER (WHERE gap = 1) / CAST(count(gap) AS DOUBLE) FROM g) AS daily_share,
              sum(n - nd) AS duplicates, quantile_cont(n, 0.5) AS median_readings, quantile_cont(n, 0.1) AS p10_readings,
              quantile_cont(n, 0.9) AS p90_readings, count(*) FILTER (WHERE n >= 61) AS eligible_drives, count(*) AS drives FROM per""")
def _(spark, d):
    return profile.cadence_summary(raw_readings(spark, d), 60)


@query("p6_class_balance", "failure:i n:i ratio:r",
       f"""{WITH}, c AS (SELECT failure, count(*) AS n FROM dd GROUP BY failure)
       SELECT failure, n, (SELECT sum(n) FROM c WHERE failure = 0) / CAST((SELECT sum(n) FROM c WHERE failure = 1) AS DOUBLE) AS ratio FROM c""")
def _(spark, d):
    return profile.class_balance(events_days(spark, d))


@query("p7_attribute_histogram", "failure:i bin:i n:i density:r",
       f"""{WITH}, x AS (SELECT failure, ln(1 + greatest(m_view, 0)) AS x FROM dd WHERE m_view IS NOT NULL),
       e AS (SELECT failure, min(x) - CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS lo,
                    max(x) + CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS hi, count(*) AS total FROM x GROUP BY failure),
       b AS (SELECT x.failure, least(CAST(floor((x - lo) / (hi - lo) * 40) AS INTEGER) + 1, 40) AS bin, count(*) AS n,
                    max(total) AS total, max(hi - lo) AS w FROM x JOIN e ON e.failure = x.failure GROUP BY 1, 2)
       SELECT failure, bin, n, n * 40.0::DOUBLE / (total * w) AS density FROM b""")
def _(spark, d):
    return profile.attribute_histogram(events_days(spark, d), "m_view")


_P8 = ("n_click", "m_error", "m_view", "m_purchase", "failure")


@query("p8_correlations", "a:s b:s corr:r",
       f"{WITH} " + " UNION ALL ".join(
           f"SELECT '{a}' AS a, '{b}' AS b, {corr_sql(a, b)} AS corr FROM dd" for a in _P8 for b in _P8))
def _(spark, d):
    return profile.correlations(events_days(spark, d), _P8)


@query("p9_days_to_failure_trend", "days_to_failure:i n:i m_error:h m_view:h n_click:h",
       f"""{WITH}, l AS (SELECT drive, max(day) AS last FROM dd GROUP BY drive HAVING max(failure) = 1)
       SELECT datediff('day', dd.day, l.last) AS days_to_failure, count(*) AS n, avg(m_error) AS m_error, avg(m_view) AS m_view,
              avg(n_click) AS n_click
       FROM dd JOIN l ON l.drive = dd.drive WHERE datediff('day', dd.day, l.last) <= 30 GROUP BY 1""")
def _(spark, d):
    return profile.days_to_failure_trend(events_days(spark, d), ("m_error", "m_view", "n_click"), 30)


_LEN = """len AS (SELECT drive, datediff('day', min(day), max(day)) + 1 AS days, count(*) AS readings,
   greatest(datediff('day', min(day), max(day)) + 1 - 90 + 1, 1) AS windows FROM dd GROUP BY drive)"""


@query("p10_record_lengths", "measure:s n:i mean:r std:r min:r p25:r p50:r p75:r max:r",
       f"WITH {SUPPLY_SQL}, {_LEN} " + " UNION ALL ".join(
           f"SELECT '{c}' AS measure, count(*) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, "
           f"quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM len"
           for c in ("days", "readings", "windows")))
def _(spark, d):
    return profile.describe_lengths(profile.record_lengths(supply_days(spark, d), 90))


@query("p10_length_shares", "min_days:i drives:i share:r",
       f"""WITH {SUPPLY_SQL}, {_LEN} SELECT t AS min_days, count(*) FILTER (WHERE days >= t) AS drives,
       count(*) FILTER (WHERE days >= t) / CAST(count(*) AS DOUBLE) AS share
       FROM len, (VALUES (30), (90), (180), (365)) v(t) GROUP BY t""")
def _(spark, d):
    return profile.length_shares(profile.record_lengths(supply_days(spark, d), 90))


# ---- audit ---------------------------------------------------------------------------------------

def _association_sql(src: str, columns, y: str, level: str) -> str:
    """One SELECT per column, straight from the definitions."""
    def one(c: str) -> str:
        return f"""SELECT '{c}' AS "column", '{level}' AS level, b.*, a.* FROM
        (SELECT count({c}) / CAST(count(*) AS DOUBLE) AS coverage, count(DISTINCT {c}) AS n_unique,
                {corr_sql(c, y)} AS corr_raw,
                sum({y}) FILTER (WHERE {c} IS NOT NULL) AS p, count({c}) - sum({y}) FILTER (WHERE {c} IS NOT NULL) AS q,
                (count(*) - count({c})) / CAST(count(*) AS DOUBLE) AS null_rate,
                CASE WHEN count(*) = count({c}) THEN 0 ELSE sum({y}) FILTER (WHERE {c} IS NULL) / CAST(nullif(sum({y}), 0) AS DOUBLE) END AS nf0,
                CASE WHEN count(*) = count({c}) THEN 0 ELSE sum(1 - {y}) FILTER (WHERE {c} IS NULL) / CAST(nullif(sum(1 - {y}), 0) AS DOUBLE) END AS nh0
         FROM {src}) b,
        (SELECT sum(CAST(gp AS DOUBLE) * (below + (gn - gp) / 2.0::DOUBLE)) AS u,
                max(abs(cp / CAST(nullif(tp, 0) AS DOUBLE) - (cn - cp) / CAST(nullif(tn - tp, 0) AS DOUBLE))) AS ks
         FROM (SELECT *, sum(gp) OVER (ORDER BY v) AS cp, sum(gn) OVER (ORDER BY v) AS cn,
                      sum(gn - gp) OVER (ORDER BY v) - (gn - gp) AS below, sum(gp) OVER () AS tp, sum(gn) OVER () AS tn
               FROM (SELECT {c} AS v, count(*) AS gn, sum({y}) AS gp FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}) g) h) a"""
    return " UNION ALL ".join(one(c) for c in columns)


def _report_sql(src: str, columns, y: str = "failure", level: str = "drive-day", rules: LeakageRules = RULES) -> str:
    r = rules
    return f"""SELECT *, {_verdict_sql(r, True)} FROM (
      SELECT "column", level, coverage, n_unique, null_rate, coalesce(nf0, CASE WHEN null_rate > 0 THEN 0 END) AS null_if_failure,
             coalesce(nh0, CASE WHEN null_rate > 0 THEN 0 END) AS null_if_healthy,
             coalesce(nf0, 0) - coalesce(nh0, 0) AS missing_gap, CAST(NULL AS DOUBLE) AS max_lift,
             CASE WHEN n_unique >= 2 AND p > 0 AND q > 0 THEN corr_raw END AS corr,
             CASE WHEN n_unique >= 2 AND p > 0 AND q > 0 THEN u / (CAST(p AS DOUBLE) * q) END AS auc,
             CASE WHEN n_unique >= 2 AND p > 0 AND q > 0 THEN greatest(u / (CAST(p AS DOUBLE) * q), 1 - u / (CAST(p AS DOUBLE) * q)) END AS auc_directional,
             CASE WHEN n_unique >= 2 AND p > 0 AND q > 0 THEN (1 + ks) / 2 END AS balanced_acc
      FROM ({_association_sql(src, columns, y, level)}) x) z"""


def _verdict_sql(r: LeakageRules, numeric: bool) -> str:
    auc, bal, corr = ("auc_directional", "balanced_acc", "abs(corr)") if numeric else ("CAST(NULL AS DOUBLE)",) * 3
    tests = [("SEVERE LEAK", auc, r.severe_auc, "rank AUC"), ("SEVERE LEAK", bal, r.severe_balanced_acc, "balanced accuracy"),
             ("SEVERE LEAK", corr, r.severe_corr, "point-biserial r"), ("SEVERE LEAK", "abs(missing_gap)", r.severe_gap, "missingness gap"),
             ("SEVERE LEAK", "max_lift", r.severe_lift, "level lift"), ("suspect", auc, r.suspect_auc, "rank AUC"),
             ("suspect", "abs(missing_gap)", r.suspect_gap, "missingness gap"), ("suspect", "max_lift", r.suspect_lift, "level lift")]
    v = " ".join(f"WHEN {e} >= {lim} THEN '{lev}'" for lev, e, lim, _ in tests)
    w = " ".join(f"WHEN {e} >= {lim} THEN '{t} ' || CAST(round({e}, 3) AS VARCHAR)" for _, e, lim, t in tests)
    return f"CASE {v} ELSE 'clean' END AS verdict, CASE {w} ELSE '' END AS reason"


_ASSOC = "column:s coverage:r n_unique:i corr:r auc:r auc_directional:r balanced_acc:r"
_MISS = "column:s null_rate:r null_if_failure:r null_if_healthy:r missing_gap:r"
NUM_SQL = f"{WITH}, num AS ({_report_sql('dd', EVENT_ATTRS)})"


def numeric_report(spark, d):
    return leakage.audit_numeric(events_days(spark, d), EVENT_ATTRS, rules=RULES)


@query("l1_column_association", _ASSOC, f"{NUM_SQL} SELECT * FROM num")
def _(spark, d):
    return numeric_report(spark, d)


@query("l1_column_association_supply", _ASSOC, f"WITH {SUPPLY_SQL}, num AS ({_report_sql('dd', SUPPLY_ATTRS)}) SELECT * FROM num")
def _(spark, d):
    return leakage.audit_numeric(supply_days(spark, d), SUPPLY_ATTRS, rules=RULES)


@query("l2_missingness_gap", _MISS, f"{NUM_SQL} SELECT * FROM num")
def _(spark, d):
    return numeric_report(spark, d)


@query("l5_l6_numeric_audit", _ASSOC + " missing_gap:r verdict:s reason:s level:s", f"{NUM_SQL} SELECT * FROM num")
def _(spark, d):
    return numeric_report(spark, d)


# Topology columns: the supplier's nation stands for the site, the first event of the day for the slot.
_TOPO = """topo AS (SELECT dd.*, s.s_nationkey AS site, CASE WHEN dd.n > 1 THEN 'R' || CAST(dd.n AS VARCHAR) END AS rack
  FROM dd LEFT JOIN supplier s ON s.s_suppkey = dd.drive)"""


def _cat_sql(columns) -> str:
    def one(c: str, blank: str) -> str:
        return f"""SELECT '{c}' AS "column", 'drive-day' AS level, count(*) FILTER (WHERE n > n_null) AS cardinality,
          CASE WHEN count(*) < 2 OR max(tp) = 0 OR max(tp) = max(tn) THEN 0 ELSE
            sqrt(sum(power(p - n * tp / CAST(tn AS DOUBLE), 2) / greatest(n * tp / CAST(tn AS DOUBLE), 1e-12)
                   + power(n - p - n * (tn - tp) / CAST(tn AS DOUBLE), 2) / greatest(n * (tn - tp) / CAST(tn AS DOUBLE), 1e-12)) / max(tn)) END AS cramers_v,
          max(CASE WHEN n >= {RULES.min_support} THEN (p / CAST(n AS DOUBLE)) / (tp / CAST(tn AS DOUBLE)) END) AS max_lift,
          sum(n_null) / CAST(max(tn) AS DOUBLE) AS null_rate,
          CASE WHEN sum(n_null) = 0 THEN 0 ELSE sum(p_null) / CAST(max(tp) AS DOUBLE) END AS null_if_failure,
          CASE WHEN sum(n_null) = 0 THEN 0 ELSE (sum(n_null) - sum(p_null)) / CAST(max(tn - tp) AS DOUBLE) END AS null_if_healthy
        FROM (SELECT *, sum(n) OVER () AS tn, sum(p) OVER () AS tp FROM (
          SELECT coalesce(CAST({c} AS VARCHAR), '{blank}') AS lvl, count(*) AS n, sum(failure) AS p,
                 count(*) FILTER (WHERE {c} IS NULL) AS n_null, coalesce(sum(failure) FILTER (WHERE {c} IS NULL), 0) AS p_null
          FROM topo GROUP BY 1) g) h"""
    return f"""SELECT *, {_verdict_sql(RULES, False)} FROM (SELECT *, null_if_failure - null_if_healthy AS missing_gap
      FROM ({" UNION ALL ".join(one(c, b) for c, b in columns)}) x) z"""


_CATS = (("site", "-1"), ("rack", "<NA>"))
CAT_SQL = f"WITH {SUPPLY_SQL}, {_TOPO}, cat AS ({_cat_sql(_CATS)})"


def topology(spark, d):
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("drive"), F.col("s_nationkey").alias("site"))
    rack = F.when(F.col("n") > 1, F.concat(F.lit("R"), F.col("n").cast("string")))
    return supply_days(spark, d).join(sup, "drive", "left").withColumn("rack", rack)


def categorical_report(spark, d):
    return leakage.audit_categorical(topology(spark, d), ["site", "rack"], rules=RULES)


@query("l3_cramers_v", "column:s cardinality:i cramers_v:r", f"{CAT_SQL} SELECT * FROM cat")
def _(spark, d):
    return categorical_report(spark, d)


@query("l4_level_lift", "column:s cardinality:i max_lift:r", f"{CAT_SQL} SELECT * FROM cat")
def _(spark, d):
    return categorical_report(spark, d)


@query("l7_categorical_audit", "column:s cardinality:i cramers_v:r max_lift:r null_rate:r null_if_failure:r null_if_healthy:r "
       "missing_gap:r verdict:s reason:s", f"{CAT_SQL} SELECT * FROM cat")
def _(spark, d):
    return categorical_report(spark, d)


_GEO = """geo AS (SELECT drive, day, failure, datediff('day', min(day) OVER w, day) AS days_since_first_record,
  datediff('day', day, max(day) OVER w) AS days_to_last_record, datediff('day', min(day) OVER w, max(day) OVER w) + 1 AS record_length_days,
  CASE WHEN max(day) OVER w = (SELECT max(day) FROM dd) THEN 1 ELSE 0 END AS still_reporting_at_export_end,
  datediff('day', max(day) OVER w, (SELECT max(day) FROM dd)) AS days_from_record_end_to_export_end,
  datediff('day', (SELECT min(day) FROM dd), day) AS calendar_day_index FROM dd WINDOW w AS (PARTITION BY drive))"""


@query("l8_record_geometry", "drive:i day:d " + " ".join(f"{c}:i" for c in leakage.DAY_PROBES),
       f"{WITH}, {_GEO} SELECT * FROM geo")
def _(spark, d):
    return leakage.record_geometry(events_days(spark, d))


@query("l9_geometry_audit", _ASSOC + " verdict:s level:s",
       f"""{WITH}, {_GEO}, per AS (SELECT drive, max(failure) AS failure, {", ".join(f"max({c}) AS {c}" for c in leakage.DRIVE_PROBES)}
            FROM geo GROUP BY drive)
       SELECT * FROM ({_report_sql("geo", leakage.DAY_PROBES, level="per drive-day")}) a
       UNION ALL SELECT * FROM ({_report_sql("per", leakage.DRIVE_PROBES, level="per drive")}) b""")
def _(spark, d):
    return leakage.audit_geometry(events_days(spark, d), RULES)


@query("l10_per_drive_summary", "drive:i first_day:d last_day:d n_observed:i ever_failed:i model:s span_days:i gap_days:i coverage:r n_windows:i",
       f"""WITH {SUPPLY_SQL}, s AS (SELECT drive, min(day) AS first_day, max(day) AS last_day, count(*) AS n_observed,
           max(failure) AS ever_failed, min(model) AS model, datediff('day', min(day), max(day)) + 1 AS span_days FROM dd GROUP BY drive)
       SELECT *, span_days - n_observed AS gap_days, n_observed / CAST(span_days AS DOUBLE) AS coverage,
              greatest(span_days - 89, 0) AS n_windows FROM s""")
def _(spark, d):
    return leakage.per_drive_summary(supply_days(spark, d))


def full_audit(spark, d):
    days = events_days(spark, d).withColumn("shelf", F.concat(F.lit("S"), F.col("drive") % 7))
    return leakage.audit(days, EVENT_ATTRS, ("model", "shelf"), rules=RULES, window_days=7)


@query("l11_blocklist", "column:s",
       f"""{NUM_SQL}, {_GEO}, per AS (SELECT drive, max(failure) AS failure, {", ".join(f"max({c}) AS {c}" for c in leakage.DRIVE_PROBES)}
            FROM geo GROUP BY drive),
       topo AS (SELECT *, 'S' || (drive % 7) AS shelf FROM dd),
       cat AS ({_cat_sql((("shelf", "<NA>"),))}),
       v AS (SELECT "column", verdict FROM num UNION ALL SELECT "column", verdict FROM cat
             UNION ALL SELECT "column", verdict FROM ({_report_sql("geo", leakage.DAY_PROBES)}) a
             UNION ALL SELECT "column", verdict FROM ({_report_sql("per", leakage.DRIVE_PROBES)}) b)
       SELECT DISTINCT "column" FROM v WHERE verdict <> 'clean'
       UNION SELECT 'drive' UNION SELECT 'day' UNION SELECT 'failure'""")
def _(spark, d):
    report = full_audit(spark, d)
    return spark.createDataFrame([(c,) for c in report.blocklist], "column string")


_SEL = LeakageRules(min_support=100, min_coverage=0.3)


@query("l12_selected_features", "place:i column:s auc_directional:r",
       f"""{NUM_SQL} SELECT row_number() OVER (ORDER BY auc_directional DESC, "column") AS place, "column", auc_directional
       FROM num WHERE coverage >= 0.3 AND n_unique >= 3 AND verdict = 'clean'""")
def _(spark, d):
    from pyspark.sql import Window
    report = numeric_report(spark, d)
    blocked = [r["column"] for r in report.where("verdict <> 'clean'").select("column").collect()]
    good = leakage.candidate_features(report, blocked, _SEL)
    # One row per column of the feed.
    return good.withColumn("place", F.row_number().over(Window.orderBy(F.col("auc_directional").desc(), "column")))


@query("l13_top_auc", "column:s auc_directional:r",
       f"""{NUM_SQL} SELECT * FROM num ORDER BY auc_directional DESC NULLS LAST, "column" LIMIT 12""")
def _(spark, d):
    return leakage.ranked_view(numeric_report(spark, d), "auc_directional", 12)


@query("l13_top_missing_gap", "column:s missing_gap:r",
       f"""{NUM_SQL} SELECT * FROM num ORDER BY abs(missing_gap) DESC NULLS LAST, "column" LIMIT 6""")
def _(spark, d):
    return leakage.ranked_view(numeric_report(spark, d), "missing_gap", 6, absolute=True)


@query("l13_top_lift", "column:s max_lift:r",
       f"""{CAT_SQL} SELECT * FROM cat ORDER BY max_lift DESC NULLS LAST, "column" LIMIT 12""")
def _(spark, d):
    return leakage.ranked_view(categorical_report(spark, d), "max_lift", 12)


@query("l14_flagged", "column:s verdict:s level:s auc_directional:r",
       f"""{NUM_SQL}, {_GEO}, per AS (SELECT drive, max(failure) AS failure, {", ".join(f"max({c}) AS {c}" for c in leakage.DRIVE_PROBES)}
            FROM geo GROUP BY drive),
       v AS (SELECT "column", level, verdict, auc_directional FROM num
             UNION ALL SELECT "column", level, verdict, auc_directional FROM ({_report_sql("geo", leakage.DAY_PROBES, level="per drive-day")}) a
             UNION ALL SELECT "column", level, verdict, auc_directional FROM ({_report_sql("per", leakage.DRIVE_PROBES, level="per drive")}) b),
       r AS (SELECT *, row_number() OVER (PARTITION BY "column", verdict ORDER BY auc_directional DESC NULLS LAST, level) AS rn FROM v)
       SELECT "column", verdict, level, auc_directional FROM r WHERE rn = 1 AND (verdict = 'SEVERE LEAK'
         OR (verdict = 'suspect' AND "column" NOT IN (SELECT "column" FROM v WHERE verdict = 'SEVERE LEAK')))""")
def _(spark, d):
    days = events_days(spark, d)
    report = leakage.LeakageReport(numeric_report(spark, d), None, leakage.audit_geometry(days, RULES), days)
    verdicts = report.verdicts()
    return leakage.flagged(verdicts, leakage.SEVERE).unionByName(leakage.flagged(verdicts, leakage.SUSPECT))


@query("l16_label_invariance", "rows:i lost:i gained:i",
       f"""{WITH}, {census_sql(7)}, {tiles_sql(EVENT_SPEC)} SELECT count(*) AS rows, 0 AS lost, 0 AS gained FROM tiles""")
def _(spark, d):
    def build(readings):
        feats = features.window_aggregates(cal.densify(readings, EVENT_SPEC), EVENT_SPEC, "tile")
        return feats.select("drive", "start", *EVENT_SPEC.feature_names)
    return leakage.label_invariance(build, events_days(spark, d))


_LAST = [f"{c}__last" for c in SUPPLY_SPEC.channels]


@query("l16_channel_separability", _ASSOC + " verdict:s",
       f"""WITH {SUPPLY_SQL}, {dense_sql(SUPPLY_SPEC)}, {tiles_sql(SUPPLY_SPEC)},
       {aggregate_sql(SUPPLY_SPEC, SUPPLY_SPEC.channels, aggregates=("last",))},
       lab AS (SELECT t.*, {label_sql(SUPPLY_SPEC, "t")} AS label FROM feat t)
       SELECT * FROM ({_report_sql("lab", _LAST, "label", "window")}) r""")
def _(spark, d):
    dense = cal.densify(supply_days(spark, d), SUPPLY_SPEC)
    last = features.window_aggregates(dense, SUPPLY_SPEC, "tile", aggregates=("last",))
    return leakage.audit_numeric(last, _LAST, label="label", rules=RULES, level="window")

"""Timeline, split and sampled-cohort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.order import score_rank
from ..operators import calendar as cal
from ..operators import splits, timeline, windows
from ..session import settle
from .base import query
from .views import (DRIVE_SCORES_SQL, EVENTS_SQL, SCORED_SQL, SUPPLY_SPEC, SUPPLY_SQL, census_sql, dense_sql,
                    events_days, label_sql, scored_windows, supply_days, supply_dense, tiles_sql)

SS = SUPPLY_SPEC

SPLIT_SQL = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY has_failure ORDER BY md5('42|' || drive), drive) AS rn,
                  count(*) OVER (PARTITION BY has_failure) AS n FROM cal),
sized AS (SELECT *, round_even(n * 0.2::DOUBLE, 0) AS n_test FROM ranked),
split AS (SELECT drive, first_day, n_days, n_fail, has_failure,
                 CASE WHEN rn <= n_test THEN 'test'
                      WHEN rn <= n_test + round_even((n - n_test) * 0.15::DOUBLE, 0) THEN 'val'
                      ELSE 'train' END AS split FROM sized)"""
BASE = f"WITH {SUPPLY_SQL}, {dense_sql(SS)}, {SPLIT_SQL}"
BASE_CENSUS = f"WITH {SUPPLY_SQL}, {census_sql(30)}, {SPLIT_SQL}"

TIMELINE_SQL = f"""
drawn AS (SELECT s.*, i, CAST(('0x' || substr(md5('42|0|' || drive || '|' || i || '|start'), 1, 8)) AS BIGINT)
                          % (n_days - 29) AS start FROM split s, unnest(generate_series(0, 1)) AS t(i)),
real_days AS (SELECT w.drive, w.i, sum(c.observed) AS n_real FROM drawn w
              JOIN chan c ON c.drive = w.drive AND c.pos BETWEEN w.start AND w.start + 29 GROUP BY w.drive, w.i),
timeline AS (
  SELECT w.split, w.drive, w.i, w.first_day + CAST(w.start AS INTEGER) AS start_day,
         w.first_day + CAST(w.start + 29 AS INTEGER) AS end_day, w.start, w.n_days,
         CASE WHEN w.n_days > 30 THEN w.start / CAST(w.n_days - 30 AS DOUBLE) ELSE 0 END AS life_fraction,
         w.n_days - w.start - 30 AS days_to_record_end, r.n_real, 30 - r.n_real AS n_filled,
         {label_sql(SS, "w")} AS label
  FROM drawn w JOIN real_days r ON r.drive = w.drive AND r.i = w.i)"""


def split_drives(spark, d):
    drives = cal.census(supply_days(spark, d), single_pass=True).where(F.col("n_days") >= SS.days)
    return splits.grouped_split(drives)


def sample_timeline(spark, d):
    return timeline.window_timeline(split_drives(spark, d), supply_dense(spark, d), SS)


@query("w27_window_timeline", "split:s drive:i i:i start_day:d end_day:d start:i life_fraction:r n_days:i "
       "days_to_record_end:i n_real:i n_filled:i label:i", f"{BASE}, {TIMELINE_SQL} SELECT * FROM timeline")
def _(spark, d):
    return sample_timeline(spark, d)


@query("w28_timeline_checks", "windows:i positives:i first_start:d last_start:d distinct_start_days:i "
       "calendar_days:i quarter_pct:r quarter_uniform_pct:r month_pct:r month_uniform_pct:r mean_real_days:r",
       f"""{BASE}, {TIMELINE_SQL}, edge AS (SELECT min(start_day) AS a, max(start_day) AS b FROM timeline),
       days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM edge),
       uni AS (SELECT count(*) AS n, count(*) FILTER (WHERE date_trunc('quarter', day) = day) AS q,
                      count(*) FILTER (WHERE date_trunc('month', day) = day) AS m FROM days)
       SELECT count(*) AS windows, sum(label) AS positives, min(start_day) AS first_start, max(start_day) AS last_start,
              count(DISTINCT start_day) AS distinct_start_days, max(uni.n) AS calendar_days,
              100.0::DOUBLE * count(*) FILTER (WHERE date_trunc('quarter', start_day) = start_day) / count(*) AS quarter_pct,
              100.0::DOUBLE * max(uni.q) / max(uni.n) AS quarter_uniform_pct,
              100.0::DOUBLE * count(*) FILTER (WHERE date_trunc('month', start_day) = start_day) / count(*) AS month_pct,
              100.0::DOUBLE * max(uni.m) / max(uni.n) AS month_uniform_pct, avg(n_real) AS mean_real_days
       FROM timeline, uni""")
def _(spark, d):
    return timeline.timeline_checks(sample_timeline(spark, d))


@query("w28_weekday_spread", "weekday:i n:i share:r",
       f"""{BASE}, {TIMELINE_SQL} SELECT dayofweek(start_day) + 1 AS weekday, count(*) AS n,
       count(*) / CAST((SELECT count(*) FROM timeline) AS DOUBLE) AS share FROM timeline GROUP BY 1""")
def _(spark, d):
    return timeline.weekday_spread(sample_timeline(spark, d))


@query("w29_live_windows", "day:d live:i",
       f"""WITH {SUPPLY_SQL}, {census_sql(30)}, {tiles_sql(SS)},
       bounds AS (SELECT first_day + CAST(start AS INTEGER) AS a, first_day + CAST(start + 30 AS INTEGER) AS b FROM tiles),
       span AS (SELECT CAST(unnest(generate_series(min(a), max(b) - 1, INTERVAL 1 DAY)) AS DATE) AS day FROM bounds)
       SELECT span.day, count(bounds.a) AS live FROM span LEFT JOIN bounds ON span.day >= a AND span.day < b
       GROUP BY span.day""")
def _(spark, d):
    tiles = windows.tile_windows(cal.census(supply_days(spark, d), single_pass=True), SS)
    return timeline.live_windows(windows.window_dates(tiles, SS))


@query("w30_split_coverage", "split:s drives:i failing:i days:i tiling_windows:i all_windows:i",
       f"""{BASE_CENSUS} SELECT split, count(*) AS drives, sum(has_failure) AS failing, sum(n_days) AS days,
       sum(ceil(n_days / 30.0)) AS tiling_windows, sum(n_days - 29) AS all_windows FROM split GROUP BY split""")
def _(spark, d):
    return timeline.split_coverage(split_drives(spark, d), SS)


_DRAW = "CAST(('0x' || substr(md5('42|0|' || c.drive || '|' || i || '|{w}'), 1, 8)) AS BIGINT)"


@query("w31_positive_rate", "enumerated_rate:r expected_rate:r measured_rate:r pos_weight:r",
       f"""WITH {SUPPLY_SQL}, {census_sql(30)},
       wins AS (SELECT drive, n_days, s AS start FROM cal, unnest(generate_series(0, n_days - 30)) AS t(s)),
       lab AS (SELECT w.drive, {label_sql(SS, "w")} AS label FROM wins w),
       per AS (SELECT drive, sum(label) AS p, count(*) AS n FROM lab GROUP BY drive),
       drawn AS (SELECT c.drive, i, {_DRAW.format(w="start")} % (n_days - 29) AS start
                 FROM cal c, unnest(generate_series(0, 3)) AS t(i)),
       dl AS (SELECT {label_sql(SS, "w")} AS label FROM drawn w),
       m AS (SELECT avg(CAST(label AS DOUBLE)) AS r FROM dl)
       SELECT (SELECT sum(p) / CAST(sum(n) AS DOUBLE) FROM per) AS enumerated_rate,
              (SELECT avg(p / CAST(n AS DOUBLE)) FROM per) AS expected_rate,
              r AS measured_rate, CASE WHEN r > 0 THEN (1 - r) / r END AS pos_weight FROM m""")
def _(spark, d):
    return timeline.positive_rate(cal.census(supply_days(spark, d), single_pass=True), SS)


@query("w31_positive_rate_forced", "enumerated_rate:r expected_rate:r",
       f"""WITH {SUPPLY_SQL}, {census_sql(30)},
       wins AS (SELECT drive, n_days, s AS start FROM cal, unnest(generate_series(0, n_days - 30)) AS t(s)),
       lab AS (SELECT w.drive, {label_sql(SS, "w")} AS label FROM wins w),
       per AS (SELECT drive, sum(label) AS p, count(*) AS n FROM lab GROUP BY drive)
       SELECT sum(p) / CAST(sum(n) AS DOUBLE) AS enumerated_rate,
              avg(CAST(CASE WHEN p = 0 THEN 0 WHEN p < n THEN 0.25 ELSE 1 END AS DOUBLE)) AS expected_rate FROM per""")
def _(spark, d):
    return timeline.positive_rate(cal.census(supply_days(spark, d), single_pass=True), SS, positive_ratio=0.25)


@query("w32_train_probe", "drive:i has_failure:i windows:i",
       f"""{BASE_CENSUS}, v AS (SELECT count(*) AS size, avg(CAST(has_failure AS DOUBLE)) AS share FROM split WHERE split = 'val'),
       pool AS (SELECT *, row_number() OVER (PARTITION BY has_failure ORDER BY md5('42|' || drive), drive) AS rk
                FROM split WHERE split = 'train'),
       nf AS (SELECT least((SELECT sum(has_failure) FROM pool), round_even(size * share, 0)) AS f, size FROM v)
       SELECT drive, has_failure, (n_days - 30) // 15 + 1 AS windows FROM pool, nf
       WHERE rk <= CASE WHEN has_failure = 1 THEN f ELSE size - f END""")
def _(spark, d):
    probe = splits.train_probe(split_drives(spark, d))
    wins = windows.enumerate_windows(probe, SS)
    return wins.groupBy("drive", "has_failure").agg(F.count(F.lit(1)).alias("windows"))


@query("w33_timeline_histograms", "measure:s bin:s n:i",
       f"""{BASE}, {TIMELINE_SQL}, parts AS (
         SELECT 'life_fraction' AS measure, CAST(least(greatest(CAST(floor(life_fraction * 20) AS INTEGER) + 1, 1), 20) AS VARCHAR) AS bin FROM timeline
         UNION ALL SELECT 'n_real', CAST(n_real AS VARCHAR) FROM timeline
         UNION ALL SELECT 'record_days', CAST(least(CAST(floor(n_days / CAST((SELECT max(n_days) FROM timeline) AS DOUBLE) * 20) AS INTEGER) + 1, 20) AS VARCHAR) FROM timeline
         UNION ALL SELECT 'start_month', strftime(start_day, '%Y-%m') FROM timeline
         UNION ALL SELECT 'end_month', strftime(end_day, '%Y-%m') FROM timeline)
       SELECT measure, bin, count(*) AS n FROM parts GROUP BY measure, bin""")
def _(spark, d):
    return timeline.timeline_histograms(sample_timeline(spark, d))


@query("w34_last_days", "drive:i day:d n_click:i",
       f"""WITH {EVENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY day DESC) AS b FROM dd)
       SELECT drive, day, n_click FROM r WHERE b <= 5 + drive % 7""")
def _(spark, d):
    days = events_days(spark, d)
    lengths = days.select("drive").distinct().withColumn("n", 5 + F.col("drive") % 7)
    return windows.last_days(days, lengths)


@query("w35_snapshot", "drive:i day:d q:r",
       f"""WITH {SUPPLY_SQL}, {census_sql(30)}, m AS (SELECT max(day) AS newest FROM dd)
       SELECT dd.drive, dd.day, dd.q FROM dd JOIN cal ON cal.drive = dd.drive, m
       WHERE cal.last_day >= newest - 2 AND dd.day > newest - 30""")
def _(spark, d):
    return windows.snapshot(supply_days(spark, d), SS)


@query("w36_spread_picks", "rank:i drive:i score:r",
       f"""WITH {SCORED_SQL}, {DRIVE_SCORES_SQL},
       r AS (SELECT *, row_number() OVER (ORDER BY score DESC, md5(CAST(drive AS VARCHAR)), drive) AS rank,
                    count(*) OVER () AS n FROM drive_scores)
       SELECT rank, drive, score FROM r
       WHERE rank IN (SELECT CAST(floor(i * (SELECT max(n) - 1 FROM r) / 11.0) AS BIGINT) + 1
                      FROM generate_series(0, 11) AS t(i))""")
def _(spark, d):
    per = settle(scored_windows(spark, d).groupBy("drive").agg(F.max("score").alias("score")))
    return windows.spread_picks(score_rank(per, "score", [F.col("drive")]), 12)


@query("x1_stratified_split", "drive:i has_failure:i split:s", f"{BASE_CENSUS} SELECT * FROM split")
def _(spark, d):
    return split_drives(spark, d)


@query("x2_grouped_split", "drive:i split:s",
       f"""WITH {EVENTS_SQL}, ids AS (SELECT DISTINCT drive FROM dd),
       r AS (SELECT drive, row_number() OVER (ORDER BY md5('7|' || drive), drive) AS rn, count(*) OVER () AS n FROM ids),
       s AS (SELECT *, round_even(n * 0.2::DOUBLE, 0) AS nt FROM r)
       SELECT drive, CASE WHEN rn <= nt THEN 'test'
                          WHEN rn <= nt + round_even((n - nt) * 0.15::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split
       FROM s""")
def _(spark, d):
    return splits.grouped_split(events_days(spark, d).select("drive").distinct(), strata=(), seed=7)


@query("x3_split_integrity", "pair:s drives:i shared:i",
       f"""{BASE_CENSUS} SELECT a.pair, (SELECT count(*) FROM split) AS drives,
         (SELECT count(*) FROM (SELECT drive FROM split WHERE split = a.l INTERSECT
                                SELECT drive FROM split WHERE split = a.r) x) AS shared
       FROM (VALUES ('train_val', 'train', 'val'), ('train_test', 'train', 'test'), ('val_test', 'val', 'test')) a(pair, l, r)""")
def _(spark, d):
    return splits.split_integrity(split_drives(spark, d))


@query("x9_class_weights", "label:i n:i sampling_weight:r pos_weight:r",
       f"""WITH {SCORED_SQL}, c AS (SELECT label, count(*) AS n FROM scored GROUP BY label)
       SELECT label, n, 1.0::DOUBLE / n AS sampling_weight,
              CASE WHEN label = 1 THEN ((SELECT sum(n) FROM c) - n) / CAST(n AS DOUBLE) ELSE 1.0 END AS pos_weight FROM c""")
def _(spark, d):
    return splits.class_weights(scored_windows(spark, d))


@query("x9_balanced_weight", "drive:i start:i weight:r",
       f"""WITH {SCORED_SQL}, t AS (SELECT count(*) AS n, sum(label) AS p FROM scored)
       SELECT drive, start, CASE WHEN label = 1 THEN 0.3 * n / CAST(p AS DOUBLE)
                                 ELSE 0.7 * n / CAST(n - p AS DOUBLE) END AS weight FROM scored, t""")
def _(spark, d):
    return splits.balanced_weight(scored_windows(spark, d))


@query("s8_keep_failures_slice", "drive:i day:d failure:i",
       f"""WITH {EVENTS_SQL}, m AS (SELECT max(day) AS newest FROM dd WHERE model = 'M1'),
       recent AS (SELECT dd.* FROM dd, m WHERE model = 'M1' AND day >= newest - 29),
       per AS (SELECT drive, max(failure) AS failed FROM recent GROUP BY drive),
       r AS (SELECT *, row_number() OVER (PARTITION BY failed ORDER BY md5('42|' || drive), drive) AS rk FROM per)
       SELECT recent.drive, day, failure FROM recent JOIN r ON r.drive = recent.drive WHERE failed = 1 OR rk <= 10""")
def _(spark, d):
    from ..sources.cohorts import recent_slice
    return recent_slice(events_days(spark, d), family="M1", days=30, healthy=10)


@query("s20_family_sample", "drive:i day:d model:s",
       f"""WITH {EVENTS_SQL}, per AS (SELECT drive, min(model) AS model, max(failure) AS failed FROM dd GROUP BY drive),
       r AS (SELECT *, row_number() OVER (PARTITION BY model, failed ORDER BY md5('42|' || drive), drive) AS rk FROM per)
       SELECT dd.drive, dd.day, dd.model FROM dd JOIN r ON r.drive = dd.drive WHERE rk <= 3""")
def _(spark, d):
    return splits.family_sample(events_days(spark, d), 3)


@query("s20_keep_failures_sample", "drive:i day:d failure:i",
       f"""WITH {EVENTS_SQL}, per AS (SELECT drive, max(failure) AS failed FROM dd GROUP BY drive),
       r AS (SELECT *, row_number() OVER (PARTITION BY failed ORDER BY md5('42|' || drive), drive) AS rk FROM per)
       SELECT dd.drive, day, failure FROM dd JOIN r ON r.drive = dd.drive WHERE failed = 1 OR rk <= 20""")
def _(spark, d):
    return splits.keep_failures_sample(events_days(spark, d), 20)


@query("l15_whole_drive_sample", "drive:i readings:i",
       f"""WITH {EVENTS_SQL}, r AS (SELECT drive, count(*) AS readings,
            row_number() OVER (ORDER BY md5('42|' || drive), drive) AS rk FROM dd GROUP BY drive)
       SELECT drive, readings FROM r WHERE rk <= 40""")
def _(spark, d):
    s = splits.whole_drive_sample(events_days(spark, d), 40)
    return s.groupBy("drive").agg(F.count(F.lit(1)).alias("readings"))

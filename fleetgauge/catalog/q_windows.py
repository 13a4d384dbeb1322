"""Calendar, window and window-feature queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import features, windows
from .base import query
from .views import (EVENT_SPEC, EVENTS_SQL, SUPPLY_SPEC, SUPPLY_SQL, aggregate_sql, census_sql, dense_sql,
                    events_days, label_sql, supply_days, table, tiles_sql)

ES, SS = EVENT_SPEC, SUPPLY_SPEC
SUPPLY_CENSUS = f"WITH {SUPPLY_SQL}, {census_sql(SS.days)}"


def supply_census(spark, d):
    return cal.census(supply_days(spark, d), single_pass=True)


@query("v1_events_days", "drive:i day:d model:s failure:i n_click:i n_error:i m_error:r m_view:r",
       f"WITH {EVENTS_SQL} SELECT * FROM dd")
def _(spark, d):
    return events_days(spark, d)


@query("v2_supply_days", "drive:i day:d model:s failure:i q:r p:r disc:r n:i", f"WITH {SUPPLY_SQL} SELECT * FROM dd")
def _(spark, d):
    return supply_days(spark, d)


@query("w1_census", "drive:i first_day:d last_day:d n_days:i n_obs:i n_fail:i has_failure:i",
       f"WITH {SUPPLY_SQL}, {census_sql()} SELECT * FROM cal")
def _(spark, d):
    return supply_census(spark, d)


@query("w2_long_enough", "drive:i readings:i dense_days:i",
       f"""WITH {EVENTS_SQL}, {census_sql(20)}
       SELECT dd.drive, count(*) AS readings, max(cal.n_days) AS dense_days FROM dd JOIN cal ON cal.drive = dd.drive
       GROUP BY dd.drive""")
def _(spark, d):
    kept = cal.long_enough(events_days(spark, d), 20)
    return kept.groupBy("drive").agg(
        F.count(F.lit(1)).alias("readings"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("dense_days"))


@query("w3_dedupe_days", "drive:i day:d failure:i event_id:i value:r",
       """SELECT drive, day, failure, event_id, value FROM (
            SELECT user_id AS drive, CAST(ts AS DATE) AS day, event_id, value,
                   CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failure,
                   row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE)
                     ORDER BY CASE WHEN event_type = 'error' THEN 1 ELSE 0 END DESC, event_id DESC) AS rn
            FROM events) x WHERE rn = 1""")
def _(spark, d):
    raw = table(spark, d, "events").select(
        F.col("user_id").alias("drive"), F.to_date("ts").alias("day"),
        (F.col("event_type") == "error").cast("int").alias("failure"), "event_id", "value")
    return cal.dedupe_days(raw, ["event_id"])


_DENSE_COLS = ("drive:i day:d pos:i n_days:i observed:i failure:i n_click:r m_error:r m_view:r n_click_d1:r "
               "m_error_d1:r m_view_d1:r n_click_d3:r m_error_d3:r m_view_d3:r")


@query("w4_w8_dense_channels", _DENSE_COLS, f"WITH {EVENTS_SQL}, {dense_sql(ES)} SELECT * FROM chan")
def _(spark, d):
    return cal.densify(events_days(spark, d), ES)


@query("w4_dense_calendar", "drive:i day:d pos:i observed:i", f"""WITH {SUPPLY_SQL}, {census_sql(30)}
       SELECT c.drive, c.pos, c.first_day + CAST(c.pos AS INTEGER) AS day,
              CASE WHEN dd.drive IS NULL THEN 0 ELSE 1 END AS observed
       FROM (SELECT drive, first_day, unnest(generate_series(0, n_days - 1)) AS pos FROM cal) c
       LEFT JOIN dd ON dd.drive = c.drive AND dd.day = c.first_day + CAST(c.pos AS INTEGER)""")
def _(spark, d):
    return cal.densify(supply_days(spark, d), replace(SS, attrs=(), lags=()), diffs=False)


@query("w5_log_levels", "drive:i day:d p:r m:r",
       f"""WITH {EVENTS_SQL} SELECT drive, day, ln(1 + greatest(n_click, 0)) AS p,
           CASE WHEN m_error IS NOT NULL THEN ln(1 + greatest(m_error - 50, 0)) END AS m FROM dd""")
def _(spark, d):
    from ..functions.expr import log_level
    return events_days(spark, d).select("drive", "day", log_level("n_click").alias("p"),
                                        log_level(F.col("m_error") - 50).alias("m"))


@query("w6_forward_fill", "drive:i day:d m_click:r m_signup:r",
       f"""WITH {EVENTS_SQL}, {dense_sql(replace(ES, attrs=("m_click", "m_signup"), log_attrs=()))}
       SELECT * FROM chan""")
def _(spark, d):
    return cal.densify(events_days(spark, d), replace(ES, attrs=("m_click", "m_signup"), log_attrs=()), diffs=False)


@query("w7_lagged_differences", "drive:i pos:i q_d1:r q_d7:r n_d1:r n_d7:r",
       f"WITH {SUPPLY_SQL}, {dense_sql(SS)} SELECT * FROM chan")
def _(spark, d):
    return cal.densify(supply_days(spark, d), SS)


@query("w8_observed_share", "drive:i observed_days:i dense_days:i",
       f"WITH {SUPPLY_SQL}, {dense_sql(SS)} SELECT drive, sum(observed) AS observed_days, count(*) AS dense_days "
       "FROM chan GROUP BY drive")
def _(spark, d):
    dense = cal.densify(supply_days(spark, d), SS, diffs=False)
    return dense.groupBy("drive").agg(F.sum("observed").alias("observed_days"), F.count(F.lit(1)).alias("dense_days"))


@query("w9_failure_positions", "drive:i fail_pos:i",
       f"WITH {SUPPLY_SQL}, {census_sql()} SELECT drive, f AS fail_pos FROM fails")
def _(spark, d):
    return cal.failure_positions(supply_days(spark, d))


_STRIDED = """SELECT drive, n_days, first_day, s AS start FROM cal,
              unnest(generate_series(0, n_days - {w}, {stride})) AS t(s)"""


@query("w10_window_labels", "drive:i start:i label:i",
       f"""{SUPPLY_CENSUS}, wins AS ({_STRIDED.format(w=30, stride=1)})
       SELECT w.drive, w.start, {label_sql(SS, "w")} AS label FROM wins w""")
def _(spark, d):
    return windows.enumerate_windows(supply_census(spark, d), replace(SS, stride=1))


@query("w10_window_labels_by_join", "drive:i start:i label:i",
       f"""{SUPPLY_CENSUS}, wins AS ({_STRIDED.format(w=30, stride=15)})
       SELECT w.drive, w.start, {label_sql(SS, "w")} AS label FROM wins w""")
def _(spark, d):
    drives = supply_census(spark, d)
    wins = windows.enumerate_windows(drives, SS).select("drive", "start")
    fails = drives.select("drive", F.explode("fail_pos").alias("fail_pos"))
    return windows.label_by_join(wins, fails, SS)


@query("w11_positive_starts", "drive:i start:i",
       f"""{SUPPLY_CENSUS} SELECT DISTINCT c.drive, s AS start FROM cal c JOIN fails f ON f.drive = c.drive,
       unnest(generate_series(greatest(f.f - {SS.reach}, 0), least(f.f, c.n_days - 30))) AS t(s)""")
def _(spark, d):
    return windows.positive_starts(supply_census(spark, d), SS)


@query("w12_negative_starts", "drive:i start:i",
       f"""{SUPPLY_CENSUS}, wins AS ({_STRIDED.format(w=30, stride=1)})
       SELECT drive, start FROM wins EXCEPT
       SELECT w.drive, w.start FROM wins w JOIN fails f ON f.drive = w.drive
       WHERE f.f BETWEEN w.start AND w.start + {SS.reach}""")
def _(spark, d):
    return windows.negative_starts(supply_census(spark, d), SS)


@query("w13_enumerated_windows", "drive:i start:i label:i",
       f"""{SUPPLY_CENSUS}, wins AS ({_STRIDED.format(w=30, stride=15)})
       SELECT w.drive, w.start, {label_sql(SS, "w")} AS label FROM wins w""")
def _(spark, d):
    return windows.enumerate_windows(supply_census(spark, d), SS)


@query("w14_enumerated_with_last", "drive:i start:i label:i",
       f"""{SUPPLY_CENSUS}, wins AS ({_STRIDED.format(w=30, stride=15)}
         UNION SELECT drive, n_days, first_day, n_days - 30 FROM cal)
       SELECT w.drive, w.start, {label_sql(SS, "w")} AS label FROM wins w""")
def _(spark, d):
    return windows.enumerate_windows(supply_census(spark, d), replace(SS, include_last=True))


@query("w15_painted_labels", "drive:i start:i",
       f"""{SUPPLY_CENSUS}, wins AS ({_STRIDED.format(w=30, stride=15)})
       SELECT w.drive, w.start FROM wins w WHERE {label_sql(SS, "w")} = 1""")
def _(spark, d):
    return windows.paint_labels(supply_census(spark, d), SS)


@query("w16_tiling", "drive:i tile:i start:i label:i",
       f"{SUPPLY_CENSUS}, {tiles_sql(SS)} SELECT t.drive, t.k AS tile, t.start, {label_sql(SS, 't')} AS label FROM tiles t")
def _(spark, d):
    return windows.tile_windows(supply_census(spark, d), SS)


@query("w17_tile_coverage", "drive:i n_days:i windows:i days_covered:i overlap_days:i",
       f"""{SUPPLY_CENSUS}, {tiles_sql(SS)} SELECT drive, max(n_days) AS n_days, count(*) AS windows,
       count(*) * 30 AS days_covered, count(*) * 30 - max(n_days) AS overlap_days FROM tiles GROUP BY drive""")
def _(spark, d):
    return windows.tile_coverage(supply_census(spark, d), SS)


def _draw_sql(what: str, drive: str = "c.drive", i: str = "i") -> str:
    return f"CAST(('0x' || substr(md5('42|0|' || {drive} || '|' || {i} || '|{what}'), 1, 8)) AS BIGINT)"


_DRAWS = "draws AS (SELECT c.*, i FROM cal c, unnest(generate_series(0, 3)) AS t(i))"
_FORCED = f"""
listed AS (SELECT drive, list(f ORDER BY f) AS fl FROM fails GROUP BY drive),
picked AS (
  SELECT c.*, l.fl, {_draw_sql("start")} % (c.n_days - 30 + 1) AS uniform,
         l.fl[CAST({_draw_sql("failure")} % len(l.fl) AS INTEGER) + 1] AS fail,
         {_draw_sql("force")} / 4294967296.0 AS coin, {_draw_sql("near")} AS near_draw,
         {_draw_sql("start")} AS start_draw
  FROM draws c LEFT JOIN listed l ON l.drive = c.drive),
bounded AS (
  SELECT *, greatest(fail - {SS.reach}, 0) AS low, least(fail, n_days - 30) AS high FROM picked)"""


@query("w18_random_windows", "drive:i i:i start:i label:i",
       f"""{SUPPLY_CENSUS}, {_DRAWS}, {_FORCED}, chosen AS (
         SELECT drive, i, CASE WHEN coin < 0.25 AND fl IS NOT NULL AND low <= high
                               THEN low + near_draw % (high - low + 1) ELSE uniform END AS start FROM bounded)
       SELECT w.*, {label_sql(SS, "w")} AS label FROM chosen w""")
def _(spark, d):
    return windows.random_windows(supply_census(spark, d), SS, per_drive=4, positive_ratio=0.25)


@query("w18_random_windows_plain", "drive:i i:i start:i label:i",
       f"""{SUPPLY_CENSUS}, {_DRAWS}, chosen AS (
         SELECT drive, i, {_draw_sql("start")} % (n_days - 30 + 1) AS start FROM draws c)
       SELECT w.*, {label_sql(SS, "w")} AS label FROM chosen w""")
def _(spark, d):
    return windows.random_windows(supply_census(spark, d), SS, per_drive=4)


@query("w18_random_windows_cohort", "drive:i i:i start:i label:i",
       f"""{SUPPLY_CENSUS}, {_DRAWS}, {_FORCED},
       neg AS (SELECT drive, list(s ORDER BY s) AS nl FROM (
                 SELECT c.drive, s FROM cal c, unnest(generate_series(0, c.n_days - 30)) AS t(s)
                 WHERE c.n_fail > 0 AND NOT EXISTS (SELECT 1 FROM fails f WHERE f.drive = c.drive
                       AND f.f BETWEEN s AND s + {SS.reach})) GROUP BY drive),
       chosen AS (
         SELECT b.drive, b.i, CASE
                  WHEN coin < 0.25 AND fl IS NOT NULL AND low <= high THEN low + near_draw % (high - low + 1)
                  WHEN fl IS NULL THEN uniform
                  WHEN nl IS NOT NULL THEN nl[CAST(start_draw % len(nl) AS INTEGER) + 1]
                  ELSE low + near_draw % (high - low + 1) END AS start
         FROM bounded b LEFT JOIN neg ON neg.drive = b.drive)
       SELECT w.*, {label_sql(SS, "w")} AS label FROM chosen w""")
def _(spark, d):
    return windows.random_windows(supply_census(spark, d), SS, per_drive=4, positive_ratio=0.25,
                                  otherwise="negative")


@query("w19_shuffled_tiles", "drive:i start:i block:i seq:i",
       f"""{SUPPLY_CENSUS}, {tiles_sql(SS)} SELECT drive, start, drive // 8 AS block,
       row_number() OVER (ORDER BY md5('42|1|' || (drive // 8)), drive // 8, drive, start) - 1 AS seq FROM tiles""")
def _(spark, d):
    return windows.shuffled_tiles(supply_census(spark, d), SS, epoch=1, block=8)


@query("w20_latest_windows", "drive:i start:i label:i",
       f"{SUPPLY_CENSUS}, wins AS (SELECT drive, n_days - 30 AS start FROM cal) "
       f"SELECT w.*, {label_sql(SS, 'w')} AS label FROM wins w")
def _(spark, d):
    return windows.latest_windows(supply_census(spark, d), SS)


@query("w21_trailing_windows", "drive:i start:i end_day:d",
       f"""{SUPPLY_CENSUS} SELECT drive, s AS start, first_day + CAST(s + 29 AS INTEGER) AS end_day
       FROM cal, unnest(generate_series(greatest(n_days - 30 - 44, 0), n_days - 30)) AS t(s)""")
def _(spark, d):
    return windows.trailing_windows(supply_census(spark, d), SS, 45)


_PAD = replace(ES, attrs=("n_click", "n_view"), days=20, min_days=10, lags=(1,), log_attrs=(), pad_short=True)


def _padded(agg: str, c: str) -> str:
    last = f"coalesce(max(CASE WHEN pos = n_days - 1 THEN {c} END), 0)"
    first = f"CASE WHEN max(n_days) < 20 THEN 0 ELSE coalesce(max(CASE WHEN pos = start THEN {c} END), 0) END"
    whole = f"count({c}) = count(*)"
    return {
        "last": last, "delta": f"{last} - {first}",
        "mean": f"CASE WHEN {whole} THEN sum({c}) / 20.0 ELSE 0 END",
        "min": f"CASE WHEN {whole} THEN least(min({c}), CASE WHEN max(n_days) < 20 THEN 0 END) ELSE 0 END",
        "max": f"CASE WHEN {whole} THEN greatest(max({c}), CASE WHEN max(n_days) < 20 THEN 0 END) ELSE 0 END",
    }[agg]


@query("w22_padded_latest", "drive:i start:i n_padded:i n_real:i n_click__last:r n_click__mean:r n_click__min:r "
       "n_click__max:r n_click__delta:r observed__mean:r",
       f"""WITH {EVENTS_SQL}, {dense_sql(_PAD)},
       latest AS (SELECT *, greatest(n_days - 20, 0) AS start FROM chan WHERE pos >= n_days - 20)
       SELECT drive, max(start) AS start, greatest(20 - max(n_days), 0) AS n_padded, sum(observed) AS n_real,
              {", ".join(f'{_padded(a, "n_click")} AS n_click__{a}' for a in ("last", "mean", "min", "max"))},
              {_padded("last", "n_click")} - min({"CASE WHEN n_days < 20 THEN 0 WHEN pos = start THEN n_click END"}) AS n_click__delta,
              sum(observed) / 20.0 AS observed__mean
       FROM latest GROUP BY drive""")
def _(spark, d):
    dense = cal.densify(events_days(spark, d), _PAD)
    return features.window_aggregates(dense, _PAD, "latest")


@query("w23_window_metadata", "drive:i start:i start_day:d end_day:d n_real:i n_filled:i n_padded:i label:i "
       "failure_offset:i",
       f"""WITH {SUPPLY_SQL}, {dense_sql(SS)}, wins AS ({_STRIDED.format(w=30, stride=15)}),
       met AS (SELECT w.drive, w.start, min(c.day) AS start_day, max(c.day) AS end_day, sum(c.observed) AS n_real
               FROM wins w JOIN chan c ON c.drive = w.drive AND c.pos BETWEEN w.start AND w.start + 29
               GROUP BY w.drive, w.start),
       lab AS (SELECT m.*, {label_sql(SS, "m")} AS label FROM met m)
       SELECT *, 30 - n_real AS n_filled, 0 AS n_padded,
              CASE WHEN label = 1 THEN (SELECT min(f.f) FROM fails f WHERE f.drive = lab.drive AND f.f >= lab.start) - start ELSE -1 END
                AS failure_offset FROM lab""")
def _(spark, d):
    days = supply_days(spark, d)
    wins = windows.enumerate_windows(cal.census(days, single_pass=True), SS).select(
        "drive", "start", "label", "n_days", "first_day", "fail_pos")
    return windows.window_metadata(wins, cal.densify(days, SS, diffs=False), SS)


@query("w24_window_tensor", "drive:i start:i label:i n_rows:i total:r",
       f"""WITH {SUPPLY_SQL}, {dense_sql(SS)}, {tiles_sql(SS)}
       SELECT t.drive, t.start, max({label_sql(SS, "t")}) AS label, count(*) AS n_rows,
              sum(CAST(c.q AS DOUBLE) + c.n + c.observed) AS total
       FROM tiles t JOIN chan c ON c.drive = t.drive AND c.pos BETWEEN t.start AND t.start + 29
       GROUP BY t.drive, t.start""")
def _(spark, d):
    dense = cal.densify(supply_days(spark, d), SS, diffs=False)
    x = features.window_tensor(dense, SS, "tile", channels=("q", "n", "observed"))
    return x.select("drive", "start", "label", F.size("x").alias("n_rows"),
                    F.aggregate(F.flatten("x"), F.lit(0.0), lambda acc, v: acc + v).alias("total"))


_FEATS = " ".join(f"{c}__{a}:r" for a in ("last", "mean", "min", "max", "delta") for c in SS.channels)


@query("w25_tile_features", f"drive:i start:i n_real:i label:i {_FEATS}",
       f"""WITH {SUPPLY_SQL}, {dense_sql(SS)}, {tiles_sql(SS)}, {aggregate_sql(SS, SS.channels)}
       SELECT t.*, {label_sql(SS, "t")} AS label FROM feat t""")
def _(spark, d):
    return features.window_aggregates(cal.densify(supply_days(spark, d), SS), SS, "tile")


_EFEATS = " ".join(f"{c}__{a}:r" for a in ("last", "mean", "min", "max", "delta") for c in ES.channels)


@query("w25_strided_features", f"drive:i start:i n_real:i label:i {_EFEATS}",
       f"""WITH {EVENTS_SQL}, {dense_sql(ES)}, wins AS ({_STRIDED.format(w=7, stride=2)}),
       {aggregate_sql(ES, ES.channels, "wins")} SELECT t.*, {label_sql(ES, "t")} AS label FROM feat t""")
def _(spark, d):
    return features.window_aggregates(cal.densify(events_days(spark, d), ES), ES, "stride")


@query("w25_latest_features", f"drive:i start:i n_real:i label:i {_EFEATS}",
       f"""WITH {EVENTS_SQL}, {dense_sql(ES)}, wins AS (SELECT drive, n_days, n_days - 7 AS start FROM cal),
       {aggregate_sql(ES, ES.channels, "wins")} SELECT t.*, {label_sql(ES, "t")} AS label FROM feat t""")
def _(spark, d):
    return features.window_aggregates(cal.densify(events_days(spark, d), ES), ES, "latest")


@query("w26_label_conflicts", "conflict_groups:i rows_in_conflict:i unreachable_rows:i max_train_accuracy:r",
       f"""WITH {SUPPLY_SQL}, {dense_sql(SS)}, {tiles_sql(SS)}, {aggregate_sql(SS, ("q", "n", "observed"))},
       lab AS (SELECT t.*, {label_sql(SS, "t")} AS label FROM feat t),
       g AS (SELECT q__max, n__max, count(*) AS n, sum(label) AS pos FROM lab GROUP BY q__max, n__max)
       SELECT count(*) FILTER (WHERE pos > 0 AND pos < n) AS conflict_groups,
              coalesce(sum(n) FILTER (WHERE pos > 0 AND pos < n), 0) AS rows_in_conflict,
              coalesce(sum(least(pos, n - pos)), 0) AS unreachable_rows,
              1.0 - CAST(sum(least(pos, n - pos)) AS DOUBLE) / sum(n) AS max_train_accuracy FROM g""")
def _(spark, d):
    dense = cal.densify(supply_days(spark, d), SS, diffs=False)
    feats = features.window_aggregates(dense, SS, "tile", channels=("q", "n"), aggregates=("max",))
    return features.label_conflicts(feats, ["q__max", "n__max"])

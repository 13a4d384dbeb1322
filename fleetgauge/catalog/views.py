"""Drive-day views over the supplied tables, in Spark and in SQL.

`events_days` (short records, 7-day windows): a user is a drive, a day with an error of 200 or more
is its terminal failure. `supply_days` (long records, 30-day windows): a supplier is a drive, the
first day that ships 125 units or more is its failure. Both aggregate per (drive, day) first, with
map-side partial sums, so a drive that owns a third of the raw rows costs no more than its days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.calendar import PART_ROWS, densify, in_parts
from ..operators.features import window_aggregates
from ..settings import WindowSpec

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENT_ATTRS = tuple(f"n_{t}" for t in EVENT_TYPES) + tuple(f"m_{t}" for t in EVENT_TYPES)
SUPPLY_ATTRS = ("q", "p", "disc", "n")

EVENT_SPEC = WindowSpec(attrs=("n_click", "m_error", "m_view"), days=7, horizon=3, stride=2, min_days=7,
                        lags=(1, 3), log_attrs=("m_error", "m_view"))
SUPPLY_SPEC = WindowSpec(attrs=("q", "n"), days=30, horizon=30, stride=15, min_days=30, lags=(1, 7))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_by_drive(days: DataFrame, raw: DataFrame) -> DataFrame:
    """`days` by drive, in parts whose number grows with the table they come from."""
    return in_parts(days, raw.count(), PART_ROWS)


def until_terminal(days: DataFrame) -> DataFrame:
    """Cut each record after its first `hit` day and mark that day as the failure.

    A running frame in day order, so the sort is the one the calendar needs anyway.
    """
    before = Window.partitionBy("drive").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return (days.withColumn("_over", F.coalesce(F.max("hit").over(before), F.lit(False))).where(~F.col("_over"))
            .withColumn("failure", F.col("hit").cast("int")).drop("_over", "hit"))


def events_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    is_type = {t: F.col("event_type") == t for t in EVENT_TYPES}
    days = ev.groupBy(F.col("user_id").alias("drive"), F.to_date("ts").alias("day")).agg(
        *[F.count(F.when(is_type[t], 1)).alias(f"n_{t}") for t in EVENT_TYPES],
        *[F.max(F.when(is_type[t], F.col("value"))).alias(f"m_{t}") for t in EVENT_TYPES],
        F.max(is_type["error"] & (F.col("value") >= 200)).alias("hit"))
    out = until_terminal(dealt_by_drive(days.withColumn("hit", F.coalesce("hit", F.lit(False))), ev))
    return out.withColumn("model", F.concat(F.lit("M"), F.col("drive") % 4))


def supply_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    days = li.groupBy(F.col("l_suppkey").alias("drive"), F.to_date("l_shipdate").alias("day")).agg(
        F.sum("l_quantity").alias("q"),
        F.round(F.sum("l_extendedprice"), 2).alias("p"),
        F.round(F.avg("l_discount"), 6).alias("disc"),
        F.count(F.lit(1)).alias("n"))
    out = until_terminal(dealt_by_drive(days.withColumn("hit", F.col("q") >= 125), li))
    return out.withColumn("model", F.concat(F.lit("M"), F.col("drive") % 4))


EVENTS_SQL = f"""
ev AS (SELECT user_id AS drive, CAST(ts AS DATE) AS day, event_type, value FROM events),
ev_end AS (SELECT drive, min(day) AS end_day FROM ev WHERE event_type = 'error' AND value >= 200 GROUP BY drive),
dd AS (
  SELECT e.drive, e.day, 'M' || (e.drive % 4) AS model,
         CASE WHEN e.day = max(t.end_day) THEN 1 ELSE 0 END AS failure,
         {", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in EVENT_TYPES)},
         {", ".join(f"max(value) FILTER (WHERE event_type = '{t}') AS m_{t}" for t in EVENT_TYPES)}
  FROM ev e LEFT JOIN ev_end t ON t.drive = e.drive
  WHERE t.end_day IS NULL OR e.day <= t.end_day
  GROUP BY e.drive, e.day)"""

SUPPLY_SQL = """
raw_days AS (
  SELECT l_suppkey AS drive, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS q,
         round(sum(l_extendedprice), 2) AS p, round(avg(l_discount), 6) AS disc, count(*) AS n
  FROM lineitem GROUP BY 1, 2),
ends AS (SELECT drive, min(day) AS end_day FROM raw_days WHERE q >= 125 GROUP BY drive),
dd AS (
  SELECT r.drive, r.day, 'M' || (r.drive % 4) AS model,
         CASE WHEN r.day = e.end_day THEN 1 ELSE 0 END AS failure, q, p, disc, n
  FROM raw_days r LEFT JOIN ends e ON e.drive = r.drive
  WHERE e.end_day IS NULL OR r.day <= e.end_day)"""


def census_sql(min_days: int = 1) -> str:
    """cal (drive, first_day, last_day, n_days, n_obs, n_fail, has_failure) and fails (drive, f)."""
    return f"""
cal AS (
  SELECT drive, min(day) AS first_day, max(day) AS last_day, datediff('day', min(day), max(day)) + 1 AS n_days,
         count(*) AS n_obs, sum(failure) AS n_fail, max(failure) AS has_failure, min(model) AS model
  FROM dd GROUP BY drive HAVING datediff('day', min(day), max(day)) + 1 >= {min_days}),
fails AS (
  SELECT dd.drive, datediff('day', cal.first_day, dd.day) AS f
  FROM dd JOIN cal ON cal.drive = dd.drive WHERE dd.failure = 1)"""


def dense_sql(spec: WindowSpec) -> str:
    """chan: one row per drive and calendar day with filled levels, differences and observed."""
    levels = {a: (f"CASE WHEN r.{a} IS NULL THEN NULL ELSE ln(1 + greatest(r.{a}, 0)) END" if a in spec.log_attrs
                  else f"CAST(r.{a} AS DOUBLE)") for a in spec.attrs}
    return f"""
{census_sql(spec.shortest_record)},
grid AS (SELECT drive, model, first_day, n_days, unnest(generate_series(0, n_days - 1)) AS pos FROM cal),
laid AS (
  SELECT g.drive, g.model, g.pos, g.n_days, g.first_day + CAST(g.pos AS INTEGER) AS day,
         CASE WHEN r.drive IS NULL THEN 0 ELSE 1 END AS observed, coalesce(r.failure, 0) AS failure,
         {", ".join(f"{e} AS {a}" for a, e in levels.items())}
  FROM grid g LEFT JOIN dd r ON r.drive = g.drive AND r.day = g.first_day + CAST(g.pos AS INTEGER)),
filled AS (
  SELECT drive, model, pos, n_days, day, observed, failure,
         {", ".join(f"last_value({a} IGNORE NULLS) OVER w AS {a}" for a in spec.attrs)}
  FROM laid WINDOW w AS (PARTITION BY drive ORDER BY pos ROWS UNBOUNDED PRECEDING)),
chan AS (
  SELECT *, {", ".join(f"{a} - lag({a}, {k}) OVER (PARTITION BY drive ORDER BY pos) AS {a}_d{k}"
                       for k in spec.lags for a in spec.attrs)}
  FROM filled)"""


def tiles_sql(spec: WindowSpec) -> str:
    return f"""
tiles AS (
  SELECT drive, n_days, first_day, k, least(k * {spec.days}, n_days - {spec.days}) AS start
  FROM cal, unnest(generate_series(0, CAST(ceil(n_days / {spec.days}.0) AS BIGINT) - 1)) AS t(k))"""


def label_sql(spec: WindowSpec, alias: str) -> str:
    return (f"CASE WHEN EXISTS (SELECT 1 FROM fails f WHERE f.drive = {alias}.drive AND f.f BETWEEN {alias}.start "
            f"AND {alias}.start + {spec.reach}) THEN 1 ELSE 0 END")


def aggregate_sql(spec: WindowSpec, channels, windows: str = "tiles", out: str = "feat",
                  aggregates=("last", "mean", "min", "max", "delta")) -> str:
    """feat: window aggregates of `channels`; anything incomplete or not finite is 0."""
    w = spec.days

    def one(c: str, a: str) -> str:
        first = f"max(CASE WHEN d.pos = t.start THEN d.{c} END)"
        last = f"max(CASE WHEN d.pos = t.start + {w - 1} THEN d.{c} END)"
        e = {"last": last, "delta": f"{last} - {first}",
             "mean": f"CASE WHEN count(d.{c}) = {w} THEN avg(CAST(d.{c} AS DOUBLE)) END",
             "min": f"CASE WHEN count(d.{c}) = {w} THEN min(d.{c}) END",
             "max": f"CASE WHEN count(d.{c}) = {w} THEN max(d.{c}) END"}[a]
        return f'coalesce({e}, 0) AS "{c}__{a}"'

    feats = ", ".join(one(c, a) for a in aggregates for c in channels)
    return f"""
{out} AS (
  SELECT t.drive, t.start, t.n_days, min(d.model) AS model, sum(d.observed) AS n_real,
         min(d.day) AS start_day, max(d.day) AS end_day, {feats}
  FROM {windows} t JOIN chan d ON d.drive = t.drive AND d.pos BETWEEN t.start AND t.start + {w - 1}
  GROUP BY t.drive, t.start, t.n_days)"""


# ---- scored windows: the input of every evaluation query -----------------------------------------
# The scores are fixed arithmetic of window features, kept to 6 digits so that ties are exact and the
# number of distinct scores is bounded. `score` stands for the first model, `score_b` for the second.

def supply_dense(spark: SparkSession, sf_dir: str, diffs: bool = False) -> DataFrame:
    return densify(supply_days(spark, sf_dir), SUPPLY_SPEC, carry=("model",), diffs=diffs)


def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drive, start, model, start_day, end_day, label, score, score_b over all tiling windows."""
    feats = window_aggregates(supply_dense(spark, sf_dir), SUPPLY_SPEC, "tile", channels=("q", "n"),
                              carry=("model",))
    a = F.least(F.lit(1.0), F.col("q__max") / 160.0 * 0.7 + F.col("n_real") / 30.0 * 0.3)
    b = 1.0 / (1.0 + F.exp(-(F.col("n__mean") * 1.5 + F.col("q__delta") / 50.0 - 2.5)))
    return feats.select("drive", "start", "model", "start_day", "end_day", "n_days", "n_real", "label",
                        F.round(a, 6).alias("score"), F.round(b, 6).alias("score_b"))


SCORED_SQL = f"""
{SUPPLY_SQL},
{dense_sql(WindowSpec(**{**SUPPLY_SPEC.__dict__, "lags": (1,)}))},
{tiles_sql(SUPPLY_SPEC)},
{aggregate_sql(SUPPLY_SPEC, ("q", "n"))},
scored AS (
  SELECT drive, start, model, start_day, end_day, n_days, n_real, {label_sql(SUPPLY_SPEC, "t")} AS label,
         round(least(1.0, q__max / 160.0 * 0.7 + n_real / 30.0 * 0.3), 6) AS score,
         round(1.0 / (1.0 + exp(-(n__mean * 1.5 + q__delta / 50.0 - 2.5))), 6) AS score_b
  FROM feat t)"""

DRIVE_SCORES_SQL = """
drive_scores AS (SELECT drive, min(model) AS model, max(score) AS score, max(score_b) AS score_b, max(label) AS label
                 FROM scored GROUP BY drive)"""

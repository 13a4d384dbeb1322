"""Positional (n-th reading) features: one row per reading, history looked up by position.

Readings must be unique per (drive, day); run `dedupe_days` first where they may not be. Every
window frame here is either a lag or a running prefix, so a row costs O(1) whatever the window
length. All of them share one exchange on `drive`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio
from .calendar import SO_FAR, by_drive


def with_lagged_deltas(readings: DataFrame, attrs: Sequence[str], lags: Sequence[int], suffix: str = "_d{lag}") -> DataFrame:
    """Change since the reading `lag` rows earlier; NULL without that much history."""
    return readings.select("*", *[(F.col(a) - F.lag(a, k).over(by_drive("day"))).alias(a + suffix.format(lag=k))
                                  for k in lags for a in attrs])


def with_rolling_stats(readings: DataFrame, attrs: Sequence[str], width: int) -> DataFrame:
    """Mean, sample standard deviation and max of each attribute over the last `width` readings.

    A sliding frame would redo `width` updates per row. Instead the positions are cut into blocks of
    `width`: any window is a suffix of one block plus a prefix of the next, and both are running
    aggregates. Counts, means and squared deviations of the two parts merge without cancellation.
    """
    block = Window.partitionBy("drive", "_block")
    ahead = block.orderBy("_pos").rowsBetween(*SO_FAR)
    behind = block.orderBy(F.col("_pos").desc()).rowsBetween(*SO_FAR)
    rows = readings.withColumn("_pos", F.row_number().over(by_drive("day")) - 1)
    rows = rows.withColumn("_block", F.floor(F.col("_pos") / width))

    def parts(w, tag: str) -> list[Column]:
        out = []
        for a in attrs:
            v = F.col(a).cast("double")
            out += [F.count(v).over(w).alias(f"_{tag}n_{a}"), F.avg(v).over(w).alias(f"_{tag}m_{a}"),
                    F.var_pop(v).over(w).alias(f"_{tag}v_{a}"), F.max(v).over(w).alias(f"_{tag}x_{a}")]
        return out

    both = rows.select("*", *parts(ahead, "p"), *parts(behind, "s"))
    tails = [f"_s{k}_{a}" for a in attrs for k in "nmvx"]
    both = both.select("*", *[F.lag(c, width - 1).over(by_drive("_pos")).alias(f"l{c}") for c in tails])
    # A window that starts on a block boundary is the prefix alone.
    split = ((F.col("_pos") + 1) % width != 0) & (F.col("_pos") >= width)

    def merged(a: str) -> list[Column]:
        n1 = F.when(split, F.coalesce(F.col(f"l_sn_{a}"), F.lit(0))).otherwise(F.lit(0)).cast("double")
        n2 = F.col(f"_pn_{a}").cast("double")
        m1, m2 = F.coalesce(F.col(f"l_sm_{a}"), F.lit(0.0)), F.coalesce(F.col(f"_pm_{a}"), F.lit(0.0))
        v1, v2 = F.coalesce(F.col(f"l_sv_{a}"), F.lit(0.0)), F.coalesce(F.col(f"_pv_{a}"), F.lit(0.0))
        n = n1 + n2
        mean = F.when(n > 0, (n1 * m1 + n2 * m2) / F.when(n > 0, n))
        spread = n1 * v1 + n2 * v2 + F.pow(m1 - m2, 2) * n1 * n2 / F.when(n > 0, n)
        std = F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / F.when(n > 1, n - 1)))
        peak = F.when(split, F.greatest(F.col(f"l_sx_{a}"), F.col(f"_px_{a}"))).otherwise(F.col(f"_px_{a}"))
        return [mean.alias(f"{a}_mean{width}"), std.alias(f"{a}_std{width}"), peak.alias(f"{a}_max{width}")]

    return both.select(*readings.columns, *[c for a in attrs for c in merged(a)])


def with_context(readings: DataFrame, width: int, capacity: str | None = None) -> DataFrame:
    """Readings so far, calendar days the last `width` readings span, age in days, capacity in TB."""
    extra = [(F.col(capacity) / 1e12).alias("capacity_tb")] if capacity else []
    return readings.select(
        "*", F.row_number().over(by_drive("day")).alias("readings_so_far"),
        F.datediff("day", F.lag("day", width).over(by_drive("day"))).alias("window_span_days"),
        F.datediff("day", F.min("day").over(by_drive("day").rowsBetween(*SO_FAR))).alias("drive_age_days"), *extra)


def one_hot(readings: DataFrame, column: str = "model", categories: Sequence[str] | None = None) -> DataFrame:
    """A 0/1 column per category. Without a given list the distinct values (device families) are read first."""
    if categories is None:
        categories = sorted(r[0] for r in readings.select(column).distinct().collect() if r[0] is not None)
    return readings.select("*", *[F.coalesce((F.col(column) == c).cast("double"), F.lit(0.0)).alias(f"{column}_{c}")
                                  for c in categories])


def full_window(width: int, tolerance: int = 5) -> Column:
    """True where a row has width + 1 readings behind it within width + tolerance calendar days."""
    return F.coalesce((F.col("readings_so_far") >= width + 1) & (F.col("window_span_days") <= width + tolerance), F.lit(False))


def full_window_report(features: DataFrame, width: int, tolerance: int = 5) -> DataFrame:
    """One row: rows kept and dropped by reason, and drives left."""
    keep, short = full_window(width, tolerance), F.col("readings_so_far") < width + 1
    per = features.groupBy("drive").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(keep, 1)).alias("k"), F.count(F.when(short, 1)).alias("s"))
    return per.agg(F.sum("n").alias("rows"), F.sum("s").alias("too_few_readings"),
                   F.sum(F.col("n") - F.col("k") - F.col("s")).alias("too_wide"), F.sum("k").alias("kept"),
                   F.count(F.when(F.col("k") > 0, 1)).alias("drives_kept"), F.count(F.lit(1)).alias("drives"))


def with_target(readings: DataFrame, horizon: int) -> DataFrame:
    """days_to_failure (against the drive's last failure day) and target = 1 inside [0, horizon]."""
    fail = F.max(F.when(F.col("failure") == 1, F.col("day"))).over(by_drive())
    left = F.datediff(fail, "day")
    return readings.select("*", left.alias("days_to_failure"),
                           F.coalesce(left.between(0, horizon), F.lit(False)).cast("int").alias("target"))


def remaining_life_rows(labelled: DataFrame, horizon: int = 60) -> DataFrame:
    """Rows of failed drives within `horizon` days of the failure."""
    return labelled.where(F.col("days_to_failure").between(0, horizon))


def with_prior_reading(readings: DataFrame, attrs: Sequence[str], days_ago: int = 7, slack: int = 1) -> DataFrame:
    """As-of delta: against the reading nearest to `days_ago` days earlier, at most `slack` days off.

    The range frame holds at most 2 * slack + 1 readings, so no join is needed. The earlier reading
    wins a tie. Adds prior_day and `<attr>_delta<days_ago>`.
    """
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    near = Window.partitionBy("drive").orderBy("_n").rangeBetween(-days_ago - slack, -days_ago + slack)
    rows = readings.withColumn("_n", number)
    found = rows.withColumn("_near", F.collect_list(F.struct("_n", "day", *attrs)).over(near))
    target = F.col("_n") - days_ago
    fields = ["day", *attrs]
    best = F.array_min(F.transform("_near", lambda r: F.struct(
        F.abs(r["_n"] - target).alias("gap"), r["_n"].alias("at"),
        F.struct(*[r[f].alias(f) for f in fields]).alias("r"))))
    return found.withColumn("_best", best).select(
        *readings.columns, F.col("_best.r.day").alias("prior_day"),
        *[(F.col(a) - F.col(f"_best.r.{a}")).alias(f"{a}_delta{days_ago}") for a in attrs])


def row_features(readings: DataFrame, attrs: Sequence[str], lags: Sequence[int] = (7, 30, 90), width: int = 90,
                 capacity: str | None = None) -> DataFrame:
    """Levels, positional deltas, rolling statistics and context for every reading."""
    return with_context(with_rolling_stats(with_lagged_deltas(readings, attrs, lags), attrs, width), width, capacity)


def latest_row_features(readings: DataFrame, attrs: Sequence[str], lags: Sequence[int] = (7, 30, 90), width: int = 90,
                        capacity: str | None = None) -> DataFrame:
    """The same features for each drive's newest reading, from its last width + 1 readings only."""
    recent = readings.withColumn("_back", F.row_number().over(by_drive(F.col("day").desc()))).where(
        F.col("_back") <= width + 1)
    return row_features(recent, attrs, lags, width, capacity).where("_back = 1").drop("_back")


def risk_band(p: Column, threshold: float) -> Column:
    """CRITICAL / HIGH / MEDIUM above the threshold, LOW below it."""
    return F.when(p < threshold, "LOW").when(p >= 0.90, "CRITICAL").when(p >= 0.70, "HIGH").when(
        p >= threshold, "MEDIUM").otherwise("LOW")


def risk_action(band: Column) -> Column:
    return (F.when(band == "CRITICAL", "inspect or replace now").when(band == "HIGH", "schedule inspection soon")
            .when(band == "MEDIUM", "monitor closely").otherwise("none"))


def window_change(readings: DataFrame, attrs: Sequence[str], width: int) -> DataFrame:
    """(drive, attribute, first, last, delta) over the last width + 1 readings, where both ends are present."""
    back = F.row_number().over(by_drive(F.col("day").desc()))
    recent = readings.withColumn("_back", back).where(F.col("_back") <= width + 1)
    ends = recent.groupBy("drive").agg(*[F.min_by(F.col(a).cast("double"), "day").alias(f"f_{a}") for a in attrs],
                                       *[F.max_by(F.col(a).cast("double"), "day").alias(f"l_{a}") for a in attrs])
    cells = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"f_{a}").alias("first"), F.col(f"l_{a}").alias("last"))
                      for a in attrs])
    return (ends.select("drive", F.explode(cells).alias("c")).select("drive", "c.*")
            .where(F.col("first").isNotNull() & F.col("last").isNotNull())
            .withColumn("delta", F.col("last") - F.col("first")))


def moved_attributes(readings: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Per drive: which attributes took more than one value."""
    return readings.groupBy("drive").agg(
        *[F.coalesce((F.max(a) != F.min(a)).cast("int"), F.lit(0)).alias(a) for a in attrs])


def window_stat_of(name: Column, width: int, lags: Sequence[int]) -> Column:
    """Which window statistic a feature name stands for."""
    out = F.when(name.startswith("model_"), "drive model").when(
        name.isin("window_span_days", "drive_age_days", "capacity_tb"), "window context")
    for lag in lags:
        out = out.when(name.endswith(f"_d{lag}"), f"delta {lag}d")
    for stat in ("mean", "std", "max"):
        out = out.when(name.endswith(f"_{stat}{width}"), f"{stat} over {width}d")
    return out.otherwise("current reading")


def importance_by_stat(importance: DataFrame, width: int, lags: Sequence[int]) -> DataFrame:
    """(stat, gain, share) from a (feature, gain) table, one row per feature."""
    per = importance.groupBy(window_stat_of(F.col("feature"), width, lags).alias("stat")).agg(F.sum("gain").alias("gain"))
    total = per.agg(F.sum("gain").alias("_t"))
    return per.crossJoin(F.broadcast(total)).select("stat", "gain", (100 * ratio(F.col("gain"), F.col("_t"))).alias("share_pct"))

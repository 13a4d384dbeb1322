"""Where sampled windows fall on the calendar, and how much of the timeline each split covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bin_index, ratio
from ..functions.order import hash_rank
from ..settings import SEED, WindowSpec
from .windows import positive_starts, random_windows, window_metadata, with_max_start


def window_timeline(drives: DataFrame, dense: DataFrame, spec: WindowSpec, per_drive: int = 2,
                    max_drives: int | None = None, seed: int = SEED) -> DataFrame:
    """Replayable random windows per drive with their dates, real days, and place in the drive's life.

    `drives` is a census with a `split` column; `max_drives` samples whole drives per split.
    """
    if max_drives is not None:
        drives = (hash_rank(drives, [F.col("drive")], seed, by=["split"], out="_rank")
                  .where(F.col("_rank") <= max_drives).drop("_rank"))
    drawn = random_windows(drives, spec, per_drive=per_drive, seed=seed)
    about = drives.select("drive", "split", "fail_pos")
    met = window_metadata(drawn.join(about, "drive"), dense, spec)
    fraction = F.when(F.col("max_start") > 0, F.col("start") / F.col("max_start")).otherwise(F.lit(0.0))
    return met.select("split", "drive", "i", "start_day", "end_day", "start", fraction.alias("life_fraction"),
                      "n_days", (F.col("n_days") - F.col("start") - spec.days).alias("days_to_record_end"),
                      "n_real", "n_filled", "n_padded", "label")


def timeline_checks(timeline: DataFrame) -> DataFrame:
    """One row: are starts snapped to quarters or months, against what uniform starts would give."""
    # Reduced to one row per start day, so at most one row per calendar day goes on.
    per_day = timeline.groupBy("start_day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"), F.sum("n_real").alias("real"))
    on_quarter = F.trunc("start_day", "quarter") == F.col("start_day")
    on_month = F.trunc("start_day", "month") == F.col("start_day")
    got = per_day.agg(
        F.sum("n").alias("windows"), F.sum("pos").alias("positives"),
        F.min("start_day").alias("first_start"), F.max("start_day").alias("last_start"),
        F.count(F.lit(1)).alias("distinct_start_days"),
        F.sum(F.when(on_quarter, F.col("n")).otherwise(0)).alias("on_quarter"),
        F.sum(F.when(on_month, F.col("n")).otherwise(0)).alias("on_month"),
        F.sum("real").alias("_real"))
    days = F.sequence("first_start", "last_start")
    n_days = F.size(days)
    return got.select(
        "windows", "positives", "first_start", "last_start", "distinct_start_days",
        n_days.alias("calendar_days"),
        (100 * F.col("on_quarter") / F.col("windows")).alias("quarter_pct"),
        (100 * F.size(F.filter(days, lambda x: F.trunc(x, "quarter") == x)) / n_days).alias("quarter_uniform_pct"),
        (100 * F.col("on_month") / F.col("windows")).alias("month_pct"),
        (100 * F.size(F.filter(days, lambda x: F.trunc(x, "month") == x)) / n_days).alias("month_uniform_pct"),
        (F.col("_real") / F.col("windows")).alias("mean_real_days"))


def weekday_spread(timeline: DataFrame) -> DataFrame:
    """Share of window starts per weekday (1 = Sunday)."""
    per = timeline.groupBy(F.dayofweek("start_day").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("_t"))
    return per.crossJoin(F.broadcast(total)).select("weekday", "n", (F.col("n") / F.col("_t")).alias("share"))


def live_windows(windows: DataFrame) -> DataFrame:
    """How many windows are open on every day from the first start to the last end (sweep line)."""
    steps = windows.select(F.explode(F.array(
        F.struct(F.col("start_day").alias("day"), F.lit(1).alias("step")),
        F.struct(F.date_add("end_day", 1).alias("day"), F.lit(-1).alias("step")))).alias("s"))
    # At most one row per calendar day reaches the single ordered window.
    per_day = steps.groupBy("s.day").agg(F.sum("s.step").alias("step"))
    order = Window.orderBy("day")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = per_day.select(F.sum("step").over(so_far).alias("live"), "day", F.lead("day").over(order).alias("next"))
    return runs.where(F.col("next").isNotNull()).select(
        F.explode(F.sequence("day", F.date_sub("next", 1))).alias("day"), "live")


def split_coverage(drives: DataFrame, spec: WindowSpec) -> DataFrame:
    """Per split: drives, failing drives, dense days, tiling windows, every possible window."""
    d = with_max_start(drives, spec)
    return d.groupBy("split").agg(
        F.count(F.lit(1)).alias("drives"), F.sum("has_failure").alias("failing"),
        F.sum("n_days").alias("days"),
        F.sum(F.ceil(F.col("n_days") / spec.days)).alias("tiling_windows"),
        F.sum(F.col("n_days") - spec.days + 1).alias("all_windows"))


def positive_rate(drives: DataFrame, spec: WindowSpec, positive_ratio: float | None = None,
                  per_drive: int = 4, seed: int = SEED) -> DataFrame:
    """One row: share of positives over every window, expected of a random draw, and measured on one epoch."""
    d = with_max_start(drives, spec).withColumn("_all", F.col("max_start") + 1)
    hit = positive_starts(drives, spec).groupBy("drive").agg(F.count(F.lit(1)).alias("_pos"))
    rows = d.join(hit, "drive", "left").fillna(0, ["_pos"])
    p = F.col("_pos") / F.col("_all")
    if positive_ratio is not None:
        p = F.when(F.col("_pos") == 0, 0.0).when(F.col("_pos") < F.col("_all"), positive_ratio).otherwise(1.0)
    exact = rows.agg((F.sum("_pos") / F.sum("_all")).alias("enumerated_rate"), F.avg(p).alias("expected_rate"))
    drawn = random_windows(drives, spec, per_drive=per_drive, positive_ratio=positive_ratio, seed=seed).agg(
        F.avg(F.col("label").cast("double")).alias("measured_rate"))
    return exact.crossJoin(F.broadcast(drawn)).withColumn(        # one row each
        "pos_weight", ratio(1 - F.col("measured_rate"), F.col("measured_rate")))


def timeline_histograms(timeline: DataFrame, bins: int = 20) -> DataFrame:
    """(measure, bin, n): life fraction, real days, record length up to the longest, start month."""
    longest = timeline.agg(F.max("n_days").alias("_longest"))                  # one row
    binned = timeline.crossJoin(F.broadcast(longest)).select(
        bin_index(F.col("life_fraction"), 0, 1, bins).cast("string").alias("life_fraction"),
        F.col("n_real").cast("string").alias("n_real"),
        bin_index(F.col("n_days") / F.col("_longest"), 0, 1, bins).cast("string").alias("record_days"),
        F.date_format("start_day", "yyyy-MM").alias("start_month"),
        F.date_format("end_day", "yyyy-MM").alias("end_month"))
    return (binned.unpivot([], binned.columns, "measure", "bin").groupBy("measure", "bin")
            .agg(F.count(F.lit(1)).alias("n")))

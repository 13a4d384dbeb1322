"""Fleet profiling: who reports what, how often, and how classes differ.

Every distinct count goes through a two-level aggregate, so a model or an attribute value that holds
a third of the rows is collapsed on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bin_index, log_level, ratio
from ..functions.moments import correlation, pair_moments
from ..functions.order import long_form
from .calendar import by_drive


def fleet_summary(readings: DataFrame) -> DataFrame:
    """Per model: rows, drives, failure events, first and last day, failed drives and their share."""
    per = readings.groupBy("model", "drive").agg(
        F.count(F.lit(1)).alias("n"), F.sum("failure").alias("f"), F.min("day").alias("a"), F.max("day").alias("b"))
    got = per.groupBy("model").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("drives"), F.sum("f").alias("failure_events"),
        F.min("a").alias("first_seen"), F.max("b").alias("last_seen"),
        F.sum((F.col("f") > 0).cast("bigint")).alias("failed_drives"))
    return got.withColumn("failed_drive_pct", F.round(100 * F.col("failed_drives") / F.col("drives"), 1))


def attribute_coverage(readings: DataFrame, attrs: Sequence[str], rsd: float | None = None) -> DataFrame:
    """Per attribute: coverage %, distinct values, usable (>= 50 % and not constant), constant.

    Distinct values are exact, which shuffles one row per value; with `rsd` they are sketched to that relative error instead.
    """
    if rsd is not None:
        facts = [f(a).alias(f"{tag}_{a}") for a in attrs for tag, f in
                 (("n", F.count), ("d", lambda a: F.approx_count_distinct(a, rsd)))]
        wide = readings.agg(F.count(F.lit(1)).alias("rows"), *facts)                                        # one row
        each = F.array(*[F.struct(F.lit(a).alias("attribute"), F.round(100 * ratio(F.col(f"n_{a}"), F.col("rows")), 1).alias("coverage_pct"),
                                  F.col(f"d_{a}").alias("distinct_values")) for a in attrs])
        return _usable(wide.select(F.inline(each)))
    counts = long_form(readings, attrs).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    got = counts.groupBy(F.col("column").alias("attribute")).agg(
        F.round(100 * F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)) / F.sum("n"), 1)
        .alias("coverage_pct"), F.count("value").alias("distinct_values"))
    return _usable(got)


def _usable(got: DataFrame) -> DataFrame:
    covered = F.col("coverage_pct") >= 50
    return (got.withColumn("usable", (covered & (F.col("distinct_values") > 1)).cast("int"))
            .withColumn("constant", (covered & (F.col("distinct_values") <= 1)).cast("int")))


def family_coverage(readings: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Share of non-null readings per model and attribute."""
    return readings.groupBy("model").agg(*[F.avg(F.col(a).isNotNull().cast("double")).alias(a) for a in attrs])


def missingness(parts: Sequence[DataFrame], attrs: Sequence[str]) -> DataFrame:
    """Missing % per attribute over all parts; a part without the column counts as missing."""
    whole = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    got = whole.agg(*[(100 * F.avg(F.col(a).isNull().cast("double"))).alias(a) for a in attrs])
    return got.unpivot([], list(attrs), "attribute", "missing_pct")


def _day_counts(readings: DataFrame) -> DataFrame:
    """(drive, day, n, gap): gap to the drive's previous reported day. At most one row per calendar day."""
    per = readings.groupBy("drive", "day").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("gap", F.datediff("day", F.lag("day").over(by_drive("day"))))


def gap_distribution(readings: DataFrame) -> DataFrame:
    """(gap_days, n) between consecutive readings; repeats on one day are gaps of 0."""
    d = _day_counts(readings)
    gaps = F.array(F.struct(F.lit(0).alias("gap_days"), (F.col("n") - 1).alias("n")),
                   F.struct(F.col("gap").alias("gap_days"), F.lit(1).cast("bigint").alias("n")))
    return (d.select(F.explode(gaps).alias("g")).where("g.gap_days IS NOT NULL AND g.n > 0")
            .groupBy("g.gap_days").agg(F.sum("g.n").alias("n")))


def cadence_summary(readings: DataFrame, window_days: int) -> DataFrame:
    """One row: share of one-day gaps, repeats, readings-per-drive quantiles, drives with window_days + 1 readings."""
    per = _day_counts(readings).groupBy("drive").agg(
        F.sum("n").alias("readings"), F.sum(F.col("n") - 1).alias("repeats"),
        F.count(F.when(F.col("gap") == 1, 1)).alias("daily"))
    # `percentile` keeps distinct readings-per-drive counts, which the calendar bounds.
    return per.agg(
        ratio(F.sum("daily"), F.sum(F.col("readings") - 1)).alias("daily_share"), F.sum("repeats").alias("duplicates"),
        F.percentile("readings", 0.5).alias("median_readings"), F.percentile("readings", 0.1).alias("p10_readings"),
        F.percentile("readings", 0.9).alias("p90_readings"),
        F.count(F.when(F.col("readings") >= window_days + 1, 1)).alias("eligible_drives"),
        F.count(F.lit(1)).alias("drives"))


def class_balance(readings: DataFrame) -> DataFrame:
    """Rows per class and the healthy-to-failed ratio."""
    per = readings.groupBy("failure").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.coalesce(F.sum(F.when(F.col("failure") == 0, F.col("n"))), F.lit(0)).alias("_h"),
                    F.coalesce(F.sum(F.when(F.col("failure") == 1, F.col("n"))), F.lit(1)).alias("_f"))
    return per.crossJoin(F.broadcast(total)).select("failure", "n", (F.col("_h") / F.col("_f")).alias("ratio"))


def attribute_histogram(readings: DataFrame, attr: str, bins: int = 40) -> DataFrame:
    """(failure, bin, n, density) of log1p(attr); bins span each class's own range."""
    rows = readings.select("failure", log_level(attr).alias("x")).where(F.col("x").isNotNull())
    edges = rows.groupBy(F.col("failure").alias("_f")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"),
                                                          F.count(F.lit(1)).alias("total"))
    # A class with a single value gets a unit range around it.
    flat = F.when(F.col("hi") == F.col("lo"), 0.5).otherwise(0.0)
    edges = edges.withColumn("_flat", flat).withColumn("lo", F.col("lo") - F.col("_flat")).withColumn("hi", F.col("hi") + F.col("_flat"))
    j = rows.join(F.broadcast(edges), F.col("failure") == F.col("_f"))      # one row per class
    width = F.col("hi") - F.col("lo")
    at = bin_index((F.col("x") - F.col("lo")) / width, 0, 1, bins)
    return (j.groupBy("failure", at.alias("bin"), "total", width.alias("width")).agg(F.count(F.lit(1)).alias("n"))
            .select("failure", "bin", "n", (F.col("n") * bins / (F.col("total") * F.col("width"))).alias("density")))


def correlations(readings: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) for every pair, each over the rows where both are present; one scan for any number of columns."""
    return pair_moments(readings, columns).select("a", "b", correlation().alias("corr"))


def days_to_failure_trend(readings: DataFrame, attrs: Sequence[str], horizon: int) -> DataFrame:
    """Mean of each attribute by days before the last reading of drives that failed."""
    by = Window.partitionBy("drive")
    rows = (readings.withColumn("_failed", F.max("failure").over(by)).withColumn("_last", F.max("day").over(by))
            .where("_failed = 1").withColumn("days_to_failure", F.datediff("_last", "day"))
            .where(F.col("days_to_failure") <= horizon))
    return rows.groupBy("days_to_failure").agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a) for a in attrs])


def record_lengths(readings: DataFrame, window_days: int) -> DataFrame:
    """Per drive: calendar days, readings, windows on offer (at least 1)."""
    got = readings.groupBy("drive").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.count(F.lit(1)).alias("readings"))
    days = F.datediff("b", "a") + 1
    return got.select("drive", days.alias("days"), "readings", F.greatest(days - window_days + 1, F.lit(1)).alias("windows"))


def describe_lengths(lengths: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles and max of days, readings and windows."""
    melted = lengths.select(*[F.col(c).cast("double").alias(c) for c in ("days", "readings", "windows")])
    long = melted.unpivot([], ["days", "readings", "windows"], "measure", "v")
    # Whole days: the distinct values `percentile` keeps are bounded by the calendar.
    return long.groupBy("measure").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"),
        F.percentile("v", 0.25).alias("p25"), F.percentile("v", 0.5).alias("p50"), F.percentile("v", 0.75).alias("p75"),
        F.max("v").alias("max"))


def length_shares(lengths: DataFrame, thresholds: Sequence[int] = (30, 90, 180, 365)) -> DataFrame:
    """Drives with at least t days, and their share."""
    got = lengths.agg(*[F.sum((F.col("days") >= t).cast("bigint")).alias(str(t)) for t in thresholds],
                      F.count(F.lit(1)).alias("_n"))
    return (got.unpivot(["_n"], [str(t) for t in thresholds], "min_days", "drives")
            .select(F.col("min_days").cast("int").alias("min_days"), "drives", (F.col("drives") / F.col("_n")).alias("share")))

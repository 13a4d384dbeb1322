"""From raw readings to a gap-free daily calendar per drive.

One shuffle on `drive` carries everything here. The record bounds, forward fill, gap filling,
next-failure lookup and lagged differences are all window functions over that same partitioning,
so Catalyst plans a single exchange. A drive holds at most one row per calendar day once
`dedupe_days` has run, which bounds every drive-keyed window by the length of the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import log_level
from ..settings import WindowSpec

SO_FAR = (Window.unboundedPreceding, Window.currentRow)
PART_ROWS = 250_000


def by_drive(*order: str | Column):
    """The one partitioning every drive-keyed window shares."""
    w = Window.partitionBy("drive")
    return w.orderBy(*order) if order else w


def telemetry(df: DataFrame, drive: str, day: str, failure: str | None = None, model: str | None = None,
              attrs: Sequence[str] | dict[str, str] = ()) -> DataFrame:
    """Map any frame onto the canonical columns: drive, day, failure, model, attributes."""
    attrs = attrs if isinstance(attrs, dict) else {a: a for a in attrs}
    cols = [F.col(drive).alias("drive"), F.to_date(day).alias("day"),
            (F.coalesce(F.col(failure).cast("int"), F.lit(0)) if failure else F.lit(0)).alias("failure")]
    if model:
        cols.append(F.col(model).alias("model"))
    return df.select(*cols, *[F.col(src).alias(name) for name, src in attrs.items()])


def census(readings: DataFrame, single_pass: bool = False) -> DataFrame:
    """One row per drive: span, counts, failure positions.

    On a stored table the counts aggregate in a hash table on the map side, and the failure days are
    gathered from the failure rows alone (a filter the scan pushes down), since a collected set would
    force a sort of every row. `single_pass` gathers both at once: better for readings that are
    themselves the result of a query, which the two-branch form would compute twice.
    """
    counts = [F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n_obs"),
              F.sum("failure").cast("bigint").alias("n_fail")]
    fail_days = F.array_sort(F.collect_set(F.when(F.col("failure") == 1, F.col("day")))).alias("fail_days")
    if single_pass:
        rows = readings.groupBy("drive").agg(*counts, fail_days)
    else:
        fails = readings.where(F.col("failure") == 1).groupBy("drive").agg(fail_days)
        rows = readings.groupBy("drive").agg(*counts).join(fails, "drive", "left")
    days = F.coalesce("fail_days", F.array().cast("array<date>"))
    return (rows.withColumn("n_days", F.datediff("last_day", "first_day") + 1)
            .withColumn("has_failure", (F.col("n_fail") > 0).cast("int"))
            .withColumn("fail_pos", F.transform(days, lambda d: F.datediff(d, F.col("first_day"))))
            .drop("fail_days"))


def long_enough(readings: DataFrame, min_days: int) -> DataFrame:
    """Readings of drives whose record spans at least `min_days` calendar days."""
    keep = (readings.groupBy("drive").agg(F.min("day").alias("a"), F.max("day").alias("b"))
            .where(F.datediff("b", "a") + 1 >= min_days).select("drive"))
    return readings.join(keep, "drive", "left_semi")


def dedupe_days(readings: DataFrame, tiebreak: Sequence[str] = ()) -> DataFrame:
    """One row per (drive, day); a failure row wins, then the largest `tiebreak` value, then the largest other values in column order.

    An aggregate rather than row_number, so repeats collapse on the map side and a day that was
    sent a million times never gathers in one task.
    """
    keys = ("drive", "day")
    rest = [c for c in readings.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in dict.fromkeys(("failure", *tiebreak, *rest))])      # all columns but the keys
    best = readings.groupBy(*keys).agg(F.max(order).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def in_parts(readings: DataFrame, rows: int, part_rows: int | None = None) -> DataFrame:
    """`readings` by drive, in a part for every `part_rows` of the `rows` they come from, once these fill more than one.

    All later windows by drive keep these parts. A task sorts the calendar, which is many times what it reads, so parts that are
    joined by the size of what is read would take memory that grows with the table. There are no fewer parts than tasks that a
    shuffle would have kept busy.
    """
    parts = -(-rows // (part_rows or PART_ROWS))
    spark = readings.sparkSession
    busy = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return readings.repartition(max(parts, busy), "drive") if parts > 1 else readings


def densify(readings: DataFrame, spec: WindowSpec, carry: Sequence[str] = (), diffs: bool = True) -> DataFrame:
    """One row per calendar day of each drive, with filled levels, differences and `observed`.

    `readings` must hold one row per (drive, day). Gap days are produced by exploding each reading
    up to the day before the next one, so no calendar table is joined. Columns: drive, carry..., day,
    pos, n_days, observed, failure, next_fail (position of the first failure at or after this day),
    levels, `<attr>_d<lag>`.
    """
    ordered = by_drive("day")
    newest_first = by_drive(F.col("day").desc())
    failed_on = F.when(F.col("failure") == 1, F.col("day"))

    def level(a: str) -> Column:
        return log_level(a) if a in spec.log_attrs else F.col(a).cast("double")

    rows = readings.select("drive", *carry, "day", "failure", *[level(a).alias(a) for a in spec.attrs])
    # Running frames in day order and in reverse order; a frame over the whole record is never buffered.
    rows = rows.select(
        "drive", "day", "failure",
        *[F.first(c, ignorenulls=True).over(newest_first.rowsBetween(*SO_FAR)).alias(c) for c in carry],
        F.min("day").over(ordered.rowsBetween(*SO_FAR)).alias("first_day"),
        F.max("day").over(newest_first.rowsBetween(*SO_FAR)).alias("last_day"),
        F.lead("day").over(ordered).alias("next_day"),
        F.min(failed_on).over(newest_first.rowsBetween(*SO_FAR)).alias("fail_from_here"),
        F.min(failed_on).over(newest_first.rowsBetween(Window.unboundedPreceding, -1)).alias("fail_later"),
        *[F.last(a, ignorenulls=True).over(ordered.rowsBetween(*SO_FAR)).alias(a) for a in spec.attrs],
    ).withColumn("n_days", F.datediff("last_day", "first_day") + 1)
    rows = rows.where(F.col("n_days") >= spec.shortest_record)
    gap = F.coalesce(F.datediff("next_day", "day") - 1, F.lit(0))
    rows = rows.withColumn("after", F.explode(F.sequence(F.lit(0), gap)))
    seen = F.col("after") == 0
    next_fail = F.when(seen, F.col("fail_from_here")).otherwise(F.col("fail_later"))
    dense = rows.select(
        "drive", *carry, F.date_add("day", F.col("after")).alias("day"),
        (F.datediff("day", "first_day") + F.col("after")).alias("pos"), "n_days",
        seen.cast("int").alias("observed"),
        F.when(seen, F.col("failure")).otherwise(F.lit(0)).alias("failure"),
        F.datediff(next_fail, "first_day").alias("next_fail"),
        *spec.attrs,
    )
    return with_differences(dense, spec) if diffs else dense


def with_differences(dense: DataFrame, spec: WindowSpec) -> DataFrame:
    """`<attr>_d<lag>`: change over `lag` calendar days, NULL on the first `lag` days."""
    order = by_drive("pos")
    return dense.select("*", *[(F.col(a) - F.lag(a, k).over(order)).alias(f"{a}_d{k}")
                               for k in spec.lags for a in spec.attrs])


def failure_positions(readings: DataFrame) -> DataFrame:
    """(drive, fail_pos): 0-based calendar position of every failure day."""
    return census(readings).select("drive", F.explode("fail_pos").alias("fail_pos"))

"""Exact global order without a global sort in one task.

Running totals, ranks and quantiles all need one order over every row. A bare
`Window.orderBy` would send every row to a single task. Here the rows are first reduced to
one row per distinct value, a range exchange deals the values into ordered buckets, each bucket runs
its own window, and the totals of the earlier buckets are added back. The only broadcast table holds
one row per (group, bucket), of which there are at most as many as groups and shuffle partitions together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .expr import digest

HASH_CELL = 3          # hex digits: at most 4,096 cells per group


def in_ranges(hist: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """`hist`, one row per distinct key, settled in ranges of (`by`, `order`); `_range` is the number of a row's range.

    The range exchange samples the keys and deals them out evenly, so it doesn't matter where they lie, and
    adaptive execution joins small ranges. The number is written with the row, so that every reader sees the same.
    """
    return settle(hist.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))


def totals_in_order(hist: DataFrame, order: Sequence[Column], sums: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """`running_totals` along `order` for a table of distinct keys, over ranges of them."""
    return running_totals(in_ranges(hist, order, by), F.col("_range"), order, sums, by).drop("_range")


def running_totals(hist: DataFrame, bucket: Column, order: Sequence[Column], sums: dict[str, str],
                   by: Sequence[str] = ()) -> DataFrame:
    """Add `sums[name]`, the total of column `name` over all rows up to and including this one.

    `hist` has one row per distinct order key. `bucket` must not decrease along `order`. `by` names a
    small, fixed set of groups (families, columns, boosting rounds), never drives.
    """
    by = list(by)
    cells = hist.withColumn("_bucket", bucket)
    totals = cells.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per (group, bucket): a constant number per group, whatever the data holds.
    offsets = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in by], F.col("_bucket").alias("_k_bucket"),
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums])
    on = F.col("_bucket") == F.col("_k_bucket")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inside = (Window.partitionBy(*by, "_bucket").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = cells.join(F.broadcast(offsets), on)
    return joined.select(
        *hist.columns,
        *[(F.col(f"_o_{c}") + F.sum(c).over(inside)).alias(out) for c, out in sums.items()])


def hash_rank(df: DataFrame, keys: Sequence[Column], seed, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """1-based position of every row in md5 order of (seed, keys), within `by`.

    md5 is uniform, so its leading digits are even cuts that need no sampling of the data.
    """
    by = list(by)
    rows = df.withColumn("_h", digest(seed, *keys)).withColumn("_cell", F.substring("_h", 1, HASH_CELL))
    cells = rows.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_cell").alias("_k_cell"),
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    on = F.col("_cell") == F.col("_k_cell")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inside = Window.partitionBy(*by, "_cell").orderBy("_h", *keys)
    # 16**HASH_CELL rows per group; the groups may be many, so nothing is broadcast unasked.
    return (rows.join(offsets, on)
            .withColumn(out, (F.col("_o") + F.row_number().over(inside)).cast("bigint"))
            .select(*df.columns, out))


def known_score(score: str) -> Column:
    """The score with NaN as NULL. Rankings put such rows last."""
    return F.when(~F.isnan(score), F.col(score))


def score_rank(df: DataFrame, score: str, keys: Sequence[Column], out: str = "rank") -> DataFrame:
    """1-based rank by score descending, rows without a score (NULL or NaN) last, ties in md5 order of `keys`.

    A score that a third of the rows share is split over 256 hash cells, so no task holds it whole.
    """
    rows = (df.withColumn("_s", known_score(score)).withColumn("_h", digest(*keys))
            .withColumn("_cell", F.substring("_h", 1, 2)))
    cells = rows.groupBy("_s", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    ranked = totals_in_order(cells, [F.col("_s").desc_nulls_last(), F.col("_cell")], {"_n": "_upto"})
    offsets = ranked.select(F.col("_s").alias("_k_score"), F.col("_cell").alias("_k_cell"),
                            (F.col("_upto") - F.col("_n")).alias("_o"))
    inside = Window.partitionBy("_s", "_cell").orderBy("_h", *keys)
    return (rows.join(offsets, F.col("_s").eqNullSafe(F.col("_k_score")) & (F.col("_cell") == F.col("_k_cell")))
            .withColumn(out, (F.col("_o") + F.row_number().over(inside)).cast("bigint"))
            .select(*df.columns, out))


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column): `column`, `value` as double. NaN becomes NULL."""
    values = [F.col(c).cast("double").alias(c) for c in columns]
    wide = df.select(*keep, *values)
    melted = wide.unpivot(list(keep), list(columns), "column", "value") if keep else \
        wide.unpivot([], list(columns), "column", "value")
    return melted.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles of each column over its non-null values.

    Returns (column, prob, value). Exact, and no task ever holds a whole column: the two order
    statistics around each position are read off the running counts.
    """
    hist = (long_form(df, columns).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    hist = in_ranges(hist, [F.col("value")], ["column"])
    totals = hist.groupBy(F.col("column").alias("_c")).agg(F.sum("n").alias("_total"))
    run = running_totals(hist, F.col("_range"), [F.col("value")], {"n": "upto"}, by=["column"])
    # One row per column, with the positions asked for; a row keeps only those that fall on it.
    at = F.array(*[F.struct(F.lit(float(p)).alias("prob"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("at"))
                   for p in probs])
    j = run.join(F.broadcast(totals.select("_c", at.alias("_at"))), F.col("column") == F.col("_c"))
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1

    def covers(p: Column) -> Column:
        return (first <= p) & (p <= last)

    mine = F.filter("_at", lambda t: covers(F.floor(t["at"])) | covers(F.ceil(t["at"])))
    near = j.select("column", "value", first.alias("_first"), last.alias("_last"), F.explode(mine).alias("t"))
    low, high = F.floor("t.at"), F.ceil("t.at")
    at_low = F.max(F.when((F.col("_first") <= low) & (low <= F.col("_last")), F.col("value")))
    at_high = F.max(F.when((F.col("_first") <= high) & (high <= F.col("_last")), F.col("value")))
    frac = F.max(F.col("t.at") - low)
    return near.groupBy("column", F.col("t.prob").alias("prob")).agg((at_low + (at_high - at_low) * frac).alias("value"))


def grouped_hash_order(df: DataFrame, group: str, order: Sequence[str], seed: Sequence, out: str = "seq") -> DataFrame:
    """0-based place of each row when groups are taken in md5 order and rows in `order` inside them."""
    sizes = (df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_h", digest(*seed, F.col(group))))
    placed = running_totals(sizes, F.substring("_h", 1, HASH_CELL), [F.col("_h"), F.col(group)], {"_n": "_upto"})
    offsets = placed.select(F.col(group).alias("_g"), (F.col("_upto") - F.col("_n")).alias("_o"))
    inside = Window.partitionBy(group).orderBy(*order)
    return (df.join(offsets, F.col(group) == F.col("_g"))
            .withColumn(out, (F.col("_o") + F.row_number().over(inside) - 1).cast("bigint"))
            .drop("_g", "_o"))

"""Statistics of an archive as state that can be merged, kept beside its shards.

Each shard leaves partial census rows, a Theta sketch of its drives and a KLL sketch of every column. A new shard is
summed up by reading that shard alone, and whatever is asked of the whole archive is merged from the states: the census exactly, a drive
in several shards counted once; distinct drives and quantiles within the sketches' error.

A shard that is summed up again replaces its state. Missing values and NaN are in no sketch. Rows without a drive are in no census.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import long_form
from ..session import settle

KLL_K = 1000
THETA_LOG_K = 14


def rank_error(k: int = KLL_K) -> float:
    """How far, as a share of the rows, a quantile of a KLL sketch of this size is off, with 99 % confidence (published formula)."""
    return 2.296 / k ** 0.9723


def _write(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("archive").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def add_shards(readings: DataFrame, folder: str, columns: Sequence[str], k: int = KLL_K) -> None:
    """Sum up the shards in `readings` (archive, drive, day, failure, columns), and no others."""
    per = settle(readings.where(F.col("drive").isNotNull()).groupBy("archive", "drive").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n_obs"),
        F.sum("failure").cast("bigint").alias("n_fail"), F.collect_set(F.when(F.col("failure") == 1, F.col("day"))).alias("fail_days")))
    _write(per, f"{folder}/census")
    _write(per.groupBy("archive").agg(F.theta_sketch_agg("drive", F.lit(THETA_LOG_K)).alias("drives")), f"{folder}/drives")
    values = long_form(readings, columns, keep=["archive"]).where(F.col("value").isNotNull())
    _write(values.groupBy("archive", "column").agg(F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n")), f"{folder}/quantiles")


def merged_census(spark: SparkSession, folder: str) -> DataFrame:
    """The census of the whole archive: `operators.calendar.census` of all its readings, from one row per shard and drive."""
    days = F.array_sort(F.array_distinct(F.flatten(F.collect_list("fail_days"))))
    per = spark.read.parquet(f"{folder}/census").groupBy("drive").agg(
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.sum("n_obs").alias("n_obs"), F.sum("n_fail").alias("n_fail"),
        days.alias("fail_days"))
    return per.select("drive", "first_day", "last_day", "n_obs", "n_fail", (F.datediff("last_day", "first_day") + 1).alias("n_days"),
                      (F.col("n_fail") > 0).cast("int").alias("has_failure"),
                      F.transform("fail_days", lambda d: F.datediff(d, F.col("first_day"))).alias("fail_pos"))


def distinct_drives(spark: SparkSession, folder: str) -> DataFrame:
    """One row: shards, and drives in any of them; exact as long as they are fewer than 2 ** THETA_LOG_K."""
    return spark.read.parquet(f"{folder}/drives").agg(F.count(F.lit(1)).alias("shards"),
                                                      F.theta_sketch_estimate(F.theta_union_agg("drives", F.lit(THETA_LOG_K))).alias("drives"))


def shared_drives(spark: SparkSession, folder: str, one: str, other: str) -> DataFrame:
    """One row: drives in both of two shards, from their sketches."""
    shard = F.col("archive").cast("string")
    both = spark.read.parquet(f"{folder}/drives").agg(F.max(F.when(shard == one, F.col("drives"))).alias("a"), F.max(F.when(shard == other, F.col("drives"))).alias("b"))
    return both.select(F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("drives"))


def merged_quantiles(spark: SparkSession, folder: str, probs: Sequence[float], k: int = KLL_K) -> DataFrame:
    """(column, n, prob, value): quantiles over all shards, `rank_error(k)` off at most with 99 % confidence; n counts exactly."""
    merged = spark.read.parquet(f"{folder}/quantiles").groupBy("column").agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))
    at = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in probs]))
    return merged.select("column", "n", at.alias("q")).select("column", "n", "q.*")


def ranks_of(readings: DataFrame, quantiles: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`quantiles` with the share of values below (`below`) and up to (`upto`) each of them; `quantiles` has a few rows per column."""
    asked = quantiles.groupBy(F.col("column").alias("_c")).agg(F.collect_list(F.struct("prob", "value")).alias("_q"))
    rows = long_form(readings, columns).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    at = rows.join(F.broadcast(asked), F.col("column") == F.col("_c")).select("column", "n", F.col("value").alias("v"), F.explode("_q").alias("q"))
    at = at.select("column", "n", "v", "q.*")

    def share(of) -> Column:
        return F.sum(F.when(of, F.col("n")).otherwise(0)) / F.sum("n")

    return at.groupBy("column", "prob", "value").agg(share(F.col("v") < F.col("value")).alias("below"), share(F.col("v") <= F.col("value")).alias("upto"))

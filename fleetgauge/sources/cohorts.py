"""Cohort reads over stored readings: slices, model-prefix loads, pruned loads, export picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.splits import keep_failures_sample
from ..settings import SEED


def recent_slice(readings: DataFrame, family: str | None = None, days: int = 45, healthy: int | None = 300,
                 seed: int = SEED) -> DataFrame:
    """The last `days` days before the newest one, for all failed and `healthy` drawn healthy drives."""
    rows = readings.where(F.col("model") == family) if family else readings
    newest = rows.agg(F.max("day").alias("_asof"))                 # one row
    recent = rows.join(F.broadcast(newest), F.col("day") >= F.date_sub("_asof", days - 1)).drop("_asof")
    return recent if healthy is None else keep_failures_sample(recent, healthy, seed)


def load_cohort(spark: SparkSession, paths: Sequence[str], model_prefix: str, columns: Sequence[str],
                partitions: int | None = None) -> DataFrame:
    """Readings of models that start with `model_prefix`, laid out by drive and sorted by day.

    Column pruning and the prefix filter reach the Parquet scan. One exchange on drive serves the
    sort here and every drive-keyed operator after it.
    """
    rows = (spark.read.parquet(*paths).where(F.col("model").startswith(model_prefix))
            .select("drive", "day", "model", "failure", *columns))
    laid = rows.repartition(partitions, "drive") if partitions else rows.repartition("drive")
    return laid.sortWithinPartitions("drive", "day")


def load_renamed(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Only the wanted columns of a wide export, under new names (stored name -> name)."""
    return spark.read.parquet(path).select(*[F.col(old).alias(new) for old, new in names.items()])


def pick_exports(manifest: DataFrame, window_days: int, limit: int = 6) -> DataFrame:
    """Per model its smallest file that spans a window, failures first, then by size; the first `limit`."""
    span = F.datediff("window_end", "window_start") + 1
    best = Window.partitionBy("model").orderBy("size_mb", "file")
    fits = manifest.where(span >= window_days).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    return fits.orderBy((F.col("failures") == 0).cast("int"), "size_mb", "model").limit(limit)

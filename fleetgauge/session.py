"""Session helper and the one place that cuts lineage."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fleetgauge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="fleetgauge-"))      # local runs only
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, or else a part of the session's warehouse, which is shared as well."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work").rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """A new, unused folder name below the shared folder."""
    return f"{shared_folder(spark)}/fleetgauge-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back.

    Several jobs can then read it, each only the columns it needs, and a lost executor costs a re-read
    instead of the whole lineage.
    """
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(module: str) -> None:
    """Send this module's functions to Python workers by value, so workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])

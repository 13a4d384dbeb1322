"""Incremental ingest and upsert: each file is taken once, and sending a day again replaces it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.calendar import dedupe_days
from ..session import settle
from ..sources.uploads import upsert


def run_available(writer) -> None:
    """Process everything there is, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()


def ingest_new_files(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str,
                     glob: str = "*", max_files: int = 1000, shape: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append the files that arrived since the last call to a Parquet table.

    The checkpoint remembers finished files, so a run that dies in the middle carries on where it was.
    """
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files)
              .parquet(source))
    shaped = shape(stream) if shape else stream
    run_available(shaped.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint))


def upsert_days(batch: DataFrame, table: str, tiebreak: Sequence[str] = ()) -> None:
    """Merge one micro-batch of readings into a table partitioned by day.

    Only the days in the batch are read and rewritten. The merged days are settled before the overwrite,
    so a lost executor or a replayed batch gives the same table.
    """
    spark = batch.sparkSession
    fresh = dedupe_days(batch, tiebreak)
    days = [r["day"] for r in fresh.select("day").distinct().collect()]      # calendar days of one batch
    if not days:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        old = spark.read.schema(fresh.schema).parquet(table).where(F.col("day").isin(days))
        fresh = upsert(old.select(*fresh.columns), fresh)
    (settle(fresh).hint("rebalance", F.col("day")).write.partitionBy("day").option("partitionOverwriteMode", "dynamic")
     .mode("overwrite").parquet(table))


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, tiebreak: Sequence[str] = ()) -> None:
    run_available(stream.writeStream.option("checkpointLocation", checkpoint)
                  .foreachBatch(lambda batch, _: upsert_days(batch, table, tiebreak)))

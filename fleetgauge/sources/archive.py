"""Daily CSV files with drifting headers -> one pinned schema -> a partitioned Parquet archive."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import clean_number
from ..session import ship

HEADER_BLOCK = 1 << 16

# Raw attributes kept in an archive shard, and the identity and topology columns (fixed values).
SHARD_SMART_IDS = (1, 3, 4, 5, 7, 9, 10, 12, 183, 184, 187, 188, 189, 190, 192, 193, 194, 197, 198, 199, 240, 241, 242)
TOPOLOGY = ("datacenter", "cluster_id", "vault_id", "pod_id")


def shard_schema(smart_ids: Sequence[int] = SHARD_SMART_IDS) -> T.StructType:
    """date, identity, failure, attributes as float, capacity as double, topology."""
    fields = [T.StructField("date", T.DateType()), T.StructField("serial_number", T.StringType()),
              T.StructField("model", T.StringType()), T.StructField("failure", T.ByteType())]
    fields += [T.StructField(f"smart_{i}_raw", T.FloatType()) for i in smart_ids]
    fields += [T.StructField("capacity_bytes", T.DoubleType())]
    fields += [T.StructField(c, T.StringType()) for c in TOPOLOGY]
    return T.StructType(fields + [T.StructField("pod_slot_num", T.FloatType())])


def export_schema(smart_columns: Sequence[str]) -> T.StructType:
    """The wide vendor export. Attributes are doubles: a float loses whole counts near 1e12."""
    longs = ("capacity_bytes", "cluster_id", "vault_id", "pod_id", "pod_slot_num")
    fields = [T.StructField("date", T.TimestampType()), *[T.StructField(c, T.StringType()) for c in
                                                          ("serial_number", "model", "datacenter")]]
    fields += [T.StructField("failure", T.ByteType()), T.StructField("is_legacy_format", T.BooleanType())]
    fields += [T.StructField(c, T.LongType()) for c in longs]
    return T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in smart_columns])


def list_daily_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of every daily CSV below `folder`. Only names are listed; no content is read.

    Spark's own listing already leaves out names that start with "." or "_".
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
             .option("recursiveFileLookup", "true").load(folder).select("path"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.startswith("._") & ~F.col("path").contains("__MACOSX"))


def _read_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        headers = []
        for path in batch["path"]:
            uri = path if "://" in path else path.replace("file:", "file://", 1)
            store, name = fs.FileSystem.from_uri(uri)
            with store.open_input_stream(name) as f:
                line = b""
                while b"\n" not in line and (more := f.read(HEADER_BLOCK)):
                    line += more
            line = line.split(b"\n", 1)[0].removeprefix(b"\xef\xbb\xbf").decode("latin-1")
            headers.append([c.strip() for c in next(csv.reader([line.rstrip("\r")]), [])])
        yield pd.DataFrame({"path": batch["path"], "header": headers})


def headers_of(files: DataFrame) -> DataFrame:
    """(path, header): the first line of each file, read inside tasks."""
    return files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism).mapInPandas(_read_headers, "path string, header array<string>")


def read_daily_csvs(spark: SparkSession, folder: str, wanted: Sequence[str], keys: Sequence[str] = ("serial_number", "date")) -> DataFrame:
    """All daily files as text columns named in `wanted`; a column a file lacks is NULL. Files are Latin-1, and those whose
    header lacks one of `keys` are no daily readings and are skipped.

    Files are grouped by header and each group is read with its own schema, because a CSV schema
    binds by position. The driver holds one path per file and one schema per distinct header.
    """
    groups = (headers_of(list_daily_files(spark, folder)).groupBy("header")
              .agg(F.collect_list("path").alias("paths")).collect())
    if not groups:
        raise FileNotFoundError(f"no daily CSV under {folder}")
    parts = []
    for g in sorted((g for g in groups if set(keys) <= set(g["header"])), key=lambda g: g["header"]):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in g["header"]])
        part = spark.read.csv(sorted(g["paths"]), header=True, schema=schema, encoding="ISO-8859-1")
        parts.append(part.select(*[c for c in wanted if c in g["header"]]))
    if not parts:
        raise FileNotFoundError(f"no daily CSV with {list(keys)} under {folder}")
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.select(*[F.col(c) if c in whole.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Coerce to a pinned schema: bad numbers and dates become NULL, a missing failure 0, an absent column NULL."""
    def one(f: T.StructField) -> Column:
        if f.name not in df.columns:
            value = F.lit(0) if f.name == "failure" else F.lit(None)
        elif f.name == "failure":
            value = F.coalesce(F.col(f.name).try_cast(f.dataType), clean_number(f.name).try_cast(f.dataType), F.lit(0))
        elif isinstance(f.dataType, (T.DateType, T.TimestampType)):
            value = F.try_to_timestamp(F.col(f.name).cast("string"))
        elif isinstance(f.dataType, T.IntegralType):              # straight from the text: a double would lose digits
            value = F.coalesce(F.col(f.name).try_cast(f.dataType), clean_number(f.name).try_cast(f.dataType))
        elif isinstance(f.dataType, T.NumericType):
            value = clean_number(f.name)
        elif isinstance(f.dataType, T.BooleanType):
            value = F.col(f.name).try_cast("boolean")
        else:
            value = F.col(f.name)
        return value.try_cast(f.dataType).alias(f.name)

    return df.select(*[one(f) for f in schema.fields])


def drop_keyless(df: DataFrame, keys: Sequence[str] = ("serial_number", "date")) -> DataFrame:
    """Rows that have every key, with the id as text."""
    return df.dropna(subset=list(keys)).withColumn(keys[0], F.col(keys[0]).cast("string"))


def write_archive(readings: DataFrame, path: str, drive: str = "drive") -> None:
    """One folder per `archive`, zstd; adaptive execution cuts a large shard into as many files as its size asks for.

    Only the archives present in `readings` are replaced, so a rerun of one shard leaves the rest alone.
    """
    (readings.hint("rebalance", F.col("archive")).sortWithinPartitions("archive", drive)
     .write.partitionBy("archive").option("compression", "zstd")
     .option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path))


def archive_summary(readings: DataFrame) -> DataFrame:
    """Rows, drives and failures per archive; distinct drives by a two-level aggregate."""
    per = readings.groupBy("archive", "drive").agg(F.count(F.lit(1)).alias("n"), F.sum("failure").alias("f"))
    return per.groupBy("archive").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("drives"),
                                      F.sum("f").alias("failures"))


def read_archive(spark: SparkSession, path: str, since_year: int | None = None,
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Read shards, by the year in the archive's name when `since_year` is given (a partition filter)."""
    df = spark.read.parquet(path)
    if since_year is not None:
        df = df.where(F.regexp_extract(F.col("archive").cast("string"), r"(\d{4})", 1).try_cast("int") >= since_year)
    return df.select(*columns) if columns else df


def write_by_model(readings: DataFrame, path: str) -> None:
    """One table with one folder per model."""
    (readings.hint("rebalance", F.col("model")).write.partitionBy("model")
     .option("compression", "zstd").mode("overwrite").parquet(path))


# ---- chunks of days ------------------------------------------------------------------------------

def day_chunks(readings: DataFrame, size: int) -> DataFrame:
    """(day, chunk, gap): available days in groups of `size` by rank; gap = days missing before this one.

    Distinct days are bounded by the calendar, so the one ordered window is small.
    """
    days = readings.select("day").distinct()
    order = Window.orderBy("day")
    return days.select("day", F.floor((F.row_number().over(order) - 1) / size).cast("int").alias("chunk"),
                       (F.datediff("day", F.lag("day").over(order)) - 1).alias("gap"))


def with_chunk(readings: DataFrame, size: int) -> DataFrame:
    """Readings with their chunk number, ready for `write.partitionBy("chunk")`."""
    return readings.join(F.broadcast(day_chunks(readings, size).select("day", "chunk")), "day")  # one row per calendar day


def chunk_summary(readings: DataFrame, size: int, full_days: int = 30) -> DataFrame:
    """Per chunk: days, first and last day, rows, drives, failures, drives seen on `full_days` days or more."""
    rows = with_chunk(readings, size)
    per = rows.groupBy("chunk", "drive").agg(F.count(F.lit(1)).alias("n"), F.sum("failure").alias("f"),
                                             F.min("day").alias("a"), F.max("day").alias("b"))
    days = day_chunks(readings, size).groupBy(F.col("chunk").alias("_c")).agg(F.count(F.lit(1)).alias("days"))
    got = per.groupBy("chunk").agg(
        F.min("a").alias("first_day"), F.max("b").alias("last_day"), F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("drives"), F.sum("f").alias("failures"),
        F.sum((F.col("n") >= full_days).cast("bigint")).alias("full_drives"))
    return got.join(F.broadcast(days), F.col("chunk") == F.col("_c")).drop("_c")


ship(__name__)

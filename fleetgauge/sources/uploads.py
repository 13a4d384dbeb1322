"""Files as users send them: by extension, with their own headers, or as logs to be converted."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import clean_number

# Canonical name -> accepted headers, first match wins (fixed values).
ALIASES = {
    "serial_number": ("serial_number", "serial", "id", "drive_id", "serialnumber"),
    "date": ("date", "time", "timestamp", "day"),
    "model": ("model", "drive_model", "model_name"),
    "failure": ("failure", "failed", "label"),
}

# Log headers that name the day or the drive, in order of preference (fixed values).
DATE_HEADERS = ("date", "timestamp", "time", "day", "collected_at")
ID_HEADERS = ("serial_number", "serial", "serialnumber", "drive_id", "wwn", "id", "device")

# Attribute names as the disk tools print them -> attribute number (fixed values).
TOOL_NAMES = {
    "Raw_Read_Error_Rate": 1, "Spin_Up_Time": 3, "Start_Stop_Count": 4, "Reallocated_Sector_Ct": 5,
    "Reallocated_Sectors_Count": 5, "Seek_Error_Rate": 7, "Power_On_Hours": 9, "Power_On_Hours_and_Msec": 9,
    "Spin_Retry_Count": 10, "Power_Cycle_Count": 12, "Power-Off_Retract_Count": 192, "Load_Cycle_Count": 193,
    "Temperature_Celsius": 194, "Airflow_Temperature_Cel": 194, "Current_Pending_Sector": 197,
    "Offline_Uncorrectable": 198, "UDMA_CRC_Error_Count": 199, "Head_Flying_Hours": 240,
}


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """CSV or text by header (every column as text), or Parquet."""
    ext = os.path.splitext(path)[1].lower()
    if ext in (".csv", ".txt"):
        return spark.read.csv(path, header=True)
    if ext == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"cannot read {ext!r} files; use .csv, .txt or .parquet")


def resolve(columns: Sequence[str], wanted: dict[str, Sequence[Sequence[str]]], key) -> dict[str, str]:
    """Target -> column. `wanted` lists each target's accepted names in tiers; `key` says when two names are the same.

    The best tier wins, and within it the column that comes first.
    """
    tiers = {key(name): (target, tier) for target, names in reversed(wanted.items())
             for tier, group in reversed(list(enumerate(names))) for name in group}
    hits = sorted((tiers[key(c)][1], at, c) for at, c in enumerate(columns) if key(c) in tiers)
    return {tiers[key(c)][0]: c for _, _, c in reversed(hits)}


def trimmed(name: str) -> str:
    return name.strip().lower()


def bare(name: str) -> str:
    """Only letters and digits, in lower case."""
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def canonical_headers(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Headers trimmed and in lower case, accepted ones under their canonical name; and what was renamed."""
    out = df.toDF(*map(trimmed, df.columns))
    found = resolve(out.columns, {target: [(name,) for name in names] for target, names in ALIASES.items()}, trimmed)
    changed = {found[target]: target for target in ALIASES if found.get(target, target) != target}
    return out.withColumnsRenamed(changed), [f"{old} -> {new}" for old, new in changed.items()]


def _pick(columns: Sequence[str], accepted: Sequence[str], what: str) -> str:
    found = resolve(columns, {what: [(name,) for name in accepted]}, bare)
    if not found:
        raise ValueError(f"no {what} column among {list(columns)}")
    return found[what]


def attribute_columns(columns: Sequence[str], taken: Sequence[str]) -> dict[str, str]:
    """Attribute -> source column, by number. An attribute's own name comes before the names that tools print."""
    numbers = {*TOOL_NAMES.values(), *(int(m[1]) for c in columns if (m := re.fullmatch(r"smart_(\d+)_raw", trimmed(c))))}
    wanted = {f"smart_{n}_raw": [(f"smart_{n}_raw",), [t for t, k in TOOL_NAMES.items() if k == n]] for n in sorted(numbers)}
    found = resolve([c for c in columns if c not in taken], wanted, bare)
    return {name: found[name] for name in wanted if name in found}


def convert_log(df: DataFrame, order_by: Sequence[str], id_column: str | None = None, date_column: str | None = None,
                aggregate: str = "last") -> DataFrame:
    """A monitoring log as one row per (serial_number, date).

    Repeats within a day collapse by `last` (newest by `order_by`, skipping NULLs), `max` or `mean`;
    model and failure always take the last value. Everything aggregates on the map side first.
    """
    if aggregate not in ("last", "max", "mean"):
        raise ValueError(f"unknown aggregate {aggregate!r}")
    date = date_column or _pick(df.columns, DATE_HEADERS, "timestamp")
    ident = id_column or _pick(df.columns, ID_HEADERS, "drive identity")
    extras = {n: c for n in ("model", "failure") for c in df.columns if bare(c) == n}
    attrs = attribute_columns(df.columns, (date, ident))
    when = F.col(date) if isinstance(df.schema[date].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) \
        else F.try_to_timestamp(F.col(date).cast("string"))
    rows = df.select(
        F.trim(F.col(ident).cast("string")).alias("serial_number"), F.to_date(when).alias("date"),
        # A plain column keeps the aggregate in a hash table; several need a struct.
        (F.col(order_by[0]) if len(order_by) == 1 else F.struct(*[F.col(c) for c in order_by])).alias("_at"),
        *[F.col(c).alias(n) for n, c in extras.items()], *[clean_number(c).alias(a) for a, c in attrs.items()])
    rows = rows.dropna(subset=["serial_number", "date"])

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c)

    def collapse(c: str) -> Column:
        return {"last": last(c), "max": F.max(c).alias(c), "mean": F.avg(c).alias(c)}[aggregate]

    return rows.groupBy("serial_number", "date").agg(*[last(n) for n in extras], *[collapse(a) for a in attrs])


def pivot_long(metrics: DataFrame, attributes: Sequence[str] | None = None) -> DataFrame:
    """(ts, serial, attribute, value) -> one row per (day, serial), each attribute's last value of the day.

    One conditional aggregate per attribute: a single pass, and no second job when the names are given.
    """
    if attributes is None:
        attributes = sorted(r[0] for r in metrics.select("attribute").distinct().collect())
    return metrics.groupBy(F.to_date("ts").alias("day"), "serial").agg(
        *[F.max_by("value", F.when((F.col("attribute") == a) & F.col("value").isNotNull(), F.col("ts"))).alias(a)
          for a in attributes])


# ---- disk-tool JSON ------------------------------------------------------------------------------

TOOL_SCHEMA = ("serial_number string, model_name string, model_family string, ata_smart_attributes struct<table: "
               "array<struct<id: int, raw: struct<value: bigint, string: string>>>>")


def parse_tool_json(docs: DataFrame, column: str = "value", ids: Sequence[int] | None = None) -> DataFrame:
    """One wide row per JSON document; documents without an attribute table or serial are skipped.

    The table is looked up inside the row with higher-order functions: no explode, no shuffle.
    """
    ids = sorted(ids or set(TOOL_NAMES.values()))
    d = F.from_json(column, TOOL_SCHEMA)
    rows = docs.withColumn("_d", d).withColumn("_t", F.col("_d.ata_smart_attributes.table"))
    serial = F.trim(F.coalesce("_d.serial_number", F.lit("")))
    named = F.trim(F.coalesce(F.nullif("_d.model_name", F.lit("")), "_d.model_family", F.lit("")))
    rows = rows.where((F.size("_t") > 0) & (serial != ""))

    def value(i: int) -> Column:
        hits = F.filter("_t", lambda e: (e["id"] == i) & e["raw"]["value"].isNotNull())
        return F.try_element_at(F.transform(hits, lambda e: e["raw"]["value"]), F.lit(-1)).alias(f"smart_{i}_raw")

    keep = [c for c in docs.columns if c != column]
    return rows.select(*keep, serial.alias("serial_number"), named.alias("model"), *[value(i) for i in ids])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("drive", "day")) -> DataFrame:
    """Old rows without a same-key row in `new`, plus `new`. Sending a day twice changes nothing."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)

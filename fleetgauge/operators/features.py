"""Window feature tables: five aggregates per channel over a fixed number of calendar days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import finite_or_zero
from ..settings import AGGREGATES, WindowSpec


def _starts_of_row(spec: WindowSpec, cover: str) -> Column:
    """Starts of the windows a dense row belongs to, as an array computed from pos and n_days."""
    pos, n = F.col("pos"), F.col("n_days")
    last = F.greatest(n - spec.days, F.lit(0))
    if cover == "latest":
        return F.array(F.when(pos >= last, last))
    stride = spec.days if cover == "tile" else spec.stride
    high = F.floor(F.least(pos, last) / stride).cast("int") * stride
    extra = F.when((last % stride != 0) & (pos >= last), last)
    if cover == "tile":
        return F.array(F.when(high > pos - stride, high), extra)
    low = F.greatest(F.ceil((pos - spec.days + 1) / stride), F.lit(0)).cast("int") * stride
    none = F.array().cast("array<int>")
    aligned = F.when(low <= high, F.sequence(low, F.greatest(high, low), F.lit(stride))).otherwise(none)
    return F.concat(aligned, F.array(extra)) if spec.include_last else aligned


def window_aggregates(dense: DataFrame, spec: WindowSpec, cover: str = "tile",
                      channels: Sequence[str] | None = None, carry: Sequence[str] = (),
                      aggregates: Sequence[str] = AGGREGATES) -> DataFrame:
    """One row per window: drive, start, n_days, label, n_real, n_padded, `<channel>__<agg>`...

    Each dense row is emitted once per window it belongs to (once for tiles, plus the overlap of
    the pulled-back last tile), then grouped by (drive, start). `dense` is already partitioned on
    drive, so no further shuffle is needed. A channel with a gap inside the window gives 0, as do
    NaN and the infinities. Short drives (only with `pad_short`) count as if zeros stood in front.
    """
    channels = list(channels or spec.channels)
    rows = dense.withColumn("start", F.explode(_starts_of_row(spec, cover))).where(F.col("start").isNotNull())
    at_start = F.col("pos") == F.col("start")
    at_end = F.col("pos") == F.least(F.col("start") + spec.days, F.col("n_days")) - 1
    aggs = [F.max("n_days").alias("n_days"),
            F.max(F.when(at_start, F.col("next_fail"))).alias("_nf"),
            F.sum("observed").cast("int").alias("n_real"),
            F.max(F.when(at_start, F.col("day"))).alias("start_day"),
            F.max(F.when(at_end, F.col("day"))).alias("end_day"),
            F.count(F.lit(1)).cast("int").alias("_rows")]
    need = {a for a in aggregates}
    for c in channels:
        v = F.col(c).cast("double")
        aggs.append(F.count(v).alias(f"_n_{c}"))
        if need & {"last", "delta"}:
            aggs.append(F.max(F.when(at_end, v)).alias(f"_last_{c}"))
        if "delta" in need:
            aggs.append(F.max(F.when(at_start, v)).alias(f"_first_{c}"))
        if "mean" in need:
            aggs.append(F.sum(v).alias(f"_sum_{c}"))
        if "min" in need:
            aggs.append(F.min(v).alias(f"_min_{c}"))
        if "max" in need:
            aggs.append(F.max(v).alias(f"_max_{c}"))
    # Carried columns are constant per drive, so they ride along as keys; text could not be hash-aggregated.
    got = rows.groupBy("drive", "start", *carry).agg(*aggs)
    padded = F.col("_rows") < spec.days
    zero = F.lit(0.0)

    def feature(c: str, a: str) -> Column:
        whole = F.col(f"_n_{c}") == F.col("_rows")
        if a == "last":
            value = F.col(f"_last_{c}")
        elif a == "delta":
            value = F.col(f"_last_{c}") - F.when(padded, zero).otherwise(F.col(f"_first_{c}"))
        elif a == "mean":
            value = F.when(whole, F.col(f"_sum_{c}") / spec.days)
        elif a == "min":
            value = F.when(whole, F.when(padded, F.least(F.col(f"_min_{c}"), zero)).otherwise(F.col(f"_min_{c}")))
        elif a == "max":
            value = F.when(whole, F.when(padded, F.greatest(F.col(f"_max_{c}"), zero)).otherwise(F.col(f"_max_{c}")))
        else:
            raise ValueError(f"unknown aggregate {a!r}")
        return finite_or_zero(value).alias(f"{c}__{a}")

    label = F.coalesce(F.col("_nf") <= F.col("start") + spec.reach, F.lit(False)).cast("int")
    return got.select("drive", "start", *carry, "n_days", label.alias("label"), "start_day", "end_day",
                      "n_real", (F.col("_rows") - F.col("n_real")).alias("n_filled"),
                      (F.lit(spec.days) - F.col("_rows")).alias("n_padded"),
                      *[feature(c, a) for a in aggregates for c in channels])


def window_tensor(dense: DataFrame, spec: WindowSpec, cover: str = "tile",
                  channels: Sequence[str] | None = None) -> DataFrame:
    """(drive, start, label, x): x is `days` rows of channel values, for sequence models only.

    A window holds `days` rows whatever the data size, so the collected array is bounded.
    """
    channels = list(channels or spec.channels)
    rows = dense.withColumn("start", F.explode(_starts_of_row(spec, cover))).where(F.col("start").isNotNull())
    values = F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in channels])
    got = rows.groupBy("drive", "start").agg(
        F.array_sort(F.collect_list(F.struct("pos", values.alias("v")))).alias("s"),
        F.max(F.when(F.col("pos") == F.col("start"), F.col("next_fail"))).alias("_nf"))
    blank = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), len(channels)), spec.days - F.size("s"))
    label = F.coalesce(F.col("_nf") <= F.col("start") + spec.reach, F.lit(False)).cast("int")
    return got.select("drive", "start", label.alias("label"),
                      F.concat(blank, F.transform("s", lambda r: r["v"])).alias("x"))


def label_conflicts(table: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """One row: groups of identical feature rows with both labels, and the accuracy ceiling they set.

    Rows are first counted per (hash, features), so a feature row shared by a third of the table
    collapses on the map side.
    """
    groups = table.groupBy(F.xxhash64(*features).alias("_h"), *features).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    mixed = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    lost = F.when(mixed, F.least(F.col("pos"), F.col("n") - F.col("pos"))).otherwise(0)
    return groups.agg(
        F.sum(mixed.cast("bigint")).alias("conflict_groups"),
        F.sum(F.when(mixed, F.col("n")).otherwise(0)).alias("rows_in_conflict"),
        F.sum(lost).alias("unreachable_rows"),
        (F.lit(1.0) - F.sum(lost) / F.sum("n")).alias("max_train_accuracy"))

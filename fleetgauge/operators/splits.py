"""Device-grouped splits, class weights and sampled cohorts. Every draw is an md5 order, so it replays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio
from ..functions.order import hash_rank
from ..settings import SEED, TEST_SHARE, VAL_SHARE


def grouped_split(drives: DataFrame, strata: Sequence[str] = ("has_failure",), test: float = TEST_SHARE,
                  val: float = VAL_SHARE, seed: int = SEED) -> DataFrame:
    """Add `split` (train / val / test) to one row per drive, sized exactly within each stratum.

    test = round(n * test), val = round((n - test) * val), both half-even. Pass `strata=()` for the
    plain grouped split.
    """
    strata = list(strata)
    sizes = drives.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    ranked = hash_rank(drives, [F.col("drive")], seed, by=strata, out="_rank")
    # One row per stratum.
    if strata:
        on = [ranked[c].eqNullSafe(F.col(f"_s_{c}")) for c in strata]
        sizes = sizes.select(*[F.col(c).alias(f"_s_{c}") for c in strata], "_n")
        joined = ranked.join(F.broadcast(sizes), on)
    else:
        joined = ranked.crossJoin(F.broadcast(sizes))
    n_test = F.bround(F.col("_n") * F.lit(test), 0)
    n_val = F.bround((F.col("_n") - n_test) * F.lit(val), 0)
    split = (F.when(F.col("_rank") <= n_test, "test").when(F.col("_rank") <= n_test + n_val, "val")
             .otherwise("train"))
    return joined.withColumn("split", split).select(*drives.columns, "split")


def split_integrity(split: DataFrame) -> DataFrame:
    """Per pair of splits: how many drives they share. Every count must be 0."""
    seen = split.groupBy("drive").agg(*[F.max((F.col("split") == s).cast("int")).alias(s)
                                        for s in ("train", "val", "test")])
    both = {f"{a}_{b}": F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0))
            for a, b in (("train", "val"), ("train", "test"), ("val", "test"))}
    counts = seen.agg(F.count(F.lit(1)).alias("drives"), *[e.alias(n) for n, e in both.items()])
    return counts.unpivot(["drives"], list(both), "pair", "shared")


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Per class: rows, inverse-frequency sampling weight, and positive weight for a loss. Use only one of them."""
    by_class = rows.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = by_class.agg(F.sum("n").alias("_total"), F.sum(F.when(F.col("label") == 1, F.col("n"))).alias("_pos"))
    # Two classes against one row.
    return by_class.crossJoin(F.broadcast(total)).select(
        "label", "n", (F.lit(1.0) / F.col("n")).alias("sampling_weight"),
        F.when(F.col("label") == 1, ratio(F.col("_total") - F.col("_pos"), F.col("_pos")))
        .otherwise(F.lit(1.0)).alias("pos_weight"))


def balanced_weight(rows: DataFrame, pos_fraction: float = 0.3, label: str = "label") -> DataFrame:
    """Add `weight` so that positives carry `pos_fraction` of the total weight (for a `weightCol`)."""
    total = rows.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_pos"))
    both = (F.col("_pos") > 0) & (F.col("_pos") < F.col("_n"))
    w = F.when(~both, F.lit(1.0)).when(F.col(label) == 1, F.lit(pos_fraction) * F.col("_n") / F.col("_pos")).otherwise(
        F.lit(1 - pos_fraction) * F.col("_n") / (F.col("_n") - F.col("_pos")))
    return rows.crossJoin(F.broadcast(total)).withColumn("weight", w).drop("_n", "_pos")


def keep_failures_sample(readings: DataFrame, healthy: int, seed: int = SEED) -> DataFrame:
    """All readings of failed drives and of `healthy` replayably drawn healthy drives."""
    drives = readings.groupBy("drive").agg(F.max("failure").alias("failed"))
    ranked = hash_rank(drives, [F.col("drive")], seed, by=["failed"])
    keep = ranked.where((F.col("failed") == 1) | (F.col("rank") <= healthy)).select("drive")
    return readings.join(keep, "drive", "left_semi")


def family_sample(readings: DataFrame, per_cell: int, seed: int = SEED) -> DataFrame:
    """Readings of up to `per_cell` failed and `per_cell` healthy drives of every model."""
    drives = readings.groupBy("drive").agg(F.min("model").alias("model"), F.max("failure").alias("failed"))
    ranked = hash_rank(drives, [F.col("drive")], seed, by=["model", "failed"])
    return readings.join(ranked.where(F.col("rank") <= per_cell).select("drive"), "drive", "left_semi")


def whole_drive_sample(readings: DataFrame, n_drives: int, seed: int = SEED) -> DataFrame:
    """All readings of `n_drives` replayably drawn drives; never a sample of rows."""
    drives = readings.select("drive").distinct()
    keep = hash_rank(drives, [F.col("drive")], seed).where(F.col("rank") <= n_drives).select("drive")
    return readings.join(keep, "drive", "left_semi")


def train_probe(split_drives: DataFrame, n_drives: int | None = None, like: str = "val", seed: int = SEED) -> DataFrame:
    """Training drives with the failing share (and, by default, the number) of the `like` split's drives."""
    shape = split_drives.where(F.col("split") == like).agg(
        F.count(F.lit(1)).alias("_size"), F.avg(F.col("has_failure").cast("double")).alias("_share"))
    train = split_drives.where(F.col("split") == "train")
    pools = train.agg(F.sum("has_failure").cast("bigint").alias("_pool_f"))
    ranked = hash_rank(train, [F.col("drive")], seed, by=["has_failure"], out="_rank")
    want = F.lit(n_drives) if n_drives else F.col("_size")
    n_f = F.least(F.col("_pool_f"), F.bround(want * F.col("_share"), 0))
    quota = F.when(F.col("has_failure") == 1, n_f).otherwise(want - n_f)
    # Two one-row tables.
    return (ranked.crossJoin(F.broadcast(shape)).crossJoin(F.broadcast(pools))
            .where(F.col("_rank") <= quota).select(*split_drives.columns))

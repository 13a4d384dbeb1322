"""The experiment log as tables: overfit gaps, divergence, early stopping, leaderboards, verdicts.

Epoch frames are keyed by (variation, epoch) and hold `train_<metric>` / `val_<metric>`. A run has at
most a few thousand epochs or boosting rounds, which bounds every per-run window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import fixed, ratio
from ..session import settle
from ..settings import DIVERGING_EPOCHS, MORE_IS_BETTER, OVERFIT_LIMITS


def by_run():
    return Window.partitionBy("variation")


def by_epoch():
    return by_run().orderBy("epoch")


def lead_of_training(metric: str) -> Column:
    """How far training looks better than validation, in percent of the worse side's value; NULL if that is 0."""
    better, worse = (f"train_{metric}", f"val_{metric}") if MORE_IS_BETTER[metric] else (f"val_{metric}", f"train_{metric}")
    return (100.0 * ratio(F.col(better) - F.col(worse), F.col(worse))).alias(f"{metric}_gap_pct")


def with_gaps(epochs: DataFrame, limits: Sequence[tuple] = OVERFIT_LIMITS) -> DataFrame:
    """Add `<metric>_gap_pct`, overfit_flag and overfit_reasons."""
    own = [(m, x) for m, _, x in limits if {f"train_{m}", f"val_{m}"} <= set(epochs.columns)]
    out = epochs.select("*", *[lead_of_training(m) for m, _ in own])
    broken = [(F.col(f"{m}_gap_pct") > x, F.concat(F.lit(f"{m} "), fixed(F.col(f"{m}_gap_pct"), 1), F.lit(f"%>{x:g}%"))) for m, x in own]
    flag = F.greatest(*[F.coalesce(b, F.lit(False)).cast("int") for b, _ in broken], F.lit(0), F.lit(0))
    return out.withColumns({"overfit_flag": flag, "overfit_reasons": F.concat_ws("; ", *[F.when(b, why) for b, why in broken])})


def best_epochs(epochs: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """(variation, best_epoch): the first epoch with validation's best value."""
    key = F.col(f"val_{metric}") if higher_is_better else -F.col(f"val_{metric}")
    return epochs.where(F.col(f"val_{metric}").isNotNull()).groupBy("variation").agg(
        F.max(F.struct(key.alias("k"), (-F.col("epoch")).alias("e"))).alias("b")).select(
        "variation", (-F.col("b.e")).alias("best_epoch"))


def _divergence_starts(epochs: DataFrame, metrics: Sequence[str], run: int) -> DataFrame:
    """Add `_div_<metric>`: the epoch, where a diverging run of the required length starts on it.

    All of it is windows over one run, so any number of metrics costs one shuffle.
    """
    def signed(m: str) -> tuple[Column, Column]:
        sign = 1.0 if MORE_IS_BETTER[m] else -1.0
        return sign * F.col(f"train_{m}"), sign * F.col(f"val_{m}")

    rows = epochs.select("*", *[F.max(signed(m)[1]).over(by_run()).alias(f"_top_{m}") for m in metrics])
    # First epoch that reaches the run's best validation value.
    rows = rows.select("*", *[F.min(F.when(signed(m)[1] == F.col(f"_top_{m}"), F.col("epoch"))).over(by_run()).alias(f"_from_{m}")
                              for m in metrics])

    def diverging(m: str) -> Column:
        t, v = signed(m)
        wider = (t - v) > F.lag(t - v).over(by_epoch())
        step = (F.col("epoch") > F.col(f"_from_{m}")) & (t >= F.lag(t).over(by_epoch())) & wider
        return F.coalesce(step, F.lit(False)).cast("int").alias(f"_d_{m}")

    rows = rows.select("*", *[diverging(m) for m in metrics])
    ahead = by_epoch().rowsBetween(0, run - 1)
    starts = [F.when(F.sum(f"_d_{m}").over(ahead) == run, F.col("epoch")).alias(f"_div_{m}") for m in metrics]
    return rows.select(*epochs.columns, *starts)


def divergence(epochs: DataFrame, metric: str, run: int = DIVERGING_EPOCHS) -> DataFrame:
    """(variation, divergence_epoch): start of the first `run` successive diverging epochs after
    validation's best one. Diverging: train not worse than the epoch before, and the gap wider."""
    return _divergence_starts(epochs, [metric], run).groupBy("variation").agg(
        F.min(f"_div_{metric}").alias("divergence_epoch"))


def overfit_status(flagged_at_best: Column, n_flagged: Column, divergence_epoch: Column) -> Column:
    return (F.when(flagged_at_best == 1, "overfit at best epoch")
            .when(n_flagged > 0, "overfit after best epoch")
            .when(divergence_epoch.isNotNull(), "early divergence").otherwise("no overfitting"))


def diagnose(epochs: DataFrame, select_by: str = "pr_auc", limits: Sequence[tuple] = OVERFIT_LIMITS,
             run: int = DIVERGING_EPOCHS) -> DataFrame:
    """One row per run: best, last and first flagged epoch, divergence, gaps and reasons at the best and last epoch, status.

    A column `stop_reason` of the last epoch is handed on; without one it is empty.
    """
    flagged = epochs if "overfit_flag" in epochs.columns else with_gaps(epochs, limits)
    have = [m for m in MORE_IS_BETTER if f"{m}_gap_pct" in flagged.columns]
    rows = _divergence_starts(flagged, have, run)
    key = F.col(f"val_{select_by}") if MORE_IS_BETTER[select_by] else -F.col(f"val_{select_by}")
    best = F.max(F.when(key.isNotNull(), F.struct(key.alias("k"), (-F.col("epoch")).alias("e")))).over(by_run())
    rows = rows.withColumn("_last", F.max("epoch").over(by_run())).withColumn("_best", best)
    rows = rows.withColumn("best_epoch", -F.col("_best.e")).where(F.col("best_epoch").isNotNull())
    at_best, at_last = F.col("epoch") == F.col("best_epoch"), F.col("epoch") == F.col("_last")
    got = rows.groupBy("variation", "best_epoch").agg(
        F.count(F.lit(1)).alias("epochs_run"), F.max("epoch").alias("stopped_epoch"),
        F.min(F.when(F.col("overfit_flag") == 1, F.col("epoch"))).alias("first_flagged_epoch"),
        F.sum("overfit_flag").alias("n_flagged_epochs"), F.max(F.when(at_best, F.col("overfit_flag"))).alias("flagged_at_best"),
        F.max(F.when(at_last, F.col("overfit_flag"))).alias("flagged_at_stop"),
        F.max(F.when(at_best, F.col("overfit_reasons"))).alias("reasons_at_best"),
        F.max(F.when(at_last, F.col("overfit_reasons"))).alias("reasons_at_stop"),
        F.max(F.when(at_last, F.col("stop_reason") if "stop_reason" in rows.columns else F.lit(""))).alias("stop_reason"),
        *[F.min(f"_div_{m}").alias(f"divergence_epoch_{m}") for m in have],
        *[F.max(F.when(at_best, F.col(f"{m}_gap_pct"))).alias(f"{m}_gap_pct_at_best") for m in have],
        *[F.max(F.when(at_last, F.col(f"{m}_gap_pct"))).alias(f"{m}_gap_pct_at_stop") for m in have])
    # The earliest watched divergence; the metric listed first wins a tie.
    watched = [m for m, _, _ in limits if m in have]
    options = F.filter(F.array(*[F.struct(F.col(f"divergence_epoch_{m}").alias("e"), F.lit(i).alias("i"), F.lit(m).alias("m"))
                                 for i, m in enumerate(watched)]), lambda s: s["e"].isNotNull())
    first = F.array_min(options)
    got = got.withColumn("divergence_epoch", first["e"]).withColumn("divergence_metric", first["m"])
    return got.withColumn("status", overfit_status(F.col("flagged_at_best"), F.col("n_flagged_epochs"), F.col("divergence_epoch")))


def early_stop(epochs: DataFrame, monitor: str = "val_pr_auc", mode: str = "max", patience: int = 3,
               min_delta: float = 1e-3) -> DataFrame:
    """(variation, best_epoch, stop_epoch): replay of patience-based stopping; stop is NULL if it never fires.

    Whether an epoch improves depends on the last improvement, so the run's few metric values are
    folded in order inside one expression.
    """
    sign = 1.0 if mode == "max" else -1.0
    hist = epochs.groupBy("variation").agg(
        F.array_sort(F.collect_list(F.struct("epoch", (sign * F.col(monitor)).alias("v")))).alias("h"))
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("bad"),
                     F.lit(None).cast("bigint").alias("stop"))

    def step(acc: Column, x: Column) -> Column:
        done = acc["stop"].isNotNull()
        better = F.coalesce(x["v"] > acc["best"] + min_delta, F.lit(False))
        bad = F.when(better, F.lit(0)).otherwise(acc["bad"] + 1)
        return F.struct(
            F.when(~done & better, x["v"]).otherwise(acc["best"]).alias("best"),
            F.when(~done & better, x["epoch"].cast("bigint")).otherwise(acc["at"]).alias("at"),
            F.when(done, acc["bad"]).otherwise(bad).alias("bad"),
            F.when(done, acc["stop"]).when(~better & (bad >= patience), x["epoch"].cast("bigint")).alias("stop"))

    folded = F.aggregate("h", start, step)
    return hist.select("variation", folded.alias("s")).select(
        "variation", F.col("s.at").alias("best_epoch"), F.col("s.stop").alias("stop_epoch"))


# ---- leaderboards (one row per model) --------------------------------------------------------------

def leaderboard(models: DataFrame) -> DataFrame:
    """Rank by drive precision@100 then test PR-AUC; mark each family's best by validation PR-AUC.

    Equal bests all win, and so does every model of a family that has no validation value.
    """
    order = Window.orderBy(F.col("drive_p100").desc_nulls_last(), F.col("test_pr_auc").desc_nulls_last(), "model")
    best = F.max("val_pr_auc").over(Window.partitionBy("family"))
    wins = F.when(best.isNull(), F.lit(1)).otherwise(F.coalesce((F.col("val_pr_auc") == best).cast("int"), F.lit(0)))
    return models.withColumn("rank", F.row_number().over(order)).withColumn("family_winner", wins)


def family_winners(board: DataFrame) -> DataFrame:
    return board.where("family_winner = 1")


def select_models(board: DataFrame, families: Sequence[str], best_only: Sequence[str] = ()) -> DataFrame:
    """Models of the wanted families, only the winner of those in `best_only`, ranked again."""
    keep = F.col("family").isin(list(families)) & (~F.col("family").isin(list(best_only)) | (F.col("family_winner") == 1))
    return leaderboard(board.where(keep).drop("rank", "family_winner")).drop("family_winner").join(
        board.select("model", "family_winner"), "model")


def verdict(board: DataFrame, column: str, tie_pct: float = 5.0) -> DataFrame:
    """One row: the leader and its margin, or a tie when the top two are within `tie_pct` percent."""
    top = board.where(F.col(column).isNotNull()).orderBy(F.col(column).desc(), "model").limit(2)
    place = F.row_number().over(Window.orderBy(F.col(column).desc(), "model"))          # two rows
    two = top.select("model", F.col(column).alias("v"), place.alias("r")).agg(
        *[F.max(F.when(F.col("r") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("model", "v")])
    a, b = F.col("v1"), F.col("v2")
    tied = (a <= 0) | (100 * (a - b) / F.when(a > 0, a) < tie_pct)
    a, b, one, two_ = fixed(a, 4), fixed(b, 4), F.col("model1").cast("string"), F.col("model2").cast("string")
    return two.select(F.when(tied, F.format_string("%s and %s are tied (%s vs %s)", one, two_, a, b))
                      .otherwise(F.format_string("%s (%s, next best %s at %s)", one, a, two_, b)).alias("verdict"))


def merge_results(old: DataFrame, new: DataFrame, key: str = "model") -> DataFrame:
    """Old rows whose key is not in `new`, then the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def head_to_head(a: DataFrame, b: DataFrame, names: tuple[str, str], lower_is_better: Sequence[str] = ()) -> DataFrame:
    """(metric, first, second, winner) from two one-row metric frames; equal to 4 digits is a tie."""
    cols = [c for c in a.columns if c in b.columns]

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.round(F.col(c).cast("double"), 4).alias(c) for c in cols]).unpivot([], cols, "metric", name)

    j = long(a, "first").join(F.broadcast(long(b, "second")), "metric")     # one row per metric
    sign = F.when(F.col("metric").isin(list(lower_is_better)), -1).otherwise(1)
    gap = sign * (F.col("first") - F.col("second"))
    return j.withColumn("winner", F.when(gap > 0, names[0]).when(gap < 0, names[1]).when(gap == 0, "Tie"))


def summarise_runs(runs: DataFrame) -> DataFrame:
    """Rank by validation PR-AUC, starting again within each evaluation protocol."""
    order = Window.partitionBy("protocol").orderBy(F.col("val_pr_auc").desc_nulls_last(), "variation")
    return runs.withColumn("rank_by_val", F.row_number().over(order))


def best_run(runs: DataFrame, select_by: str = "val_pr_auc") -> DataFrame:
    """One row: the best run among those of the most common protocol (the first name on a tie)."""
    per = runs.groupBy("protocol").agg(F.count(F.lit(1)).alias("_n"))
    modal = per.orderBy(F.col("_n").desc(), "protocol").limit(1).select("protocol")
    return (runs.join(F.broadcast(modal), "protocol", "left_semi").where(F.col(select_by).isNotNull())
            .orderBy(F.col(select_by).desc(), "variation").limit(1))


class ExperimentLog:
    """The log's sheets as Parquet tables under one folder, in `BUCKETS` partitions by a hash of the run, however many runs there are.

    Adding a `variation` again replaces its rows and leaves the other runs alone; only the buckets of the added runs are written anew.
    """

    SHEETS = ("summary", "configs", "epochs", "diagnostics", "precision_at_k", "full_test")
    BUCKETS = 64

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, sheet: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{sheet}").drop("run_bucket")

    def stored(self, sheet: str) -> DataFrame | None:
        """The sheet with its buckets; None if nothing was put there yet."""
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{sheet}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def put(self, sheet: str, rows: DataFrame) -> DataFrame:
        if sheet not in self.SHEETS:
            raise ValueError(f"unknown sheet {sheet!r}")
        fresh = rows.withColumn("run_bucket", F.pmod(F.xxhash64(F.col("variation").cast("string")), F.lit(self.BUCKETS)).cast("int"))
        old = self.stored(sheet)
        if old is not None:
            fresh = settle(fresh)
            again = fresh.select(F.col("variation").alias("_again"), "run_bucket").distinct()
            touched = [r["run_bucket"] for r in again.select("run_bucket").distinct().collect()]          # at most BUCKETS
            left = old.where(F.col("run_bucket").isin(touched)).join(again.drop("run_bucket"), F.col("variation").eqNullSafe(F.col("_again")), "left_anti")
            fresh = settle(left.unionByName(fresh, allowMissingColumns=True))          # read to its end before its buckets are replaced
        (fresh.hint("rebalance", F.col("run_bucket")).write.partitionBy("run_bucket")
         .option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.folder}/{sheet}"))
        return self.read(sheet)

    def add(self, epochs: DataFrame, configs: DataFrame | None = None, precision_at_k: DataFrame | None = None,
            select_by: str = "pr_auc", limits: Sequence[tuple] = OVERFIT_LIMITS) -> DataFrame:
        """Record runs: gaps per epoch, diagnostics, and a summary read at the best epoch."""
        history = settle(with_gaps(epochs, limits))       # read by three sheets
        diag = settle(diagnose(history, select_by, limits))
        summary = run_summary(history, diag)
        for sheet, rows in (("epochs", history), ("diagnostics", diag), ("configs", configs),
                            ("precision_at_k", precision_at_k), ("summary", summary)):
            if rows is not None:
                self.put(sheet, rows)
        return self.read("summary")


def run_summary(history: DataFrame, diag: DataFrame) -> DataFrame:
    """One row per run: train and validation numbers at the best epoch, divergence and status."""
    at = diag.select("variation", "best_epoch", "stopped_epoch", "divergence_epoch", "n_flagged_epochs", "status")
    rows = history.join(at, "variation").where(F.col("epoch") == F.col("best_epoch"))
    metrics = [c for c in history.columns if c.startswith(("train_", "val_")) or c.endswith("_gap_pct")]
    return rows.select("variation", "best_epoch", "stopped_epoch", "divergence_epoch",
                       F.when(F.col("n_flagged_epochs") > 0, "Yes").otherwise("No").alias("overfitting_triggered"),
                       "status", *metrics)

"""The row-level run: positional features -> target -> split -> impute and scale -> classifier and remaining life."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models, ranking, rowlevel
from ..operators.scaling import Scaling, fit_scaling
from ..operators.splits import grouped_split
from ..session import settle


@dataclass
class RowResult:
    scaling: Scaling
    classifier: models.BoostedFit
    threshold: float
    metrics: DataFrame
    life_metrics: DataFrame


def feature_names(attrs: Sequence[str], lags: Sequence[int], width: int) -> list[str]:
    names = list(attrs) + [f"{a}_d{k}" for k in lags for a in attrs]
    names += [f"{a}_{s}{width}" for a in attrs for s in ("mean", "std", "max")]
    return names + ["window_span_days", "drive_age_days"]


def row_table(readings: DataFrame, attrs: Sequence[str], lags=(7, 30, 90), width: int = 90, horizon: int = 30,
              tolerance: int = 5) -> DataFrame:
    """Rows with a full window behind them, their features, target and split."""
    feats = rowlevel.row_features(rowlevel.with_target(readings, horizon), attrs, lags, width)
    full = feats.where(rowlevel.full_window(width, tolerance))
    split = grouped_split(full.select("drive").distinct(), strata=())
    return full.join(split, "drive").withColumn("label", F.col("target"))


def run_rows(readings: DataFrame, attrs: Sequence[str], lags=(7, 30, 90), width: int = 90, horizon: int = 30,
             life_horizon: int = 60, tolerance: int = 5, exact_medians: bool = False, life_rounds: int = 100, **boosting) -> RowResult:
    names = feature_names(attrs, lags, width)
    table = settle(row_table(readings, attrs, lags, width, horizon, tolerance))
    scaling = fit_scaling(table.where("split = 'train'"), names, exact_medians)
    scaled = settle(scaling.apply(table))
    parts = {s: scaled.where(F.col("split") == s) for s in ("train", "val", "test")}
    fit = models.fit_boosted(parts["train"], parts["val"], names, **boosting)
    val = models.probability(fit.model, parts["val"])
    best = ranking.grid_thresholds(val).where("best = 1").first()
    threshold = float(best["threshold"])
    test = models.probability(fit.model, parts["test"])
    metrics = ranking.confusion(test, threshold, strict=True).crossJoin(
        ranking.ranking_metrics(test).select("roc_auc", "pr_auc"))
    life = rowlevel.remaining_life_rows(scaled, life_horizon)
    regressor = models.fit_remaining_life(life.where("split <> 'test'"), names, rounds=life_rounds)
    predicted = models.predict_life(regressor, life.where("split = 'test'"), life_horizon)
    return RowResult(scaling, fit, threshold, metrics,
                     ranking.regression_metrics(predicted, "days_to_failure", "prediction"))

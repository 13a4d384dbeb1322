"""Impute-and-standardise with saved statistics, and the contract that carries them to serving."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import exact_quantiles
from ..session import settle
from ..settings import OBSERVED, WindowSpec

TINY_STD = 1e-6


@dataclass(frozen=True)
class Scaling:
    """Median, mean and standard deviation per channel, in channel order."""

    channels: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    def rows(self) -> list[tuple[str, float, float, float]]:
        return list(zip(self.channels, self.medians, self.means, self.stds))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per channel."""
        return spark.createDataFrame(self.rows(), "channel string, median double, mean double, std double")

    def apply(self, df: DataFrame) -> DataFrame:
        """(coalesce(x, median) - mean) / std with the saved numbers; nothing is refitted."""
        stats = {c: (m, mu, sd) for c, m, mu, sd in self.rows()}

        def scaled(c: str):
            m, mu, sd = stats[c]
            return ((F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(mu)) / F.lit(sd)).alias(c)

        return df.select(*[scaled(c) if c in stats else F.col(c) for c in df.columns])

    def invert(self, df: DataFrame, log_attrs: Sequence[str] = ()) -> DataFrame:
        """Back to original units; expm1 on log-scaled levels only, never on their differences."""
        stats = {c: (mu, sd) for c, _, mu, sd in self.rows()}

        def raw(c: str):
            mu, sd = stats[c]
            value = F.col(c) * F.lit(sd) + F.lit(mu)
            return (F.expm1(value) if c in log_attrs else value).alias(c)

        return df.select(*[raw(c) if c in stats else F.col(c) for c in df.columns])


def fit_scaling(rows: DataFrame, channels: Sequence[str], exact: bool = True) -> Scaling:
    """Fit on training rows: median (0 if all null), then mean and population std of the imputed values.

    The imputed moments follow from those of the readings that are there and from how many are not, so `exact=False`, which
    sketches the medians, is one pass over the rows; that is the choice for hundreds of billions of them. `observed` is left
    as it is. Only the statistics reach the driver.
    """
    fitted = [c for c in channels if c != OBSERVED]
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in fitted])
    facts = [f(c).alias(f"{tag}_{c}") for c in fitted for tag, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))]
    if exact:
        rows = settle(rows)                                     # the medians and the moments read it
        medians = {r["column"]: r["value"] for r in exact_quantiles(rows, fitted, [0.5]).collect()}
    else:
        facts += [F.percentile_approx(c, 0.5, 10000).alias(f"median_{c}") for c in fitted]
    got = rows.agg(F.count(F.lit(1)).alias("rows"), *facts).first()

    def stats(c: str) -> tuple[float, float, float]:
        median = float((medians.get(c) if exact else got[f"median_{c}"]) or 0.0)
        if not got["rows"]:
            return median, 0.0, 1.0
        share = got[f"n_{c}"] / got["rows"]
        mean, var = (got[f"mean_{c}"], got[f"var_{c}"]) if share else (median, 0.0)
        std = math.sqrt(share * var + share * (1 - share) * (mean - median) ** 2)
        return median, share * mean + (1 - share) * median, 1.0 if std < TINY_STD else std

    found = {c: (0.0, 0.0, 1.0) if c == OBSERVED else stats(c) for c in channels}
    return Scaling(tuple(channels), *[tuple(found[c][i] for c in channels) for i in range(3)])


def fit_window_scaling(dense_train: DataFrame, spec: WindowSpec, exact: bool = True) -> Scaling:
    """Window pipelines fit on observed days only."""
    return fit_scaling(dense_train.where(F.col("observed") == 1), spec.channels, exact)


@dataclass(frozen=True)
class Contract:
    """What serving must repeat: window shape, channels, statistics and threshold."""

    spec: WindowSpec
    scaling: Scaling
    threshold: float
    extra: dict = field(default_factory=dict)

    def to_json(self, dialect: str = "archive") -> str:
        """`archive` names the channels; `cohort` names features and counts the base ones (fixed keys)."""
        doc = {"window_days": self.spec.days, "horizon_days": self.spec.horizon, "stride_days": self.spec.stride,
               "log1p_columns": list(self.spec.log_attrs), "delta_lags": list(self.spec.lags),
               "add_observed_mask": OBSERVED in self.scaling.channels, "best_threshold": self.threshold,
               "feature_medians": list(self.scaling.medians), "feature_mean": list(self.scaling.means),
               "feature_std": list(self.scaling.stds), **self.extra}
        if dialect == "archive":
            doc.update(feature_columns=list(self.spec.attrs), channel_names=list(self.scaling.channels))
        else:
            doc.update(feature_names=list(self.scaling.channels), base_feature_count=len(self.spec.attrs))
        return json.dumps(doc, indent=2)

    @staticmethod
    def from_json(text: str) -> "Contract":
        doc = json.loads(text)
        channels = tuple(doc["channel_names"] if "channel_names" in doc else doc["feature_names"])
        attrs = tuple(doc["feature_columns"]) if "channel_names" in doc else channels[:doc["base_feature_count"]]
        spec = WindowSpec(attrs=attrs, days=int(doc["window_days"]), horizon=int(doc.get("horizon_days", 0)),
                          stride=int(doc.get("stride_days", 1)), min_days=int(doc["window_days"]),
                          lags=tuple(doc["delta_lags"]), log_attrs=tuple(doc["log1p_columns"]))
        want = spec.channels if doc["add_observed_mask"] else tuple(c for c in spec.channels if c != OBSERVED)
        if want != channels:
            raise ValueError(f"the contract names {len(channels)} channels, its settings give {len(want)}")
        scaling = Scaling(channels, *[tuple(float(v) for v in doc[k])
                                      for k in ("feature_medians", "feature_mean", "feature_std")])
        known = {"window_days", "horizon_days", "stride_days", "log1p_columns", "delta_lags", "add_observed_mask",
                 "best_threshold", "feature_medians", "feature_mean", "feature_std", "feature_columns",
                 "channel_names", "feature_names", "base_feature_count"}
        return Contract(spec, scaling, float(doc["best_threshold"]), {k: v for k, v in doc.items() if k not in known})


def save_contract(spark: SparkSession, contract: Contract, path: str, dialect: str = "archive") -> None:
    """One small text file on whatever file system `path` names."""
    spark.createDataFrame([(contract.to_json(dialect),)], "value string").coalesce(1).write.mode("overwrite").text(
        path, lineSep="\u0000")


def load_contract(spark: SparkSession, path: str) -> Contract:
    return Contract.from_json(spark.read.text(path, wholetext=True).first()[0].rstrip("\u0000"))

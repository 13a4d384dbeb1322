"""The archive run: audit -> features -> split -> scaling -> windows -> model -> threshold -> evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import leakage, models, ranking, timeline
from ..operators.calendar import census, dedupe_days, densify, in_parts
from ..operators.features import window_aggregates
from ..operators.scaling import Contract, fit_window_scaling
from ..operators.splits import grouped_split, train_probe
from ..session import settle
from ..settings import LeakageRules, WindowSpec


@dataclass
class ArchiveResult:
    contract: Contract
    fit: models.BoostedFit
    report: leakage.LeakageReport
    coverage: DataFrame
    windows: DataFrame
    test_scores: DataFrame
    metrics: DataFrame
    top: DataFrame
    precision: DataFrame


def days_in_parts(readings: DataFrame) -> DataFrame:
    """One row per (drive, day), settled, and by drive in parts whose number grows with the days."""
    days = settle(dedupe_days(readings))                        # read by the fit and by the windows
    return in_parts(days, days.count())


def features_of_days(days: DataFrame, split: DataFrame, spec: WindowSpec, exact: bool = True, cover: str = "tile"):
    """`window_table` of readings that hold one row per (drive, day)."""
    dense = densify(days, spec, carry=("model",))
    tagged = dense.join(split.select("drive", "split"), "drive")
    scaling = fit_window_scaling(tagged.where("split = 'train'"), spec, exact)
    feats = window_aggregates(scaling.apply(tagged), spec, cover, carry=("model", "split"))
    return scaling, feats


def window_table(readings: DataFrame, split: DataFrame, spec: WindowSpec, exact: bool = True, cover: str = "tile"):
    """(scaling, scaled window features with split). Scaling is fitted on observed training days only."""
    return features_of_days(dedupe_days(readings), split, spec, exact, cover)


def run_archive(readings: DataFrame, spec: WindowSpec, rules: LeakageRules = LeakageRules(),
                categorical: Sequence[str] = (), select: bool = True, exact_medians: bool = False, cover: str = "tile",
                **boosting) -> ArchiveResult:
    """From clean readings to an evaluated model. `cover` is "tile" for archives and "stride" for cohorts
    (with `settings.cohort_spec`). The threshold is frozen on validation before test is scored."""
    readings = settle(readings)                                 # read by every table of the audit and by the run
    report = leakage.audit(readings, spec.attrs, categorical, rules, spec.days)
    if select:
        chosen = leakage.select_features(report)
        spec = replace(spec, attrs=tuple(chosen), log_attrs=tuple(a for a in spec.log_attrs if a in chosen))
    leakage.assert_unblocked(spec.channels, report.blocklist)
    split = settle(grouped_split(census(readings).where(F.col("n_days") >= spec.shortest_record)))
    scaling, feats = features_of_days(days_in_parts(readings), split, spec, exact_medians, cover)
    table = settle(feats)                                       # read by the fit, the threshold and the test
    parts = {s: table.where(F.col("split") == s) for s in ("train", "val", "test")}
    probe = parts["train"].join(train_probe(split).select("drive"), "drive", "left_semi")
    fit = models.fit_boosted(parts["train"], parts["val"], spec.feature_names, probe=probe, **boosting)
    threshold = ranking.best_threshold(models.probability(fit.model, parts["val"])).first()["threshold"]
    scores = settle(models.probability(fit.model, parts["test"]).select(
        "drive", "start", "model", "start_day", "end_day", "label", "score"))
    metrics = ranking.confusion(scores, threshold).crossJoin(       # one row each
        ranking.ranking_metrics(scores).select("roc_auc", "pr_auc"))
    per_drive = ranking.drive_scores(scores)
    return ArchiveResult(
        Contract(spec, scaling, float(threshold)), fit, report, timeline.split_coverage(split, spec), table, scores, metrics,
        ranking.top_drives(per_drive), ranking.precision_at_k(per_drive, ranking.DEFAULT_KS, ["drive"]))

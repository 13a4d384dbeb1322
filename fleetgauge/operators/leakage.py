"""Leakage audit: how well does each column, on its own, give the label away?

All numeric metrics come from one long table of (column, value) counts, so the raw rows are shuffled
once. Rank metrics read running totals inside (column, value bucket) groups; nothing orders a whole
column in one task. The tables joined back hold one row per column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import ratio
from ..functions.order import in_ranges, long_form, running_totals
from ..session import settle
from ..settings import LeakageRules, WindowSpec

SEVERE, SUSPECT, CLEAN = "SEVERE LEAK", "suspect", "clean"
DRIVE_PROBES = ("record_length_days", "still_reporting_at_export_end", "days_from_record_end_to_export_end")
DAY_PROBES = ("days_since_first_record", "days_to_last_record", *DRIVE_PROBES, "calendar_day_index")


def value_counts(rows: DataFrame, columns: Sequence[str], label: str = "failure") -> DataFrame:
    """(column, value, n, pos), NULL values included."""
    return long_form(rows, columns, keep=[label]).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))


def column_association(counts: DataFrame) -> DataFrame:
    """Per column: coverage, n_unique, corr, auc, auc_directional, balanced_acc and the missingness gap."""
    seen = F.col("value").isNotNull()
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")
    stats = counts.groupBy(F.col("column").alias("_c")).agg(
        F.sum("n").alias("_rows"), F.sum("pos").alias("_all_pos"),
        F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("_n"),
        F.coalesce(F.sum(F.when(seen, F.col("pos"))), F.lit(0)).alias("_p"),
        F.count("value").alias("n_unique"),
        (F.sum(F.when(seen, F.col("value") * n)) / F.sum(F.when(seen, n))).alias("_mean"))
    run = running_totals(counts.where(seen), F.col("_range"), [F.col("value")],
                         {"pos": "_cp", "n": "_cn"}, by=["column"])
    p, q = F.col("_p").cast("double"), (F.col("_n") - F.col("_p")).cast("double")
    neg = n - pos
    neg_below = (F.col("_cn") - F.col("n")) - (F.col("_cp") - F.col("pos"))
    x = F.col("value") - F.col("_mean")
    joined = run.join(F.broadcast(stats), F.col("column") == F.col("_c"))
    ranks = joined.groupBy("column").agg(
        F.sum(pos * (neg_below + neg / 2)).alias("_u"),
        F.max(F.abs(ratio(F.col("_cp"), p) - ratio(F.col("_cn") - F.col("_cp"), q))).alias("_ks"),
        F.sum((pos - n * p / F.col("_n")) * x).alias("_xy"), F.sum(n * x * x).alias("_xx"))
    usable = (F.col("n_unique") >= 2) & (p > 0) & (q > 0)
    auc = ratio(F.col("_u"), p * q)
    n_null, pos_null = F.col("_rows") - F.col("_n"), F.col("_all_pos") - F.col("_p")
    none_null = n_null == 0
    if_fail = F.when(none_null, 0.0).otherwise(ratio(pos_null, F.col("_all_pos")))
    if_healthy = F.when(none_null, 0.0).otherwise(ratio(n_null - pos_null, F.col("_rows") - F.col("_all_pos")))
    return (stats.join(F.broadcast(ranks), F.col("column") == F.col("_c"), "left").select(
        F.col("_c").alias("column"), ratio(F.col("_n"), F.col("_rows")).alias("coverage"), "n_unique",
        F.when(usable, ratio(F.col("_xy"), F.sqrt(F.col("_xx") * p * q / F.col("_n")))).alias("corr"),
        F.when(usable, auc).alias("auc"),
        F.when(usable, F.greatest(auc, 1 - auc)).alias("auc_directional"),
        F.when(usable, (1 + F.col("_ks")) / 2).alias("balanced_acc"),
        ratio(n_null, F.col("_rows")).alias("null_rate"), if_fail.alias("null_if_failure"),
        if_healthy.alias("null_if_healthy"), (if_fail - if_healthy).alias("missing_gap")))


def _verdict(rules: LeakageRules, have: set[str]) -> tuple[Column, Column]:
    def metric(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("double")

    auc, bal, lift = metric("auc_directional"), metric("balanced_acc"), metric("max_lift")
    corr, gap = F.abs(metric("corr")), F.abs(metric("missing_gap"))
    tests = [
        (SEVERE, auc, rules.severe_auc, "rank AUC"), (SEVERE, bal, rules.severe_balanced_acc, "balanced accuracy"),
        (SEVERE, corr, rules.severe_corr, "point-biserial r"), (SEVERE, gap, rules.severe_gap, "missingness gap"),
        (SEVERE, lift, rules.severe_lift, "level lift"), (SUSPECT, auc, rules.suspect_auc, "rank AUC"),
        (SUSPECT, gap, rules.suspect_gap, "missingness gap"), (SUSPECT, lift, rules.suspect_lift, "level lift")]
    verdict = reason = None
    for level, value, limit, text in tests:
        why = F.concat(F.lit(f"{text} "), F.round(value, 3).cast("string"))
        verdict = F.when(value >= limit, level) if verdict is None else verdict.when(value >= limit, level)
        reason = F.when(value >= limit, why) if reason is None else reason.when(value >= limit, why)
    return verdict.otherwise(CLEAN), reason.otherwise("")


def with_verdict(report: DataFrame, rules: LeakageRules = LeakageRules()) -> DataFrame:
    """Add `verdict` and `reason`; the first rule that fires wins and NULL metrics never fire."""
    verdict, reason = _verdict(rules, set(report.columns))
    return report.withColumn("verdict", verdict).withColumn("reason", reason)


def audit_numeric(rows: DataFrame, columns: Sequence[str], label: str = "failure",
                  rules: LeakageRules = LeakageRules(), level: str = "drive-day") -> DataFrame:
    report = column_association(in_ranges(value_counts(rows, columns, label), [F.col("value")], ["column"])).withColumn("level", F.lit(level))
    return with_verdict(report, rules)


def level_counts(rows: DataFrame, columns: Sequence[str], label: str = "failure") -> DataFrame:
    """(column, level, n, pos, missing); a missing value is a level of its own."""
    def text(c: str) -> Column:
        blank = "-1" if isinstance(rows.schema[c].dataType, T.NumericType) else "<NA>"
        return F.coalesce(F.col(c).cast("string"), F.lit(blank))

    filled = rows.select(F.col(label).cast("bigint").alias("_y"), *[text(c).alias(c) for c in columns],
                         *[F.col(c).isNull().cast("bigint").alias(f"_m_{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("level"), F.col(f"_m_{c}").alias("m"))
                      for c in columns])
    return (filled.select("_y", F.explode(pairs).alias("p")).groupBy("p.column", "p.level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"), F.sum("p.m").alias("n_null"),
        F.sum(F.col("p.m") * F.col("_y")).alias("pos_null")))


def categorical_association(counts: DataFrame, min_support: int) -> DataFrame:
    """Per column: cardinality, Cramer's V, highest lift of a supported level, missingness gap."""
    stats = counts.groupBy(F.col("column").alias("_c")).agg(
        F.sum("n").cast("double").alias("_n"), F.sum("pos").cast("double").alias("_p"),
        F.sum("n_null").alias("_nn"), F.sum("pos_null").alias("_np"),
        F.count(F.lit(1)).alias("_levels"),
        F.sum((F.col("n") > F.col("n_null")).cast("bigint")).alias("cardinality"))
    j = counts.join(F.broadcast(stats), F.col("column") == F.col("_c"))
    n, p, total, fails = F.col("n"), F.col("pos"), F.col("_n"), F.col("_p")
    e1, e0 = n * fails / total, n * (total - fails) / total
    tiny = F.lit(1e-12)
    chi = (F.pow(p - e1, 2) / F.greatest(e1, tiny)) + (F.pow(n - p - e0, 2) / F.greatest(e0, tiny))
    lift = F.when(n >= min_support, ratio(ratio(p, n), ratio(fails, total)))
    got = j.groupBy("column").agg(F.sum(chi).alias("_chi"), F.max(lift).alias("max_lift"),
                                  *[F.max(c).alias(c) for c in ("_n", "_p", "_nn", "_np", "_levels", "cardinality")])
    flat = (F.col("_levels") < 2) | (fails == 0) | (fails == total)
    none = F.col("_nn") == 0
    if_fail = F.when(none, 0.0).otherwise(ratio(F.col("_np"), fails))
    if_healthy = F.when(none, 0.0).otherwise(ratio(F.col("_nn") - F.col("_np"), total - fails))
    return got.select("column", "cardinality", F.when(flat, 0.0).otherwise(F.sqrt(F.col("_chi") / total)).alias("cramers_v"),
                      "max_lift", ratio(F.col("_nn"), total).alias("null_rate"), if_fail.alias("null_if_failure"),
                      if_healthy.alias("null_if_healthy"), (if_fail - if_healthy).alias("missing_gap"))


def audit_categorical(rows: DataFrame, columns: Sequence[str], label: str = "failure",
                      rules: LeakageRules = LeakageRules()) -> DataFrame:
    got = categorical_association(level_counts(rows, columns, label), rules.min_support)
    return with_verdict(got.withColumn("level", F.lit("drive-day")), rules)


def record_geometry(readings: DataFrame) -> DataFrame:
    """Readings plus the six columns that record boundaries would allow a careless feature step to build.

    The boundaries are aggregated and joined back, so no task has to hold all rows of a drive.
    """
    bounds = readings.groupBy("drive").agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    edges = readings.agg(F.min("day").alias("_start"), F.max("day").alias("_end"))      # one row
    r = readings.join(bounds, "drive").crossJoin(F.broadcast(edges))
    return r.select(
        *readings.columns,
        F.datediff("day", "_first").alias("days_since_first_record"),
        F.datediff("_last", "day").alias("days_to_last_record"),
        (F.datediff("_last", "_first") + 1).alias("record_length_days"),
        (F.col("_last") == F.col("_end")).cast("int").alias("still_reporting_at_export_end"),
        F.datediff("_end", "_last").alias("days_from_record_end_to_export_end"),
        F.datediff("day", "_start").alias("calendar_day_index"))


def audit_geometry(readings: DataFrame, rules: LeakageRules = LeakageRules()) -> DataFrame:
    """The probes scored per drive-day, and the three per-drive constants against "ever failed"."""
    geo = settle(record_geometry(settle(readings.select("drive", "day", "failure"))).drop("day"))       # read by both audits
    per_drive = geo.groupBy("drive").agg(F.max("failure").alias("failure"), *[F.max(c).alias(c) for c in DRIVE_PROBES])
    return (audit_numeric(geo, DAY_PROBES, rules=rules, level="per drive-day")
            .unionByName(audit_numeric(per_drive, DRIVE_PROBES, rules=rules, level="per drive")))


def per_drive_summary(readings: DataFrame, window_days: int = 90) -> DataFrame:
    """Span, observed days, gap days, coverage, ever failed and windows on offer."""
    got = readings.groupBy("drive").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n_observed"),
        F.max("failure").alias("ever_failed"), *([F.min_by("model", "day").alias("model")] if "model" in readings.columns else []))
    span = F.datediff("last_day", "first_day") + 1
    return (got.withColumn("span_days", span)
            .withColumn("gap_days", F.col("span_days") - F.col("n_observed"))
            .withColumn("coverage", F.col("n_observed") / F.col("span_days"))
            .withColumn("n_windows", F.greatest(F.col("span_days") - window_days + 1, F.lit(0))))


@dataclass
class LeakageReport:
    """Four tables and the names no feature may be built from."""

    numeric: DataFrame
    categorical: DataFrame | None
    geometry: DataFrame
    drives: DataFrame
    blocklist: list[str] = field(default_factory=list)
    rules: LeakageRules = field(default_factory=LeakageRules)

    def verdicts(self) -> DataFrame:
        parts = [t.select("column", "level", "verdict", "reason",
                          (F.col("auc_directional") if "auc_directional" in t.columns else F.lit(None).cast("double"))
                          .alias("auc_directional"))
                 for t in (self.numeric, self.categorical, self.geometry) if t is not None]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def audit(readings: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
          rules: LeakageRules = LeakageRules(), window_days: int = 90) -> LeakageReport:
    """The whole audit. Tables hold one row per column, so collecting the names is safe."""
    categorical = [c for c in categorical if c != "model"]
    report = LeakageReport(
        audit_numeric(readings, numeric, rules=rules),
        audit_categorical(readings, categorical, rules=rules) if categorical else None,
        audit_geometry(readings, rules), per_drive_summary(readings, window_days), rules=rules)
    named = report.verdicts().where(F.col("verdict") != CLEAN).select("column").distinct().collect()
    report.blocklist = sorted({r["column"] for r in named} | {"drive", "day", "failure"})
    return report


def candidate_features(numeric: DataFrame, blocked: Sequence[str], rules: LeakageRules = LeakageRules(),
                       suffix: str = "") -> DataFrame:
    """Columns fit to be features, strongest first."""
    return (numeric.where(F.col("column").endswith(suffix) & (F.col("coverage") >= rules.min_coverage)
                          & (F.col("n_unique") >= rules.min_unique) & ~F.col("column").isin(list(blocked)))
            .orderBy(F.col("auc_directional").desc_nulls_last(), "column"))


def select_features(report: LeakageReport, suffix: str = "") -> list[str]:
    chosen = [r["column"] for r in candidate_features(report.numeric, report.blocklist, report.rules, suffix).collect()]
    assert_unblocked(chosen, report.blocklist)
    return chosen


def assert_unblocked(names: Sequence[str], blocklist: Sequence[str]) -> None:
    """Refuse a feature that is a blocked column or is derived from one (`<blocked>_...`)."""
    bad = [n for n in names for b in blocklist if n == b or n.startswith(f"{b}_")]
    if bad:
        raise ValueError(f"leaking features: {sorted(set(bad))}")


def ranked_view(report: DataFrame, by: str, n: int, absolute: bool = False) -> DataFrame:
    key = F.abs(F.col(by)) if absolute else F.col(by)
    return report.orderBy(key.desc_nulls_last(), "column").limit(n)


def flagged(verdicts: DataFrame, verdict: str) -> DataFrame:
    """Worst row per column for a verdict; a column that is severe anywhere is not listed as suspect."""
    best = Window.partitionBy("column").orderBy(F.col("auc_directional").desc_nulls_last(), "level")
    hit = verdicts.where(F.col("verdict") == verdict)
    if verdict == SUSPECT:
        hit = hit.join(verdicts.where(F.col("verdict") == SEVERE).select("column").distinct(), "column", "left_anti")
    return hit.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def label_invariance(build, readings: DataFrame, seed: int = 42) -> DataFrame:
    """One row: windows built, and windows that change when every label is replaced by noise (must be 0).

    `build` maps readings to a feature table without label columns.
    """
    from ..functions.expr import draw
    noise = readings.withColumn("failure", (F.pmod(draw(F.lit(seed), F.col("drive"), F.col("day")), F.lit(2)) == 1).cast("int"))
    real, fake = build(readings), build(noise)
    gone = real.exceptAll(fake).agg(F.count(F.lit(1)).alias("lost"))
    new = fake.exceptAll(real).agg(F.count(F.lit(1)).alias("gained"))
    return real.agg(F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(gone)).crossJoin(F.broadcast(new))


def verify_no_label(readings: DataFrame, spec: WindowSpec, rules: LeakageRules = LeakageRules(), seed: int = 42) -> DataFrame:
    """The whole proof that the label cannot be read out of the windows; raises when a check fails.

    No channel is named after the label, window features do not move when labels become noise, and no
    channel's last value separates the window label at `severe_auc`. Returns the channel scores.
    """
    from .calendar import densify
    from .features import window_aggregates

    named = [c for c in spec.channels if "fail" in c.lower()]
    if named:
        raise ValueError(f"channels named after the label: {named}")

    def build(rows: DataFrame) -> DataFrame:
        return window_aggregates(densify(rows, spec), spec, "tile").select("drive", "start", *spec.feature_names)

    moved = label_invariance(build, readings, seed).first()
    if moved["lost"] or moved["gained"]:
        raise ValueError(f"{moved['lost']} windows changed with the labels")
    last = settle(window_aggregates(densify(readings, spec), spec, "tile", aggregates=("last",)))
    scores = audit_numeric(last, [f"{c}__last" for c in spec.channels], "label", rules, "window")
    worst = scores.agg(F.max("auc_directional")).first()[0]
    if worst is not None and worst >= rules.severe_auc:
        raise ValueError(f"a channel separates the label at AUC {worst:.3f}")
    return scores

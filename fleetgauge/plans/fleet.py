"""Score a fleet file: headers -> coercion -> eligibility -> latest windows -> ranked list."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clean_number
from ..functions.order import score_rank
from ..operators import ranking
from ..operators.calendar import dedupe_days, densify
from ..operators.features import window_aggregates
from ..operators.models import Scorer
from ..operators.scaling import Contract
from ..session import settle
from ..settings import WindowSpec
from ..sources.uploads import canonical_headers

TOP_ROWS = 500
TRAJECTORY_DAYS = 45


@dataclass
class FleetResult:
    """Everything one scoring run answers, as frames. `rows` is the whole ranked fleet."""

    rows: DataFrame
    skipped: DataFrame
    diagnostics: DataFrame
    summary: DataFrame
    agreement: DataFrame | None
    quality: DataFrame | None
    notes: list[str]

    def top(self, n: int = TOP_ROWS) -> DataFrame:
        return self.rows.orderBy("rank").limit(n)


def padded_floor(window_days: int) -> int:
    """Fewest days a padded drive must have."""
    return max(10, window_days // 3)


def coerce_upload(df: DataFrame, attrs) -> tuple[DataFrame, list[str], list[str]]:
    """Canonical readings from any upload, header notes, and the attributes it lacks (they become NULL)."""
    named, notes = canonical_headers(df)
    lacking = [k for k in ("serial_number", "date") if k not in named.columns]
    if lacking:
        raise ValueError(f"the file has no {' or '.join(lacking)} column; it has {named.columns[:12]}")
    absent = [a for a in attrs if a.lower() not in named.columns]
    failure = F.coalesce(clean_number("failure").cast("int"), F.lit(0)) if "failure" in named.columns else F.lit(0)
    model = F.col("model") if "model" in named.columns else F.lit(None).cast("string")
    rows = named.select(
        F.col("serial_number").cast("string").alias("drive"),
        F.to_date(F.try_to_timestamp(F.col("date").cast("string"))).alias("day"), failure.alias("failure"), model.alias("model"),
        *[(F.lit(None).cast("double") if a in absent else clean_number(a.lower())).alias(a) for a in attrs])
    return rows.dropna(subset=["drive", "day"]), notes, absent


def serving_spec(contract: Contract, pad_short: bool) -> WindowSpec:
    days = contract.spec.days
    return replace(contract.spec, pad_short=pad_short, min_days=padded_floor(days) if pad_short else days)


def drive_spans(readings: DataFrame) -> DataFrame:
    return readings.groupBy("drive").agg(
        (F.datediff(F.max("day"), F.min("day")) + 1).alias("days"), F.count(F.lit(1)).alias("readings"),
        F.max("model").alias("model"), F.max("failure").alias("recorded_failure"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def eligibility(readings: DataFrame, floor: int) -> tuple[DataFrame, DataFrame]:
    """(drives that offer a window, drives that are too short)."""
    spans = drive_spans(readings)
    return spans.where(F.col("days") >= floor), spans.where(F.col("days") < floor).select("drive", "days")


def latest_features(readings: DataFrame, contract: Contract, pad_short: bool = True) -> DataFrame:
    """One scaled, window-long feature row per eligible drive, ending on its last day."""
    spec = serving_spec(contract, pad_short)
    dense = densify(dedupe_days(readings), spec)
    return window_aggregates(contract.scaling.apply(dense), spec, "latest", channels=contract.scaling.channels)


def score_fleet(df: DataFrame, contract: Contract, scorers: dict[str, tuple[Scorer, float]],
                pad_short: bool = True) -> FleetResult:
    """Rank every drive of an upload. `scorers`: name -> (scorer that adds column `name`, threshold);
    the first one is primary."""
    readings, notes, absent = coerce_upload(df, contract.spec.attrs)
    spec = serving_spec(contract, pad_short)
    good, short = eligibility(readings, spec.min_days)
    scored = latest_features(readings, contract, pad_short)
    for scorer, _ in scorers.values():
        scored = scorer(scored)
    about = good.select("drive", "model", "recorded_failure", F.col("days").alias("days_available"))
    keep = ["drive", "start_day", "end_day", "n_real", "n_filled", "n_padded", *scorers]
    calls = [F.when(F.col(n) >= t, "inspect").otherwise("hold").alias(f"call_{n}") for n, (_, t) in scorers.items()]
    # Ranks, summaries and quality all read this table.
    table = settle(scored.select(*keep).join(about, "drive").select("*", *calls))
    primary = next(iter(scorers))
    rows = score_rank(table, primary, [F.col("drive")])
    names = list(scorers)
    agree = None
    if len(names) > 1:
        a, b = names[:2]
        agree = ranking.agreement(table, scorers[a][1], scorers[b][1], a, b)
    truth = table.select("drive", F.col("recorded_failure").alias("label"), F.col(primary).alias("score"))
    return FleetResult(rows, short, diagnostics(readings, good, table, absent, contract), call_summary(table, names), agree,
                       ranking.ranking_quality(truth), notes)


def diagnostics(readings: DataFrame, good: DataFrame, scored: DataFrame, absent, contract: Contract) -> DataFrame:
    """One row: what the file held and what became of it."""
    spans = drive_spans(readings).agg(
        F.sum("readings").alias("rows"), F.count(F.lit(1)).alias("drives_in_file"), F.min("first_day").alias("date_min"),
        F.max("last_day").alias("date_max"), F.max("recorded_failure").alias("has_truth"))
    done = scored.agg(F.count(F.lit(1)).alias("drives_scored"),
                      F.coalesce(F.sum((F.col("n_padded") > 0).cast("bigint")), F.lit(0)).alias("drives_padded"))
    found = [a for a in contract.spec.attrs if a not in absent]
    return spans.crossJoin(F.broadcast(done)).select(                     # one row each
        "*", (F.col("drives_in_file") - F.col("drives_scored")).alias("drives_skipped"),
        F.lit(",".join(found)).alias("attributes_found"), F.lit(",".join(absent)).alias("attributes_missing"))


def call_summary(scored: DataFrame, names) -> DataFrame:
    """Per model: drives to inspect, drives to hold, highest risk."""
    def n(c: str, call: str):
        return F.coalesce(F.sum((F.col(f"call_{c}") == call).cast("bigint")), F.lit(0))

    one = scored.agg(*[F.struct(F.lit(c).alias("scorer"), n(c, "inspect").alias("inspect"), n(c, "hold").alias("hold"),
                                F.max(c).alias("max_risk")).alias(c) for c in names])
    return one.select(F.explode(F.array(*names)).alias("s")).select("s.*")


def latest_values(readings: DataFrame, attrs, days: int) -> DataFrame:
    """Per drive: the last non-null value of each attribute among its last `days` readings."""
    from ..operators.windows import last_days
    recent = last_days(readings, days)
    return recent.groupBy("drive").agg(
        F.count(F.lit(1)).alias("readings"),
        *[F.max_by(a, F.when(F.col(a).isNotNull(), F.col("day"))).alias(a) for a in attrs])


def trajectory(readings: DataFrame, contract: Contract, scorer: Scorer, days: int = TRAJECTORY_DAYS,
               pad_short: bool = True) -> DataFrame:
    """(drive, end_day, score...) with the window slid back a day at a time, at most `days` times."""
    spec = replace(serving_spec(contract, pad_short), stride=1)
    dense = contract.scaling.apply(densify(dedupe_days(readings), spec))
    # Older days feed no window of the trajectory.
    recent = dense.where(F.col("pos") >= F.col("n_days") - spec.days - days + 1)
    feats = window_aggregates(recent, spec, "stride", channels=contract.scaling.channels)
    wanted = feats.where(F.col("start") >= F.greatest(F.col("n_days") - spec.days, F.lit(0)) - days + 1)
    return scorer(wanted)

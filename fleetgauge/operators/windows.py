"""Fixed-length windows: enumeration, labels, random draws, padding and tiling.

Starts are arithmetic over the census (one row per drive), so no dense row is read to place or
label a window. A drive's failure positions ride along as a small array (at most one entry per
calendar day), which turns the interval label into a per-row expression with no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import draw, unit_draw
from ..functions.order import grouped_hash_order
from ..settings import SEED, WindowSpec
from .calendar import SO_FAR, by_drive, census

MAX_START = "max_start"


def with_max_start(drives: DataFrame, spec: WindowSpec) -> DataFrame:
    return (drives.where(F.col("n_days") >= spec.shortest_record)
            .withColumn(MAX_START, F.greatest(F.col("n_days") - spec.days, F.lit(0))))


def label_at(start: Column, spec: WindowSpec) -> Column:
    """1 when some failure position lies in [start, start + days - 1 + horizon]."""
    return F.exists("fail_pos", lambda f: (f >= start) & (f <= start + spec.reach)).cast("int")


def enumerate_windows(drives: DataFrame, spec: WindowSpec) -> DataFrame:
    """Every `stride`-th start; with `include_last` the final start is always added."""
    d = with_max_start(drives, spec)
    starts = F.sequence(F.lit(0), F.col(MAX_START), F.lit(spec.stride))
    if spec.include_last:
        starts = F.array_union(starts, F.array(F.col(MAX_START)))
    return _labelled(d.withColumn("start", F.explode(starts)), spec)


def tile_windows(drives: DataFrame, spec: WindowSpec) -> DataFrame:
    """ceil(n_days / days) windows that cover the record; the last is pulled back to end on its last day."""
    d = with_max_start(drives, spec)
    tiles = F.sequence(F.lit(0), F.ceil(F.col("n_days") / spec.days).cast("int") - 1)
    return _labelled(d.withColumn("tile", F.explode(tiles))
                     .withColumn("start", F.least(F.col("tile") * spec.days, F.col(MAX_START))), spec)


def _labelled(windows: DataFrame, spec: WindowSpec) -> DataFrame:
    return windows.withColumn("label", label_at(F.col("start"), spec))


def label_by_join(windows: DataFrame, failures: DataFrame, spec: WindowSpec) -> DataFrame:
    """The same label as an interval join: equal drive, failure inside the reach of the window."""
    w, f = windows.alias("w"), failures.alias("f")
    inside = F.col("f.fail_pos").between(F.col("w.start"), F.col("w.start") + spec.reach)
    hit = (w.join(f, (F.col("w.drive") == F.col("f.drive")) & inside, "left_semi")
           .select("drive", "start").withColumn("label", F.lit(1)))
    return windows.drop("label").join(hit, ["drive", "start"], "left").fillna(0, ["label"])


def paint_labels(drives: DataFrame, spec: WindowSpec) -> DataFrame:
    """Labels by marking, per failure, the run of strided starts it reaches (work follows failures)."""
    d = with_max_start(drives, spec)
    f = F.col("fail")
    low = F.ceil(F.greatest(f - spec.reach, F.lit(0)) / spec.stride).cast("int")
    high = F.floor(F.least(f, F.col(MAX_START)) / spec.stride).cast("int")
    return (d.select("drive", MAX_START, F.explode("fail_pos").alias("fail"))
            .withColumn("low", low).withColumn("high", high).where("low <= high")
            .select("drive", F.explode(F.sequence("low", "high")).alias("k"))
            .distinct().select("drive", (F.col("k") * spec.stride).alias("start")))


def positive_starts(drives: DataFrame, spec: WindowSpec) -> DataFrame:
    """Distinct starts of positive windows: the union over failures of [f - reach, f] within bounds."""
    d = with_max_start(drives, spec).where(F.size("fail_pos") > 0)
    low = F.greatest(F.col("fail") - spec.reach, F.lit(0))
    high = F.least(F.col("fail"), F.col(MAX_START))
    return (d.select("drive", MAX_START, F.explode("fail_pos").alias("fail"))
            .where(low <= high)
            .select("drive", F.explode(F.sequence(low, high)).alias("start")).distinct())


def negative_starts(drives: DataFrame, spec: WindowSpec) -> DataFrame:
    """Every start that is not positive."""
    d = with_max_start(drives, spec)
    return (d.withColumn("start", F.explode(F.sequence(F.lit(0), F.col(MAX_START))))
            .where(label_at(F.col("start"), spec) == 0).select("drive", "start"))


def _below(r: Column, n: Column) -> Column:
    """A draw folded into [0, n); NULL when there is nothing to pick from."""
    return F.pmod(r, F.when(n > 0, n).cast("bigint"))


def _array_pick(values: Column, r: Column) -> Column:
    return F.element_at(values, (_below(r, F.size(values)) + 1).cast("int"))


def random_windows(drives: DataFrame, spec: WindowSpec, per_drive: int = 1, epoch: int = 0,
                   positive_ratio: float | None = None, otherwise: str = "any", seed: int = SEED) -> DataFrame:
    """`per_drive` replayable windows per drive and epoch.

    With `positive_ratio` a failing drive is forced, with that probability, onto a start that
    reaches one of its failures. Otherwise the start is drawn from all starts (`otherwise="any"`)
    or from the negative ones (`otherwise="negative"`; a drive without any keeps a positive).
    """
    d = with_max_start(drives, spec)
    draws = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_drive - 1))))
    key = (F.lit(seed), F.lit(epoch), F.col("drive"), F.col("i"))
    uniform = _below(draw(*key, F.lit("start")), F.col(MAX_START) + 1).cast("int")
    if positive_ratio is None:
        return _labelled(draws.withColumn("start", uniform), spec).select(
            "drive", "i", "start", "label", "n_days", MAX_START, "first_day")
    fail = _array_pick(F.col("fail_pos"), draw(*key, F.lit("failure")))
    low = F.greatest(fail - spec.reach, F.lit(0))
    high = F.least(fail, F.col(MAX_START))
    near = (low + _below(draw(*key, F.lit("near")), high - low + 1)).cast("int")
    forced = (unit_draw(*key, F.lit("force")) < positive_ratio) & (F.size("fail_pos") > 0) & (low <= high)
    fallback = uniform
    if otherwise == "negative":
        every = F.sequence(F.lit(0), F.col(MAX_START))
        negative = F.filter(every, lambda s: ~F.exists("fail_pos", lambda f: (f >= s) & (f <= s + spec.reach)))
        picked = _array_pick(negative, draw(*key, F.lit("start")))
        fallback = F.when(F.size("fail_pos") == 0, uniform).when(F.size(negative) > 0, picked).otherwise(near)
    # Exploding the one value keeps its lambda out of filters that Spark may infer for later joins on start.
    chosen = F.explode(F.array(F.when(forced, near).otherwise(fallback)))
    return _labelled(draws.withColumn("start", chosen), spec).select(
        "drive", "i", "start", "label", "n_days", MAX_START, "first_day")


def latest_windows(drives: DataFrame, spec: WindowSpec) -> DataFrame:
    """Each drive's window that ends on its last day."""
    return _labelled(with_max_start(drives, spec).withColumn("start", F.col(MAX_START)), spec)


def trailing_windows(drives: DataFrame, spec: WindowSpec, n: int) -> DataFrame:
    """The last `n` starts per drive, with the day each window ends on."""
    d = with_max_start(drives, spec)
    starts = F.sequence(F.greatest(F.col(MAX_START) - (n - 1), F.lit(0)), F.col(MAX_START))
    return _labelled(d.withColumn("start", F.explode(starts)), spec).withColumn(
        "end_day", F.date_add("first_day", F.least(F.col("start") + spec.days, F.col("n_days")) - 1))


def window_dates(windows: DataFrame, spec: WindowSpec) -> DataFrame:
    """First and last calendar day of each window, clamped to the record."""
    last = F.least(F.col("start") + spec.days, F.col("n_days")) - 1
    return (windows.withColumn("start_day", F.date_add("first_day", F.col("start")))
            .withColumn("end_day", F.date_add("first_day", last)))


def window_days(windows: DataFrame, dense: DataFrame, spec: WindowSpec, cols: list[str]) -> DataFrame:
    """Dense rows of each window: an equi-join on (drive, 30-day style block), never all pairs.

    A window touches at most two blocks of its own length, so it is emitted twice, and each dense
    row meets only the windows of its own block.
    """
    block = F.floor(F.col("start") / spec.days)
    touched = F.array_distinct(F.array(block, F.floor((F.col("start") + spec.days - 1) / spec.days)))
    w = windows.withColumn("_block", F.explode(touched))
    d = dense.select(F.col("drive").alias("_d"), "pos", *cols,
                     F.floor(F.col("pos") / spec.days).alias("_b"))
    on = (F.col("drive") == F.col("_d")) & (F.col("_block") == F.col("_b"))
    inside = F.col("pos").between(F.col("start"), F.col("start") + spec.days - 1)
    return w.join(d, on & inside).drop("_d", "_b", "_block")


def as_of(marks: DataFrame, dense: DataFrame, counted: str) -> DataFrame:
    """`marks` (drive, at, ...) with `seen`: the sum of `counted` over a drive's days up to and including `at`.

    Days and marks lie in one order by drive, and a running sum is picked up at each mark: a merge, which
    shuffles the calendar by drive as its own windows do, and not once more by position.
    """
    rest = F.struct(*[c for c in marks.columns if c not in ("drive", "at")])
    own = dense.select("drive", F.col("pos").alias("at"), F.lit(0).alias("_kind"), F.col(counted).alias("_n"))
    both = own.unionByName(marks.select("drive", "at", F.lit(1).alias("_kind"), F.lit(0).cast(dense.schema[counted].dataType).alias("_n"), rest.alias("_mark")),
                           allowMissingColumns=True)
    run = F.coalesce(F.sum("_n").over(by_drive("at", "_kind").rowsBetween(*SO_FAR)), F.lit(0))
    return both.withColumn("seen", run).where("_kind = 1").select("drive", "at", "_mark.*", "seen")


def window_metadata(windows: DataFrame, dense: DataFrame, spec: WindowSpec) -> DataFrame:
    """Dates, real / filled / padded day counts and the offset of the first failure at or after the start, per window.

    The real-day count is a difference of two running counts read at the window's ends, so a
    window costs two lookups instead of `days` rows.
    """
    keys = [c for c in windows.columns if c not in ("drive", "fail_pos")]
    last = F.least(F.col("start") + spec.days, F.col("n_days")) - 1
    window = F.struct(*keys, *[c for c in windows.columns if c == "fail_pos"], last.alias("_last"))
    ends = windows.select("drive", window.alias("w"), F.explode(F.array(
        F.struct(last.cast("int").alias("at"), F.lit(1).alias("sign")),
        F.struct((F.col("start") - 1).cast("int").alias("at"), F.lit(-1).alias("sign")))).alias("e")).select("drive", "e.at", "e.sign", "w")
    real = as_of(ends, dense, "observed").groupBy("drive", "w").agg(F.sum(F.col("sign") * F.col("seen")).cast("bigint").alias("n_real")).select("drive", "w.*", "n_real")
    take = F.col("_last") - F.col("start") + 1
    offset = F.when(F.col("label") == 1, F.array_min(F.filter("fail_pos", lambda f: f >= F.col("start"))) - F.col("start")).otherwise(F.lit(-1))
    return window_dates(real, spec).select(
        *[c for c in windows.columns if c != "fail_pos"], "start_day", "end_day", "n_real", (take - F.col("n_real")).alias("n_filled"),
        (F.lit(spec.days) - take).alias("n_padded"), offset.alias("failure_offset"))


def tile_coverage(drives: DataFrame, spec: WindowSpec) -> DataFrame:
    """Per drive: tiles needed, days they cover, and the overlap of the last tile."""
    d = with_max_start(drives, spec)
    n = F.ceil(F.col("n_days") / spec.days)
    return d.select("drive", "n_days", n.alias("windows"), (n * spec.days).alias("days_covered"),
                    (n * spec.days - F.col("n_days")).alias("overlap_days"))


def shuffled_tiles(drives: DataFrame, spec: WindowSpec, epoch: int = 0, block: int = 32, seed: int = SEED) -> DataFrame:
    """Tiles in a replayable per-epoch order: blocks of neighbouring drives shuffled, each kept together.

    Drives with text ids have no neighbours by number; 4,096 cells of their hash are their blocks.

    `seq` is the 0-based place in the stream, found from per-block totals without a global sort.
    """
    text = dict(drives.dtypes)["drive"] == "string"
    cell = draw("block", F.col("drive")) % 4096 if text else F.floor(F.col("drive") / block)
    tiles = tile_windows(drives, spec).withColumn("block", cell)
    return grouped_hash_order(tiles, "block", ["drive", "start"], (seed, epoch))


def last_days(readings: DataFrame, lengths: DataFrame | int) -> DataFrame:
    """The last n readings of each drive; `lengths` is one n or a (drive, n) frame."""
    rows = readings.withColumn("_back", F.row_number().over(by_drive(F.col("day").desc())))
    if isinstance(lengths, int):
        return rows.where(F.col("_back") <= lengths).drop("_back")
    return rows.join(lengths, "drive").where(F.col("_back") <= F.col("n")).drop("_back", "n")


def snapshot(readings: DataFrame, spec: WindowSpec, slack: int = 2) -> DataFrame:
    """Drives alive within `slack` days of the newest day, cut to one shared window that ends there."""
    newest = readings.agg(F.max("day").alias("_asof"))           # one row
    alive = (census(readings).where(F.col("n_days") >= spec.days)
             .join(F.broadcast(newest), F.col("last_day") >= F.date_sub("_asof", slack)).select("drive"))
    recent = (readings.join(F.broadcast(newest), F.col("day") > F.date_sub("_asof", spec.days))
              .drop("_asof"))
    return recent.join(alive, "drive", "left_semi")


def spread_picks(ranked: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """k rows evenly spread over a 1-based ranking, first and last included (the floor of a linspace)."""
    n = ranked.agg(F.max(rank).alias("_n"))                       # one row
    at = F.floor(F.col("_i") * (F.col("_n") - 1) / F.lit(float(max(k - 1, 1)))) + 1
    picks = n.select("_n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_i")).select(at.alias(rank)).distinct()
    return ranked.join(F.broadcast(picks), rank, "left_semi")

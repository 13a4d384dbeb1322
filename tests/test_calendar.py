"""Hand-computed frames: dedupe, gaps, fills, windows and labels."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import calendar as cal
from fleetgauge.operators import features, windows
from fleetgauge.settings import WindowSpec

SPEC = WindowSpec(attrs=("a",), days=3, horizon=1, min_days=1, lags=(1, 2))


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def frame(spark, rows):
    return spark.createDataFrame([(d, day(n), f, a) for d, n, f, a in rows], "drive bigint, day date, failure int, a double")


def by_pos(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("drive", "pos").collect()]


def test_failure_row_wins_a_duplicate_day(spark):
    df = frame(spark, [(1, 0, 0, 5.0), (1, 0, 1, 3.0), (1, 1, 0, 1.0), (1, 1, 0, 2.0)])
    got = {(r.day, r.failure, r.a) for r in cal.dedupe_days(df, ["a"]).collect()}
    assert got == {(day(0), 1, 3.0), (day(1), 0, 2.0)}


def test_gap_days_are_filled_and_marked(spark):
    df = frame(spark, [(1, 0, 0, None), (1, 1, 0, 2.0), (1, 5, 1, 7.0)])
    got = by_pos(cal.densify(df, replace(SPEC, days=1)), "pos", "observed", "failure", "a", "a_d1", "next_fail")
    assert got == [(0, 1, 0, None, None, 5), (1, 1, 0, 2.0, None, 5), (2, 0, 0, 2.0, 0.0, 5), (3, 0, 0, 2.0, 0.0, 5),
                   (4, 0, 0, 2.0, 0.0, 5), (5, 1, 1, 7.0, 5.0, 5)]


def test_next_failure_after_an_early_one(spark):
    df = frame(spark, [(1, 0, 1, 1.0), (1, 3, 0, 1.0), (1, 4, 1, 1.0), (1, 6, 0, 1.0)])
    got = by_pos(cal.densify(df, replace(SPEC, days=1), diffs=False), "next_fail")
    assert [g[0] for g in got] == [0, 4, 4, 4, 4, None, None]


def test_one_day_and_exact_length_records(spark):
    rows = [(1, 0, 0, 1.0)] + [(2, i, 0, 1.0) for i in range(3)] + [(3, i, 0, 1.0) for i in range(4)]
    drives = cal.census(frame(spark, rows))
    got = sorted((r.drive, r.start) for r in windows.enumerate_windows(drives, SPEC).collect())
    assert got == [(2, 0), (3, 0), (3, 1)]
    assert sorted((r.drive, r.start) for r in windows.tile_windows(drives, SPEC).collect()) == [(2, 0), (3, 0), (3, 1)]


def test_log_levels_keep_null(spark):
    df = frame(spark, [(1, 0, 0, None), (1, 1, 0, -4.0), (1, 2, 0, 1.0)])
    got = by_pos(cal.densify(df, replace(SPEC, log_attrs=("a",))), "a")
    assert got[0][0] is None and got[1][0] == 0.0 and got[2][0] == pytest.approx(0.693147, abs=1e-6)


@pytest.fixture(scope="module")
def fleet(spark):
    rows = []
    for d, n, fails in ((1, 11, (4, 10)), (2, 7, ()), (3, 3, (0,)), (4, 5, (2,)), (5, 20, (19,))):
        rows += [(d, i, int(i in fails), float(i * d)) for i in range(n) if i in (0, n - 1) or i in fails or i % 3 or d == 3]
    return frame(spark, rows)


def brute(fleet, spec):
    """Every (drive, start, label) from the definition."""
    fails, length = {}, {}
    for r in fleet.collect():
        pos = (r.day - day(0)).days
        length[r.drive] = max(length.get(r.drive, 0), pos + 1)
        if r.failure:
            fails.setdefault(r.drive, []).append(pos)
    return {(d, s): int(any(s <= f <= s + spec.reach for f in fails.get(d, [])))
            for d, n in length.items() if n >= spec.days for s in range(n - spec.days + 1)}


def test_labels_from_every_route_agree(spark, fleet):
    want = brute(fleet, SPEC)
    drives = cal.census(fleet)
    listed = {(r.drive, r.start): r.label for r in windows.enumerate_windows(drives, SPEC).collect()}
    joined = windows.label_by_join(windows.enumerate_windows(drives, SPEC).select("drive", "start"), cal.failure_positions(fleet), SPEC)
    dense = features.window_aggregates(cal.densify(fleet, SPEC), SPEC, "stride")
    assert listed == want
    assert {(r.drive, r.start): r.label for r in joined.collect()} == want
    assert {(r.drive, r.start): r.label for r in dense.collect()} == want
    positive = {(r.drive, r.start) for r in windows.positive_starts(drives, SPEC).collect()}
    negative = {(r.drive, r.start) for r in windows.negative_starts(drives, SPEC).collect()}
    painted = {(r.drive, r.start) for r in windows.paint_labels(drives, SPEC).collect()}
    assert positive == painted == {k for k, v in want.items() if v}
    assert negative == {k for k, v in want.items() if not v}


def test_both_census_forms_agree(fleet):
    key = lambda df: sorted(map(str, df.select("drive", "first_day", "last_day", "n_obs", "n_fail", "n_days", "fail_pos").collect()))
    assert key(cal.census(fleet)) == key(cal.census(fleet, single_pass=True))


def test_counts_and_tiling_cover(spark, fleet):
    drives = cal.census(fleet)
    lengths = {r.drive: r.n_days for r in drives.collect()}
    assert windows.enumerate_windows(drives, SPEC).count() == sum(n - 2 for n in lengths.values())
    covered = {}
    for r in windows.tile_windows(drives, SPEC).collect():
        covered.setdefault(r.drive, set()).update(range(r.start, r.start + 3))
    assert covered == {d: set(range(n)) for d, n in lengths.items()}


def test_strided_with_last(spark, fleet):
    spec = replace(SPEC, stride=4, include_last=True)
    got = sorted((r.drive, r.start) for r in windows.enumerate_windows(cal.census(fleet), spec).collect())
    feats = features.window_aggregates(cal.densify(fleet, spec), spec, "stride")
    assert got == sorted((r.drive, r.start) for r in feats.collect())
    assert (1, 8) in got and (2, 4) in got and (4, 2) in got


def test_random_windows_replay_and_force(spark, fleet):
    drives = cal.census(fleet)
    one = windows.random_windows(drives, SPEC, per_drive=5, positive_ratio=1.0)
    two = windows.random_windows(drives.repartition(3), SPEC, per_drive=5, positive_ratio=1.0)
    key = lambda df: sorted((r.drive, r.i, r.start, r.label) for r in df.collect())     # noqa: E731
    assert key(one) == key(two)
    assert all(label == (drive != 2) for drive, _, _, label in key(one))
    negative = windows.random_windows(drives, SPEC, per_drive=8, positive_ratio=0.0, otherwise="negative")
    want = brute(fleet, SPEC)
    some_negative = {d for (d, s), y in want.items() if not y}
    assert all(r.label == 0 for r in negative.collect() if r.drive in some_negative)
    assert all(r.label == 1 for r in negative.collect() if r.drive not in some_negative)


def test_padding_leaves_full_windows_alone(spark, fleet):
    strict = features.window_aggregates(cal.densify(fleet, replace(SPEC, days=6, min_days=6)), replace(SPEC, days=6), "latest")
    padded_spec = replace(SPEC, days=6, min_days=2, pad_short=True)
    padded = features.window_aggregates(cal.densify(fleet, padded_spec), padded_spec, "latest")
    full = {r.drive: r for r in padded.where("n_padded = 0").collect()}
    assert {r.drive: r for r in strict.collect()} == full
    short = {r.drive: r for r in padded.where("n_padded > 0").collect()}
    assert set(short) == {3, 4} and short[3].n_padded == 3
    assert short[3]["a__mean"] == pytest.approx((0 + 3 + 6) / 6) and short[3]["a__delta"] == 6.0 and short[3]["a__min"] == 0.0


def test_tensor_matches_aggregates(spark, fleet):
    dense = cal.densify(fleet, SPEC).fillna(0.0)
    x = {(r.drive, r.start): r.x for r in features.window_tensor(dense, SPEC).collect()}
    for r in features.window_aggregates(dense, SPEC).collect():
        col = [row[0] for row in x[r.drive, r.start]]
        assert len(col) == 3 and sum(col) / 3 == pytest.approx(r["a__mean"]) and col[-1] == r["a__last"]


def test_labels_never_change_features(spark, fleet):
    noisy = fleet.withColumn("failure", 1 - F.col("failure"))
    names = list(SPEC.feature_names)
    build = lambda df: features.window_aggregates(cal.densify(df, SPEC), SPEC, "stride").select("drive", "start", *names)
    assert build(fleet).exceptAll(build(noisy)).count() == 0


def test_one_exchange_on_drive(spark, fleet):
    """Calendar, differences and window features all reuse the partitioning of one shuffle."""
    plan = features.window_aggregates(cal.densify(fleet, SPEC), SPEC)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(drive") == 1 and "SortAggregate" not in plan


def test_failure_offset_with_two_failures(spark):
    days = frame(spark, [(1, n, int(n in (2, 17)), 1.0) for n in range(20)])
    wins = windows.enumerate_windows(cal.census(days), SPEC)
    got = windows.window_metadata(wins, cal.densify(days, SPEC, diffs=False), SPEC).collect()
    want = {n: next((f - n for f in (2, 17) if n <= f <= n + SPEC.reach), -1) for n in (r.start for r in got)}
    assert {r.start: r.failure_offset for r in got} == want
    assert want[15] == 2 and want[3] == -1


def test_metadata_shuffles_the_calendar_once(spark):
    """Days and window ends meet in the partitions by drive that the calendar was built in."""
    from fleetgauge.catalog import load
    df = load()["w23_window_metadata"].build(spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    assert len(exchanges) == 2           # raw rows by (supplier, day), and their sums by drive
    assert "Join" not in plan


def test_parts_of_the_days_grow_with_the_table(spark, sf_dir, monkeypatch):
    from fleetgauge.catalog import views
    few = {make: make(spark, sf_dir) for make in (views.supply_days, views.events_days)}
    monkeypatch.setattr(views, "PART_ROWS", 50)
    for make, want in few.items():
        got = make(spark, sf_dir)
        assert got.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_parts_of_the_archive_run_grow_with_the_days(spark, sf_dir, monkeypatch):
    """The calendar of settled readings is sorted in parts by the number of days, not in parts joined by the size of what is read."""
    from fleetgauge.catalog import views
    from fleetgauge.plans import archive
    from fleetgauge.session import settle
    days = settle(views.supply_days(spark, sf_dir))
    split = days.select("drive").distinct().withColumn("split", F.lit("train"))
    columns = ["drive", "start", "label", "n_real", F.round("q__max", 6).alias("peak")]
    few = archive.window_table(days, split, views.SUPPLY_SPEC)[1].select(*columns).collect()
    monkeypatch.setattr(cal, "PART_ROWS", 50)
    table = archive.features_of_days(archive.days_in_parts(days), split, views.SUPPLY_SPEC)[1].select(*columns)
    assert table.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert sorted(map(repr, table.collect())) == sorted(map(repr, few))


def test_a_few_parts_are_kept_apart_as_well(spark, sf_dir, monkeypatch):
    """Days that fill more than one part, but no more than there are cores, are not joined into one task by the size of what is read."""
    from fleetgauge.catalog import views
    want = views.supply_dense(spark, sf_dir, diffs=True)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    monkeypatch.setattr(views, "PART_ROWS", rows // 3)
    got = views.supply_dense(spark, sf_dir, diffs=True)
    assert got.rdd.getNumPartitions() >= 3
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))

"""Streams over hand-made days: any order of arrival, chunks of two rows, days sent again, records that begin earlier than known."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetgauge.catalog import q_sources
from fleetgauge.operators.calendar import census
from fleetgauge.operators.windows import enumerate_windows, tile_windows
from fleetgauge.settings import WindowSpec
from fleetgauge.streaming import history, windows
from fleetgauge.streaming.ingest import run_available

DAY = dt.date(2024, 1, 1)
SCHEMA = "drive bigint, day date, seq bigint, failure int, value double"


@pytest.fixture
def small_chunks(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def streamed(spark, folder, files, make):
    """What `make` sends for the rows of the files, one micro-batch each, and a heartbeat far behind them."""
    files = [*files, [(None, DAY + dt.timedelta(days=2000), None, None, None)]]
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run_available(make(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/out")


def drive_days(n_drives, n_days, seed):
    r = random.Random(seed)
    rows = []
    for drive in range(n_drives):
        for n in range(r.randint(n_days // 2, n_days)):
            if r.random() < 0.8:
                rows.append((drive, DAY + dt.timedelta(days=n), 1, int(r.random() < 0.05), float(r.randint(0, 9))))
    return rows


def test_history_folds_by_day_whatever_the_chunks(spark, small_chunks, tmp_path):
    rows = drive_days(3, 40, 1)
    again = [(d, day, 2, f, 100.0) for d, day, _, f, _ in rows[::9]]
    shuffled = rows + again
    random.Random(2).shuffle(shuffled)
    out = streamed(spark, tmp_path, [shuffled], lambda s: history.history_deltas(s, ["value"])).collect()
    known = {(d, day): v for d, day, _, _, v in rows} | {(d, day): v for d, day, _, _, v in again}
    assert len(out) == len(known)
    for r in out:
        ago = [(abs(k - 7), k) for k in (6, 7, 8) if (r["drive"], r["day"] - dt.timedelta(days=k)) in known]
        if not ago:
            assert r["prior_day"] is None and r["value_delta7"] is None
            continue
        gap = min(g for g, _ in ago)
        prior = r["day"] - dt.timedelta(days=max(k for g, k in ago if g == gap))
        assert r["prior_day"] == prior
        assert r["value_delta7"] == known[r["drive"], r["day"]] - known[r["drive"], prior]


def test_a_reading_behind_event_time_is_folded_at_once(spark, tmp_path):
    day = [DAY + dt.timedelta(days=n) for n in range(40)]
    files = [[(1, day[n], 1, 0, float(n)) for n in (0, 7, 30)], [(1, day[14], 1, 0, 14.0)], [(1, day[37], 1, 0, 37.0)]]
    out = {r["day"]: r["value_delta7"] for r in streamed(spark, tmp_path, files, lambda s: history.history_deltas(s, ["value"], late="0 days")).collect()}
    assert out == {day[0]: None, day[7]: 7.0, day[14]: 7.0, day[30]: None, day[37]: 7.0}


@pytest.mark.parametrize("stride", [None, 3])
def test_windows_after_corrections_are_the_batch_windows(spark, small_chunks, tmp_path, stride):
    spec = WindowSpec(attrs=("value",), days=7, horizon=3, stride=stride or 1, min_days=7)
    rows = drive_days(4, 40, 3)
    files = [[], [], [], []]
    r = random.Random(4)
    for row in rows:                     # whatever comes after the second file is far behind event time, the records' first days too
        files[r.randrange(4)].append(row)
    files[1].append((9, DAY + dt.timedelta(days=90), 1, 0, 1.0))
    old = [(d, day, 0, 1 - f, -5.0) for d, day, _, f, _ in rows[::5]]          # an older sending does not count, whenever it comes
    files[3] += old[::2]
    files[0] += old[1::2]
    sent = streamed(spark, tmp_path, files, lambda s: windows.anchored_windows(s, spec, stride, late="0 days"))
    got = {(x["drive"], x["start"]): (x["label"], x["n"], x["total"], x["peak"]) for x in windows.current_windows(sent).collect()}
    days = spark.createDataFrame([(d, day, f, v) for d, day, _, f, v in rows], "drive bigint, day date, failure int, value double")
    batch = (enumerate_windows if stride else tile_windows)(census(days), spec)
    first = {d: min(day for e, day, *_ in rows if e == d) for d in range(4)}
    want = {}
    for w in batch.collect():
        low = first[w["drive"]] + dt.timedelta(days=w["start"])
        mine = [v for d, day, _, _, v in rows if d == w["drive"] and low <= day < low + dt.timedelta(days=7)]
        want[w["drive"], w["start"]] = (w["label"], len(mine), float(sum(mine)) if mine else None, max(mine, default=None))
    assert got == want
    assert sent.where("gone = 1").count() > 0 and sent.where("version > 1 AND gone = 0").count() > 0


class CountedState:
    """A drive's state and timers in a dictionary, with the number of calls that a worker would send to its executor."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def getMapState(self, name, key, value):
        return self

    def getValueState(self, name, schema):
        return self

    def call(self):
        self.calls += 1

    def get(self):
        self.call()
        return self.values.get("own")

    def update(self, value):
        self.call()
        self.values["own"] = value

    def containsKey(self, key):
        self.call()
        return key in self.values

    def getValue(self, key):
        self.call()
        return self.values.get(key)

    def updateValue(self, key, value):
        self.call()
        self.values[key] = value

    def registerTimer(self, ms):
        self.call()

    def getCurrentWatermarkInMs(self):
        return 0


@pytest.mark.parametrize("processor", [windows.AnchoredWindows(30, 15, 59, 30), windows.AnchoredWindows(30, None, 59, 30), history.DriveHistory(["a0"], 7, 1, 60)])
def test_state_calls_do_not_grow_with_the_days(processor):
    state = CountedState()
    processor.init(state)
    days = pd.DataFrame({"day": np.arange(20_000, 20_500), "seq": 0, "failure": 0.0, "value": 1.0, "a0": 1.0})
    assert list(processor.handleInputRows((1,), iter([days]), state)) == []
    assert state.calls < 12


@pytest.mark.parametrize("stride", [None, 15])
def test_drives_of_a_group_share_their_state_calls(stride):
    """400 drives in two chunks of packed readings need no more calls than one drive."""
    state = CountedState()
    processor = windows.AnchoredWindows(30, stride, 59, 30)
    processor.init(state)
    packed = [(0, np.repeat(np.arange(n, n + 200), 100), np.tile(np.arange(20_000, 20_100, dtype=np.int32), 200), *np.zeros((3, 20_000))) for n in (0, 200)]
    chunks = [pd.DataFrame([p], columns=["group", "drive", "day", "seq", "failure", "value"]) for p in packed]
    assert list(processor.handleInputRows((0,), iter(chunks), state)) == []
    assert state.calls < 12
    state.getCurrentWatermarkInMs = lambda: 21_000 * history.DAY_MS
    sent = pd.concat(processor.handleExpiredTimer((0,), state, None))
    assert state.calls < 12 and sorted(set(sent["drive"])) == list(range(400)) and set(sent["n"]) == {30}
    assert len(sent) == 400 * (5 if stride else 4)


@pytest.mark.parametrize("stride", [None, 3])
def test_windows_do_not_depend_on_the_groups(spark, monkeypatch, tmp_path, stride):
    monkeypatch.setattr(windows, "PACK", 11)
    spec = WindowSpec(attrs=("value",), days=7, horizon=3, stride=stride or 1, min_days=7)
    rows = drive_days(12, 40, 5)
    random.Random(6).shuffle(rows)
    found = [streamed(spark, tmp_path / str(groups), [rows[::2], rows[1::2]], lambda s: windows.anchored_windows(s, spec, stride, late="0 days", groups=groups))
             for groups in (1, 5, 512)]
    one, *more = [sorted(map(str, sent.collect())) for sent in found]
    assert len(one) > 12 and all(other == one for other in more)
    days = spark.createDataFrame([(d, day, f, v) for d, day, _, f, v in rows], "drive bigint, day date, failure int, value double")
    batch = (enumerate_windows if stride else tile_windows)(census(days), spec)
    got = sorted(map(tuple, windows.current_windows(found[0]).select("drive", "start", "label").collect()))
    assert got == sorted((w["drive"], w["start"], w["label"]) for w in batch.collect())


def test_each_span_of_a_replay_is_one_batch_of_several_files(spark, monkeypatch, tmp_path):
    """Large spans aren't written and read by one task; a short one and one without a day have as many files."""
    monkeypatch.setattr(q_sources, "FILE_ROWS", 5, raising=False)
    spans = [30, 2, 0, 40]
    rows = [(d, DAY + dt.timedelta(days=10 * i)) for i, n in enumerate(spans) for d in range(n)] + [(99, DAY + dt.timedelta(days=39))]
    stream, folder = q_sources.replay(spark, spark.createDataFrame(rows, "drive bigint, day date"), F.lit(0), batches=4)
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress] == [30, 2, 0, 41, 1]
    assert len(spark.read.parquet(f"{folder}/in").inputFiles()) > 4 * 4

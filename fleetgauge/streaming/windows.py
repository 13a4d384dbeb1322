"""Windows over a stream: anchored at each drive's first day, with corrections, and aligned to the epoch.

`anchored_windows` is the streaming twin of tiling (no stride) and of strided windows, row for row. A window is sent when event time has
passed its end and horizon, so that its label is known. Nothing that comes later is lost: a late reading, a reading sent again, or a
record that turns out to begin earlier or go on longer sends the windows it changes once more, with a higher `version`, and takes
back windows that are no more (`gone`). `current_windows` is what holds after all corrections.

`event_time_windows` is Spark's own window, aligned to the epoch; rows later than the watermark are dropped there.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from ..settings import WindowSpec
from .history import DAY_MS, NEVER, on_event_days

BLOCK = 256               # days of a group's records, and the windows that start on them, that are one value in state
GROUPS = 512
PACK = 1 << 18            # readings that a task deals to their groups at a time
FAR = 2 ** 31 - 1
READING = np.dtype([("who", "<i4"), ("day", "<i4"), ("seq", "<f8"), ("failure", "<f8"), ("value", "<f8")])
WINDOW = np.dtype([("who", "<i4"), ("at", "<i4"), ("first", "<i4"), ("n", "<i4"), ("label", "<i4"), ("version", "<i4"), ("total", "<f8"), ("peak", "<f8")])
TAKEN_BACK = -1           # as n
SENT = "first int, at int, n int, label int, total double, peak double, version int, gone int"


def places(who: np.ndarray, day: np.ndarray) -> np.ndarray:
    """Numbers in the order of drive and day; a day later is one more."""
    return (np.asarray(who, np.int64) << 32) + day + 2 ** 31


def parts(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> 32, (place & 2 ** 32 - 1) - 2 ** 31


def over(reduce: np.ufunc, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """`reduce` over each of the ranges of `values`; an empty one has no number."""
    out, some = np.full(len(low), np.nan), low < high
    if some.any():
        out[some] = reduce.reduceat(np.append(values, 0.0), np.column_stack([low[some], high[some]]).ravel())[::2]
    return out


class Records:
    """A group's blocks while its task works on them: each is read once at most, and the changed ones are written once."""

    def __init__(self, state, known: bytes):
        self.state, self.known = state, set(np.frombuffer(known, np.int32).tolist())
        self.days: dict[int, np.ndarray] = {}
        self.sent: dict[int, np.ndarray] = {}
        self.dirty: set[int] = set()

    def load(self, n: int) -> None:
        if n not in self.days:
            days, sent = self.state.getValue((n,)) if n in self.known else (b"", b"")
            self.days[n], self.sent[n] = np.frombuffer(days, READING), np.frombuffer(sent, WINDOW)

    def take_in(self, new: np.ndarray) -> None:
        """Of the readings of a day the last with the highest `seq` counts, and the stored one comes first."""
        for n in np.unique(new["day"] // BLOCK).tolist():
            self.load(n)
            both = np.concatenate([self.days[n], new[new["day"] // BLOCK == n]])
            at = places(both["who"], both["day"])
            order = np.lexsort((both["seq"], at))
            self.days[n] = both[order[np.append(at[order][1:] != at[order][:-1], True)]]
            self.dirty.add(n)

    def around(self, starts: np.ndarray, reach: int) -> np.ndarray:
        """The readings of all blocks that windows from these days reach, in order."""
        wanted = {n for first in np.unique(starts // BLOCK).tolist() for n in range(first, (int(starts[starts // BLOCK == first].max()) + reach) // BLOCK + 1)}
        for n in wanted:
            self.load(n)
        found = np.concatenate([self.days[n] for n in sorted(wanted)])
        return found[np.argsort(places(found["who"], found["day"]), kind="stable")]

    def sent_before(self, n: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the block's windows, given by their places, were sent before, and their rows in `sent`."""
        self.load(n)
        have = places(self.sent[n]["who"], self.sent[n]["at"])
        at = np.searchsorted(have, windows)
        found = at < len(have)
        found[found] = have[at[found]] == windows[found]
        return found, at[found]

    def store(self) -> bytes:
        for n in self.dirty:
            self.state.updateValue((n,), (self.days[n].tobytes(), self.sent[n].tobytes()))
        return np.array(sorted(self.known | self.dirty), np.int32).tobytes()


class AnchoredWindows(StatefulProcessor):
    """State of a group of drives: their days in blocks with what was sent of the windows that start there, and each drive's first and last
    day. Windows are known by the day they start on. A group has one timer, for the next of its windows that event time has not passed, and
    all its drives are worked out together. A chunk without a column `drive` is of the one drive that the group is named after."""

    def __init__(self, days: int, stride: int | None, reach: int, shortest: int):
        self.days, self.stride, self.reach, self.shortest = days, stride, reach, max(shortest, days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "n int", "days binary, sent binary")
        self.bounds = handle.getValueState("bounds", "drives binary, ends binary, passed int, alarm int, blocks binary")

    def starts(self, first: np.ndarray, last: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The places, in order, of the windows of every drive that start on its day `low` or later."""
        step, final = self.stride or self.days, last - self.days + 1
        fits = last - first + 1 >= self.shortest
        skipped = np.maximum(0, -((first - low) // step))
        n = np.where(fits, np.maximum((final - first) // step + 1 - skipped, 0), 0)
        who = np.repeat(np.arange(len(n)), n)
        start = first[who] + (skipped[who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)) * step
        if not self.stride:          # the last tile ends with the record
            more = np.flatnonzero(fits & ((final - first) % step != 0) & (final >= low))
            who, start = np.append(who, more), np.append(start, final[more])
        return np.sort(places(who, start))

    def facts(self, records: Records, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Each window as it is now, as its first version."""
        who, at = parts(windows)
        seen = records.around(at, self.reach)
        place = places(seen["who"], seen["day"])
        low, high, end = (np.searchsorted(place, windows + k) for k in (0, self.days, self.reach + 1))
        rows = np.empty(len(windows), WINDOW)
        rows["who"], rows["at"], rows["first"], rows["n"], rows["version"] = who, at, first[who], high - low, 1
        rows["label"] = over(np.add, (seen["failure"] > 0).astype(float), low, end) > 0
        known = ~np.isnan(seen["value"])
        low, high = (np.searchsorted(place[known], windows + k) for k in (0, self.days))
        rows["total"], rows["peak"] = (over(f, seen["value"][known], low, high) for f in (np.add, np.maximum))
        return rows

    def send(self, records: Records, first: np.ndarray, windows: np.ndarray) -> list[np.ndarray]:
        """The windows that are not as they were sent before."""
        if not len(windows):
            return []
        facts, out = self.facts(records, first, windows), []
        block = facts["at"] // BLOCK
        for n in np.unique(block).tolist():
            rows, mine = facts[block == n], windows[block == n]
            found, at = records.sent_before(n, mine)
            before = records.sent[n][at]
            rows["version"][found] = before["version"] + 1
            same = found.copy()
            same[found] = np.all([(rows[c][found] == before[c]) | (rows[c][found] != rows[c][found]) & (before[c] != before[c])
                                  for c in ("first", "n", "label", "total", "peak")], axis=0)
            if not same.all():
                both = np.concatenate([np.delete(records.sent[n], at[~same[found]]), rows[~same]])
                records.sent[n] = both[np.argsort(places(both["who"], both["at"]))]
                records.dirty.add(n)
                out.append(rows[~same])
        return out

    def take_back(self, records: Records, windows: np.ndarray) -> list[np.ndarray]:
        out, block = [], parts(windows)[1] // BLOCK
        for n in np.unique(block).tolist():
            _, at = records.sent_before(n, windows[block == n])
            at = at[records.sent[n]["n"][at] != TAKEN_BACK]
            if len(at):
                sent = records.sent[n] = records.sent[n].copy()
                sent["version"][at] += 1
                out.append(sent[at])
                sent["n"][at] = TAKEN_BACK
                records.dirty.add(n)
        return out

    def refresh(self, names: np.ndarray, new: np.ndarray, passed: int) -> Iterator[pd.DataFrame]:
        """Take in readings of the drives `names`, send and take back windows, and set the timer for the next window."""
        before = self.bounds.get()
        if before is None:
            drives, ends, upto, alarm, blocks = pd.Index(names[:0]), np.empty((2, 0), np.int64), NEVER, NEVER, b""
        else:
            drives, ends, (upto, alarm, blocks) = pd.Index(pickle.loads(before[0])), np.frombuffer(before[1], np.int64).reshape(2, -1), before[2:]
        if not len(new) and passed <= upto:
            return
        unknown = pd.unique(names[drives.get_indexer(names) < 0])
        drives = drives.append(pd.Index(unknown))
        who, day = drives.get_indexer(names), new["day"].astype(np.int64)
        new["who"] = who
        old_first, old_last = np.concatenate([ends, np.array([[FAR], [NEVER]]).repeat(len(unknown), axis=1)], axis=1)
        first, last, low = old_first.copy(), old_last.copy(), np.full(len(drives), upto)
        for f, bound in ((np.minimum, first), (np.maximum, last), (np.minimum, low)):
            f.at(bound, who, day)
        low -= self.reach          # windows before that are as they were, but for those below
        low = np.where(last != old_last, np.minimum(low, old_last - self.days + 1), low)
        moved = first != old_first
        low = np.where(moved | (old_last - old_first + 1 < self.shortest), np.minimum(low, first), low)
        old, now = self.starts(old_first, old_last, low), self.starts(first, last, low)
        records = Records(self.blocks, blocks)
        records.take_in(new)
        gone = self.take_back(records, np.setdiff1d(old, now, assume_unique=True))
        own, at = parts(now)
        open_ = at + self.reach >= passed
        due, own, over_before = now[~open_], own[~open_], at[~open_] + self.reach < upto
        sorted_days = np.append(np.sort(places(who, day)), np.iinfo(np.int64).max)
        changed = sorted_days[np.searchsorted(sorted_days, due)] <= due + self.reach
        sent = self.send(records, first, due[moved[own] | changed | ~over_before | ~np.isin(due, old, assume_unique=True)])
        if open_.any():
            following = int(at[open_].min()) + self.reach + 1
            if alarm <= passed or following < alarm:
                alarm = following
                self.handle.registerTimer(alarm * DAY_MS)
        self.bounds.update((pickle.dumps(drives.to_numpy()), np.stack([first, last]).tobytes(), max(upto, passed), alarm, records.store()))
        if gone or sent:
            rows = np.concatenate(gone + sent)
            yield pd.DataFrame({"drive": drives[rows["who"]], **{c: rows[c] for c in ("first", "at", "n", "label", "total", "peak", "version")},
                                "gone": np.repeat(np.array([1, 0], np.int32), [sum(map(len, gone)), sum(map(len, sent))])})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = list(rows)
        got = {c: np.hstack([cell for chunk in chunks for cell in chunk[c]]) for c in ("drive", *READING.names[1:]) if c in chunks[0]}
        new = np.empty(len(got["day"]), READING)
        for c in READING.names[1:]:
            new[c] = got[c]
        yield from self.refresh(got.get("drive", np.repeat(key[0], len(new))), new, timerValues.getCurrentWatermarkInMs() // DAY_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.refresh(np.empty(0, np.int64), np.empty(0, READING), timerValues.getCurrentWatermarkInMs() // DAY_MS)

    def close(self) -> None:
        pass


def dealt(rows: DataFrame, groups: int) -> DataFrame:
    """Rows of arrays, one for each group of drives and at most `PACK` of a task's `rows` (drive, day, seq, failure, value), so that what state
    and shuffle cost for a row isn't paid for every reading."""
    names = rows.columns

    def run(batches):
        def lists():
            table = pa.Table.from_batches(held)
            group = table.column("group").to_numpy()
            order = np.argsort(group, kind="stable")
            group, table = group[order], table.take(order).combine_chunks()
            cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            ends = pa.array(np.append(cuts, len(group)), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(group[cuts]), *[pa.ListArray.from_arrays(ends, table.column(c).chunk(0)) for c in names]], ["group", *names])

        held = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PACK:
                yield lists()
                held = []
        if held:
            yield lists()

    schema = T.StructType([T.StructField("group", T.IntegerType()), *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in rows.schema]])
    return rows.withColumn("group", F.pmod(F.xxhash64("drive"), F.lit(groups)).cast("int")).mapInArrow(run, schema)


def anchored_windows(readings: DataFrame, spec: WindowSpec, stride: int | None = None, late: str = "3 days", groups: int = GROUPS) -> DataFrame:
    """Stream of drive, first_day, start, start_day, end_day, n, label, total, peak, version, gone from a stream of drive, day, seq, failure,
    value: tiles, or windows each `stride` days.

    n, total and peak are over the days with a reading; `start` is the position of the first day in the record, which counts from `first_day`.
    State is kept by groups of drives. Their number stays with the checkpoint; one for every thousand drives will do, and one for each drive of a small fleet.
    """
    proc = AnchoredWindows(spec.days, stride, spec.reach, spec.shortest_record)
    rows = on_event_days(readings, late).select(
        "drive", F.unix_date("day").alias("day"), F.coalesce(F.col("seq").cast("double"), F.lit(float("-inf"))).alias("seq"),
        F.coalesce(F.col("failure").cast("double"), F.lit(0.0)).alias("failure"), F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value"))
    schema = T.StructType([T.StructField("drive", readings.schema["drive"].dataType), *T._parse_datatype_string(SENT).fields])
    sent = dealt(rows, groups).groupBy("group").transformWithStateInPandas(
        statefulProcessor=proc, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return sent.select("drive", F.date_from_unix_date("first").alias("first_day"), (F.col("at") - F.col("first")).alias("start"),
                       F.date_from_unix_date("at").alias("start_day"), F.date_from_unix_date(F.col("at") + spec.days - 1).alias("end_day"),
                       "n", "label", "total", "peak", "version", "gone")


def current_windows(sent: DataFrame) -> DataFrame:
    """The windows that hold after all corrections: of each drive and start day the newest version that was not taken back."""
    rest = [c for c in sent.columns if c not in ("drive", "start_day")]
    newest = sent.groupBy("drive", "start_day").agg(*[F.max_by(c, "version").alias(c) for c in rest])          # column by column it needs no sort
    return newest.where("gone = 0").drop("gone")


def event_time_windows(readings: DataFrame, days: int, stride: int | None = None, late: str = "1 day",
                       value: str = "value") -> DataFrame:
    """(drive, start, end, n, total, peak) per window of `days`, moving by `stride` days."""
    ts = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", f"{days} days", f"{stride} days") if stride else F.window("ts", f"{days} days")
    return ts.groupBy("drive", w.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("peak")).select(
        "drive", F.to_date("w.start").alias("start"), F.to_date("w.end").alias("end"), "n", "total", "peak")


ship(__name__)

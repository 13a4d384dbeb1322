"""Per-drive history kept in stream state: today's reading against the one about a week before.

Readings wait in state until event time has passed their day by `late`, and are then folded in the order of their days, whatever the
batches and Arrow chunks they came in. A reading that comes even later is folded at once. Of two readings of a day the one with the higher
`seq` counts while they wait; a later one replaces the stored one. The folded history is one value of at most `keep` days, so
a drive's state is bounded whatever its age.

Rows without a drive are heartbeats: they move event time and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rowlevel import risk_action, risk_band
from ..session import ship

KEEP = 60
DAY_MS = 86_400_000
NEVER = -2 ** 31
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_event_days(readings: DataFrame, late: str) -> DataFrame:
    """The stream with event time in days and `late` to wait, without heartbeats.

    The event-time column stays behind here, so rows later than that still reach the state.
    """
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = readings.withColumn("_at", F.timestamp_seconds(F.unix_date("day") * 86_400)).withWatermark("_at", late)
    # One condition on both columns: the optimizer would take one on the drive alone below the watermark, which heartbeats then could not move.
    return timed.where(F.when(F.col("drive").isNotNull(), F.col("_at")).isNotNull()).drop("_at")


class DriveHistory(StatefulProcessor):
    """State of a drive: the days that wait, the folded ones and the time of its timer, which is for the first of its waiting days, as one value."""

    def __init__(self, attrs: Sequence[str], days_ago: int, slack: int, keep: int):
        self.attrs, self.days_ago, self.slack, self.keep = list(attrs), days_ago, slack, keep
        self.kind = np.dtype([("n", "<i8"), ("seq", "<i8"), ("v", "<f8", (len(self.attrs),))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "waiting binary, folded binary, alarm int")

    def fold(self, history: dict[int, list[float]], due: np.ndarray) -> list[tuple]:
        """Take in readings by day, and compare each with the stored one nearest to `days_ago` days before."""
        out = []
        for n, now in zip(due["n"].tolist(), due["v"].tolist()):
            near = range(n - self.days_ago - self.slack, n - self.days_ago + self.slack + 1)
            at = min((d for d in near if d in history), key=lambda d: (abs(d - (n - self.days_ago)), d), default=None)
            before = [np.nan] * len(now) if at is None else history[at]
            out.append((n, at, *now, *[a - b for a, b in zip(now, before)]))
            history[n] = now
            if len(history) > self.keep:
                del history[min(history)]
        return out

    def refresh(self, drive, new: np.ndarray, passed: int) -> Iterator[pd.DataFrame]:
        """Let `new` readings of sorted days wait, fold those that event time has passed, and set the timer for the next one."""
        known = self.record.get()
        waiting, folded, alarm = (np.empty(0, self.kind), b"", NEVER) if known is None else (np.frombuffer(known[0], self.kind), known[1], known[2])
        both = np.concatenate([waiting, new])
        both = both[np.lexsort((both["seq"], both["n"]))]
        both = both[np.append(both["n"][1:] != both["n"][:-1], True)[:len(both)]]          # of a day the last with the highest seq
        due, waiting = both[both["n"] < passed], both[both["n"] >= passed]
        out = []
        if len(due):
            stored = np.frombuffer(folded).reshape(-1, 1 + len(self.attrs))
            history = dict(zip(stored[:, 0].astype(int).tolist(), stored[:, 1:].tolist()))
            out = self.fold(history, due)
            folded = np.array([[d, *v] for d, v in sorted(history.items())], float).tobytes()
        if len(waiting) and (alarm <= passed or waiting["n"][0] + 1 < alarm):
            alarm = int(waiting["n"][0]) + 1
            self.handle.registerTimer(alarm * DAY_MS)
        self.record.update((waiting.tobytes(), folded, alarm))
        if out:
            columns = dict(zip(self.columns(), zip(*out)))
            yield pd.DataFrame({"drive": [drive] * len(out), "day": columns.pop("day"), "prior_day": pd.array(columns.pop("prior_day"), "Int32"), **columns})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = list(rows)
        new = np.empty(sum(map(len, chunks)), self.kind)
        new["n"] = np.concatenate([c["day"].to_numpy() for c in chunks])
        new["seq"] = np.concatenate([c["seq"].to_numpy() for c in chunks])
        new["v"] = np.concatenate([c[[f"a{i}" for i in range(len(self.attrs))]].to_numpy(float) for c in chunks])
        yield from self.refresh(key[0], new, timerValues.getCurrentWatermarkInMs() // DAY_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.refresh(key[0], np.empty(0, self.kind), timerValues.getCurrentWatermarkInMs() // DAY_MS)

    def columns(self) -> list[str]:
        return ["day", "prior_day", *self.attrs, *[f"{a}_delta{self.days_ago}" for a in self.attrs]]

    def close(self) -> None:
        pass


def history_deltas(readings: DataFrame, attrs: Sequence[str], days_ago: int = 7, slack: int = 1,
                   keep: int = KEEP, late: str = "3 days") -> DataFrame:
    """Stream of (drive, day, prior_day, attributes, deltas) from a stream of drive, day, seq, attributes."""
    proc = DriveHistory(attrs, days_ago, slack, keep)
    rows = on_event_days(readings, late).select(
        "drive", F.unix_date("day").alias("day"), F.coalesce(F.col("seq").cast("bigint"), F.lit(-2 ** 63).cast("bigint")).alias("seq"),
        *[F.col(a).cast("double").alias(f"a{i}") for i, a in enumerate(attrs)])
    schema = T.StructType([T.StructField("drive", readings.schema["drive"].dataType), T.StructField("day", T.IntegerType()),
                           T.StructField("prior_day", T.IntegerType())]
                          + [T.StructField(c, T.DoubleType()) for c in proc.columns()[2:]])
    out = rows.groupBy("drive").transformWithStateInPandas(
        statefulProcessor=proc, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.withColumn("day", F.date_from_unix_date("day")).withColumn("prior_day", F.date_from_unix_date("prior_day"))


def with_band(scored: DataFrame, score: str, threshold: float) -> DataFrame:
    """Risk band and action for each scored reading."""
    band = risk_band(F.col(score), threshold)
    return scored.withColumn("risk", band).withColumn("action", risk_action(band))


ship(__name__)

"""What the text operators share: column picking, Arrow batches, objects kept per Python worker."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fleetgauge.session import settle, ship


def pick(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string), so that no other column of `df` can clash; a null text is the empty text."""
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(),
         "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}


def let_go() -> None:
    """Give what a task no longer needs back to the system: its worker stays, idle beside the next stage's tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # the GNU library has it
    if trim is not None:
        trim(0)


def per_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, rows: int = 1000) -> DataFrame:
    """`make()` runs once per task; what it returns turns at most `rows` rows at a time into the columns of `schema`."""
    columns = [(name, KINDS[kind]) for name, kind in map(str.split, schema.split(", "))]

    def run(batches):
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = work(batch.slice(start, rows))
                arrays = [out[n] if isinstance(out[n], pa.Array) else pa.array(out[n], kind) for n, kind in columns]
                yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in columns])
        work = out = arrays = batch = None
        let_go()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch, int], pa.RecordBatch]], text_col: str) -> DataFrame:
    """All columns of `df`, whatever their names; `make()` runs once per task and gives a function of a batch and the place of the text."""
    at, numbered = df.columns.index(text_col), [f"c{i}" for i in range(len(df.columns))]

    def run(batches):
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                yield work(batch.slice(start, 500), at)
        work = batch = None
        let_go()

    schema = StructType([StructField(n, f.dataType, True) for n, f in zip(numbered, df.schema)])
    return df.toDF(*numbered).mapInArrow(run, schema).toDF(*df.columns)


def worker_memo(key: str, make: Callable[[], object]):
    """One object per Python worker process, built on first use and kept across its tasks."""
    kept = sys.modules.setdefault("fleetgauge_worker_memo", types.ModuleType("fleetgauge_worker_memo")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def in_quotes(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def numbered_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, id, text, payload): settled rows with a number of their own, the text without nulls, and all columns of `docs`."""
    payload = F.struct(*[F.col(in_quotes(c)) for c in docs.columns]).alias("payload")
    rows = settle(docs.select(F.monotonically_increasing_id().alias("rid"), payload))
    return rows.select("rid", F.col("payload")[id_col].cast("bigint").alias("id"),
                       F.coalesce(F.col("payload")[text_col].cast("string"), F.lit("")).alias("text"), "payload")


def without_later(rows: DataFrame, groups: DataFrame, docs: DataFrame) -> DataFrame:
    """Of `rows` (see `numbered_rows`), with the columns of `docs`, the one with the smallest id (null ids last), then the first, of every
    root in `groups` (vertex, root), and all that are in no group."""
    grouped = settle(groups.join(rows.select(F.col("rid").alias("vertex"), "id"), "vertex").select(F.col("vertex").alias("rid"), "root", "id"))
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "rid")).alias("best"))
    gone = settle(grouped.join(best, "root").filter(F.col("rid") != F.col("best.rid")).select("rid"))
    kept = rows.join(gone, "rid", "left_anti")
    return kept.select(*[F.col("payload")[c].alias(c) for c in docs.columns])


ship(__name__)

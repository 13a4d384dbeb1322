"""Query registry: each entry pairs a Spark query with its SQL twin and one output shape.

`cols` lists the output as "name:kind" with kinds i (bigint), r (double, 6 digits), h (double,
10 digits), d (date as text) and s (text). The same shape is applied on both sides, so results compare value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    cols: str
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def _pairs(cols: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in cols.split()]


def shape(df: DataFrame, cols: str) -> DataFrame:
    cast = {
        "i": lambda c: F.col(f"`{c}`").cast("bigint"),
        "r": lambda c: F.round(F.col(f"`{c}`").cast("double"), 6),
        "h": lambda c: F.round(F.col(f"`{c}`").cast("double"), 10),
        "d": lambda c: F.date_format(f"`{c}`", "yyyy-MM-dd"),
        "s": lambda c: F.col(f"`{c}`").cast("string"),
    }
    return df.select(*[cast[k](c).alias(c) for c, k in _pairs(cols)])


def shape_sql(sql: str, cols: str) -> str:
    cast = {
        "i": 'CAST("{c}" AS BIGINT)',
        "r": 'round(CAST("{c}" AS DOUBLE), 6) + 0.0',
        "h": 'round(CAST("{c}" AS DOUBLE), 10) + 0.0',
        "d": "strftime(CAST(\"{c}\" AS DATE), '%Y-%m-%d')",
        "s": 'CAST("{c}" AS VARCHAR)',
    }
    items = ", ".join(f'{cast[k].format(c=c)} AS "{c}"' for c, k in _pairs(cols))
    return f"SELECT {items} FROM ({sql}) AS result"


def corr_sql(a: str, b: str) -> str:
    """Correlation that is NULL, not NaN, when a side does not vary."""
    c = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
    return f"CASE WHEN NOT isnan({c}) THEN {c} END"


def query(name: str, cols: str | Callable[[], str], sql: str | None = None):
    """Register a Spark query under `name`."""
    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shape(fn(spark, sf_dir), cols)

        REGISTRY[name] = Entry(name, build, cols, None if sql is None else shape_sql(sql, cols))
        return fn
    return wrap

"""Result sinks. Tables are written by the executors; only small summaries become a single file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet (zstd), CSV with a header, or JSON lines."""
    writer = df.write.mode("overwrite")
    if fmt == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_summary(one_row: DataFrame, path: str) -> None:
    """A one-row frame as a JSON document."""
    one_row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_results(folder: str, metrics: DataFrame, verdicts: DataFrame, tables: dict[str, DataFrame],
                  verdict_csv: bool = False) -> None:
    """One folder per result; with `verdict_csv` the whole verdict table once more as CSV. Pass a limited frame for a limited export."""
    write_summary(metrics, f"{folder}/summary")
    write_table(verdicts, f"{folder}/verdicts")
    if verdict_csv:
        write_table(verdicts, f"{folder}/verdicts_csv", "csv")
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", "csv")

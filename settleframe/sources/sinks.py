"""Sinks of result tables and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = 10_000  # rows in a stored file, at most


def write_parquet(df: DataFrame, path: str, rows: int = ROWS, mode: str = "append") -> None:
    """Files of at most ``rows`` rows; each task writes its own, so nothing is shuffled."""
    df.write.option("maxRecordsPerFile", rows).mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A result as CSV with a header."""
    df.write.option("header", True).mode(mode).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A result, or a table shaped by ``chart_table``, as JSON lines; null fields are kept."""
    df.write.option("ignoreNullFields", False).mode(mode).json(path)

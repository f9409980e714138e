"""Readers of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One stored table; ``columns`` prunes the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def micros(column: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp without zone, null if null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)

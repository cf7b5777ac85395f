"""Ordered views. A sort with a limit is a distributed top-n, not a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """The n newest rows, newest first, or all rows for None; ties by ``keys``."""
    ordered = df.orderBy(F.col("ts").desc_nulls_last(), *keys)
    return ordered if n is None else ordered.limit(n)


def in_arrival_order(df: DataFrame, n: int, key: str = "packet_id") -> DataFrame:
    """The n oldest rows, oldest first; ties by ``key``."""
    return df.orderBy(F.col("ts").asc_nulls_last(), key).limit(n)

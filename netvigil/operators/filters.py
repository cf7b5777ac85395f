"""Row filters. Each is a plain predicate over columns, so it reaches the scan."""

from __future__ import annotations

import math
import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.functions.labels import (
    FAMILY_MEMBERS,
    PROTOCOL_CHOICES,
    STATUS_CHOICES,
    family_spellings,
)

_DATE_FOLDER = r"(?:^|/)date=(\d{4}-\d{2}-\d{2})(?:/|$)"


def filter_protocol(df: DataFrame, choice: str | None = "all") -> DataFrame:
    """Rows of one protocol family; ``all`` or None keeps every row."""
    choice = "all" if choice is None else choice
    if choice not in PROTOCOL_CHOICES:
        raise ValueError(f"protocol choice must be one of {PROTOCOL_CHOICES}, not {choice!r}")
    if choice == "all":
        return df
    family = next(f for f in FAMILY_MEMBERS if f.lower() == choice)
    return df.where(F.col("protocol").isin(family_spellings(family)))


def filter_status(df: DataFrame, choice: str | None = "all") -> DataFrame:
    """Rows of one packet status; ``all`` or None keeps every row."""
    choice = "all" if choice is None else choice
    if choice not in STATUS_CHOICES:
        raise ValueError(f"status choice must be one of {STATUS_CHOICES}, not {choice!r}")
    return df if choice == "all" else df.where(F.col("status") == choice)


def filter_packets(
    df: DataFrame, protocol: str | None = "all", status: str | None = "all"
) -> DataFrame:
    """Both packet filters together."""
    return filter_status(filter_protocol(df, protocol), status)


def blocked(df: DataFrame) -> DataFrame:
    """Firewall rows that were blocked."""
    return df.where(F.col("action") == "blocked")


def latest_ts(df: DataFrame, minus: str | None = None) -> Column:
    """Newest ``ts`` of a table as a scalar subquery, less an interval such as ``1 HOURS``.

    In a table laid out by ``date`` only the times of the two newest dates are read: folders
    may have been named in different time zones, which are at most a day apart.
    """
    newest = df
    if "date" in df.columns:
        day_before = F.date_sub(F.max(F.col("date").cast("date")), 1)
        newest = df.where(F.col("date") >= df.agg(day_before).scalar())
    value = F.max("ts")
    if minus is not None:
        value = value - F.expr(f"INTERVAL {minus}")
    return newest.agg(value).scalar()


def as_of_column(df: DataFrame, as_of: datetime | str | Column | None) -> Column:
    """The reference time: the given one, else the table's newest ``ts``."""
    if as_of is None:
        return latest_ts(df)
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast(df.schema["ts"].dataType)


def folder_dates(df: DataFrame) -> list[date]:
    """Dates of a table's ``date=...`` folders, newest first; no file is opened.

    They are taken from the list of files that Spark made when it was told of the table.
    """
    found = (re.search(_DATE_FOLDER, name) for name in df.inputFiles())
    return sorted({date.fromisoformat(m.group(1)) for m in found if m}, reverse=True)


def table_dates(spark: SparkSession, table: str) -> list[date]:
    """Dates of the partitions of a table of the catalog, newest first, as listed there."""
    name = F.regexp_extract("partition", _DATE_FOLDER, 1)
    rows = spark.sql(f"SHOW PARTITIONS {table}").select(name.try_cast("date")).distinct().collect()
    return sorted((day for (day,) in rows if day is not None), reverse=True)


def last_window_by_date(
    df: DataFrame, hours: int = 1, dates: list[date] | None = None, spread_days: int = 1
) -> DataFrame:
    """``last_window`` up to the newest time of a table laid out by ``date``.

    Neither the newest time nor the window opens a file outside the newest folders: their
    dates, given newest first or else from ``folder_dates``, are known when the plan is
    made. Folders may have been named in time zones that lie ``spread_days`` apart. Newest
    folders without any time are passed over; a table without folders by date, or with
    null times only, is read as a whole.
    """
    spread = timedelta(days=spread_days)
    for newest in folder_dates(df) if dates is None else dates:
        top = df.where(F.col("date") >= F.lit(newest - spread))
        if not top.where(F.col("ts").isNotNull()).isEmpty():
            start = top.agg(F.max("ts") - F.expr(f"INTERVAL {hours} HOURS")).scalar()
            first = newest - 2 * spread - timedelta(days=math.ceil(hours / 24))
            return df.where((F.col("date") >= F.lit(first)) & (F.col("ts") > start))
    return last_window(df, hours=hours)


def last_window(
    df: DataFrame,
    as_of: datetime | str | Column | None = None,
    hours: int = 1,
    skip_hours: int = 0,
) -> DataFrame:
    """Rows with ``ts`` in ``(as_of - hours, as_of]``.

    ``skip_hours`` moves the window back. A ``date`` column, if there, is
    filtered as well, which prunes folders; as the folders may have been named in
    another time zone, by a day more on either side.
    """
    back, ahead = hours + skip_hours, skip_hours
    if as_of is None:
        # The interval is taken inside the subquery: a bare value can be
        # pushed down to the scan, an expression over it cannot.
        start = latest_ts(df, f"{back} HOURS")
        end = latest_ts(df, f"{ahead} HOURS") if ahead else None
    else:
        end = as_of_column(df, as_of)
        start = end - F.expr(f"INTERVAL {back} HOURS")
        end = end - F.expr(f"INTERVAL {ahead} HOURS") if ahead else end
    rows = df.where(F.col("ts") > start)
    if end is not None:
        rows = rows.where(F.col("ts") <= end)
    if "date" in df.columns:
        rows = rows.where(F.col("date") >= F.date_sub(F.to_date(start), 1))
        if end is not None:
            rows = rows.where(F.col("date") <= F.date_add(F.to_date(end), 1))
    return rows

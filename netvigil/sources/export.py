"""Writing results and laying telemetry out by date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Text formats cut times to milliseconds unless told otherwise.
_TEXT_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def export(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None, **options
) -> None:
    """Write a result to a new path; an existing one is an error, never overwritten.

    With ``partition_by`` the rows are rebalanced first: AQE gathers each value
    into few files and still splits a value that holds most of the rows.
    """
    if fmt in ("csv", "json"):
        options = {**_TEXT_TIMES, **options}
    if fmt == "csv":
        options = {"header": "true", **options}
    if partition_by is not None:
        df = df.hint("rebalance", partition_by)
    writer = df.write.format(fmt).mode("errorifexists").options(**options)
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.save(path)


def with_date(df: DataFrame) -> DataFrame:
    """Add the ``date`` column by which telemetry is laid out, so time filters prune folders."""
    return df.withColumn("date", F.to_date("ts"))

"""Starting, stopping and resuming a capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start(
    df: DataFrame,
    path: str,
    checkpoint: str,
    fmt: str = "parquet",
    every: str | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Start writing a stream to files; stop it with ``.stop()``.

    A later start with the same ``checkpoint`` goes on where the last one
    stopped, and each row is written once. ``every`` is the trigger interval;
    without it the query takes what is there and ends.
    """
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if name is not None:
        writer = writer.queryName(name)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start(path)


def run_available(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Write what the stream has now, and wait for it."""
    start(df, path, checkpoint, fmt).awaitTermination()

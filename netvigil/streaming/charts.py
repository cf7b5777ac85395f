"""Live charts: counts of a stream kept in a table by pane and read back as the chart.

A stream of counts in update mode names a pane again whenever late rows change it. Each
micro-batch writes the panes it names to a folder of its own, and a reader takes the last
word on each pane. A batch that is repeated replaces its folder, so nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from netvigil.functions.labels import STATUSES
from netvigil.operators.trends import filled_traffic


def keep_panes(
    counts: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Start keeping the panes of a stream of counts in the table at ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def panes(spark: SparkSession, path: str, schema: T.StructType, value: str = "n") -> DataFrame:
    """The last word on each pane: the columns of ``schema``, whose others are the key."""
    keys = [c for c in schema.names if c != value]
    rows = spark.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())]))
    return (
        rows.parquet(path)
        .groupBy(*keys)
        .agg(F.max_by(value, "batch").alias(value))
        .select(*schema.names)
    )


def compact_panes(
    spark: SparkSession, path: str, out: str, schema: T.StructType, value: str = "n"
) -> None:
    """Write the last word on each pane to a new table, as if one batch had named them all.

    A stream that goes on has to be started on the new table; its later batches have
    higher numbers.
    """
    newest = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    panes(spark, path, schema, value).write.mode("errorifexists").parquet(f"{out}/batch={newest}")


def traffic_chart(kept: DataFrame) -> DataFrame:
    """The traffic chart from kept panes (bucket_start, status, n), as ``traffic_5m`` gives it."""
    known = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    counts = kept.groupBy("bucket_start").agg(
        *[F.sum(F.when(F.col("status") == s, F.col("n")).otherwise(0)).alias(s) for s in STATUSES],
        F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("other"),
    )
    return filled_traffic(counts)


def action_shares(windows: DataFrame) -> DataFrame:
    """Shares of the actions in each trailing hour: (window_end, action, n, share).

    ``windows`` are the counts of ``stream_actions``; a window holds a row per action.
    """
    total = F.sum("n").over(Window.partitionBy("window_end"))
    share = F.round(F.col("n").cast("double") / total, 4)
    return windows.select("window_end", "action", "n", share.alias("share"))

"""Joining against lookup tables whose size is measured, not assumed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from netvigil.session import work_path

BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 100_000


def _payload(df: DataFrame) -> Column:
    width = F.lit(0).cast("bigint")
    for name, kind in df.dtypes:
        size = F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(0)
        width = width + size + F.lit(8)
    return F.coalesce(F.sum(width), F.lit(0))


def payload_bytes(df: DataFrame) -> int:
    """Bytes a table holds: 8 per fixed-width value, the text length for strings."""
    return df.agg(_payload(df)).first()[0]


@dataclass(frozen=True)
class Lookup:
    """A lookup table in the shared folder with the bytes it holds."""

    table: DataFrame
    n_bytes: int

    def hinted(self, limit_bytes: int | None = BROADCAST_BYTES) -> DataFrame:
        """The table with a broadcast hint if it holds at most ``limit_bytes``; never for None.

        A larger one comes back without a hint: Spark then shuffles both sides. As the
        table is read from files, an exchange stands right below the join on either side,
        and AQE splits the partitions of hot keys.
        """
        small = limit_bytes is not None and self.n_bytes <= limit_bytes
        return F.broadcast(self.table) if small else self.table


def store_measured(
    df: DataFrame, label: str, path: str | None = None, **totals: Column
) -> tuple[DataFrame, dict[str, int]]:
    """Evaluate a table once, into the shared folder: (the stored table, totals over it).

    The totals are taken while it is written; a total over nothing is 0.
    """
    spark = df.sparkSession
    path = work_path(spark, label) if path is None else path
    seen = Observation()
    df.observe(seen, *[F.coalesce(c, F.lit(0)).alias(n) for n, c in totals.items()]).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


def store_lookup(df: DataFrame, label: str = "lookup", path: str | None = None) -> Lookup:
    """Evaluate a lookup once: its bytes are counted while it is written."""
    table, totals = store_measured(df, label, path, n_bytes=_payload(df))
    return Lookup(table, totals["n_bytes"])


def broadcast_if_small(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it measures at most ``limit_bytes``.

    For a table that is cheap to evaluate twice; see ``store_lookup`` for others, and for
    joins that may meet hot keys.
    """
    return F.broadcast(df) if payload_bytes(df) <= limit_bytes else df


def broadcast_top(df: DataFrame, k: int) -> DataFrame:
    """``df``, known to hold at most ``k`` short rows, hinted for broadcast unless k is large."""
    return F.broadcast(df) if k <= BROADCAST_ROWS else df

"""Enriching a stream by lookup tables that are replaced while it runs.

A lookup joined to a stream in its plan stays as it was when the query started, and so does
the hint to broadcast it. Here every micro-batch takes the newest published version with
the size it was measured at, so that a lookup may grow past the limit of a broadcast
without the stream being stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netvigil.operators.sizing import Lookup, store_lookup

_VERSIONS = "version bigint, path string, n_bytes bigint"
_PINS = "batch bigint, version bigint"


@dataclass(frozen=True)
class LookupVersions:
    """Versions of a lookup table in a shared folder, each complete and never changed.

    A version is listed only after all of it is written, so a publisher that dies leaves
    nothing that a reader could see. One publisher at a time.
    """

    spark: SparkSession
    root: str

    def _listed(self) -> DataFrame:
        # Reading names no files that an earlier reading has cached.
        self.spark.catalog.refreshByPath(f"{self.root}/list")
        return self.spark.read.schema(_VERSIONS).parquet(f"{self.root}/list")

    def create(self) -> LookupVersions:
        """Start without any version; keeps what is there."""
        self.spark.createDataFrame([], _VERSIONS).write.mode("append").parquet(f"{self.root}/list")
        return self

    def newest(self) -> int | None:
        return self._listed().agg(F.max("version")).first()[0]

    def publish(self, prepared: DataFrame) -> int:
        """Add a version from a table of one row per key; returns its number."""
        number = (self.newest() or 0) + 1
        # A path of its own: what an earlier publisher left unlisted is not in the way.
        attempt = self.spark.sql("SELECT uuid()").first()[0]
        path = f"{self.root}/versions/{number}-{attempt}"
        lookup = store_lookup(prepared, path=path)
        row = [(number, path, lookup.n_bytes)]
        self.spark.createDataFrame(row, _VERSIONS).coalesce(1).write.mode("append").parquet(
            f"{self.root}/list"
        )
        return number

    def get(self, version: int) -> Lookup:
        row = self._listed().where(F.col("version") == version).first()
        return Lookup(self.spark.read.parquet(row["path"]), row["n_bytes"])


def enrich_stream(
    stream: DataFrame,
    versions: LookupVersions,
    enrich: Callable[[DataFrame, Lookup], DataFrame],
    path: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Start writing ``enrich(batch, newest lookup)`` to ``path``; read it by ``enriched_rows``.

    A batch notes the version it takes before it writes and has a folder of its own. One
    that is repeated after a failure therefore takes the same version and replaces what it
    had written: each row is there once, as the first attempt would have left it.
    """
    spark = versions.spark
    spark.createDataFrame([], _PINS).write.mode("append").parquet(f"{path}/pins")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark.catalog.refreshByPath(f"{path}/pins")
        pins = spark.read.schema(_PINS).parquet(f"{path}/pins")
        version = pins.where(F.col("batch") == batch_id).agg(F.min("version")).first()[0]
        if version is None:
            version = versions.newest()
            if version is None:
                raise ValueError(f"no version of the lookup in {versions.root}")
            spark.createDataFrame([(batch_id, version)], _PINS).coalesce(1).write.mode(
                "append"
            ).parquet(f"{path}/pins")
        rows = enrich(batch, versions.get(version))
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def enriched_rows(spark: SparkSession, path: str) -> DataFrame:
    """What an enriched stream has written so far."""
    return spark.read.parquet(f"{path}/rows").drop("batch")

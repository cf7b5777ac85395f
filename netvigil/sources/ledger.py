"""Ingest that takes every uploaded file once, whatever is uploaded again or half written.

A ledger names the files that have been taken in, by path, size, modification time and
batch. A run lists what is uploaded, leaves out what the ledger names, parses the rest once
into a folder of its own and only then enters the files, so that a run that dies leaves
nothing a reader would see and is simply repeated. A file that has grown or changed since
(one that was half written when it was taken) is taken again, and its newest state counts.
Files with the same content under two names are one upload: their digest decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netvigil.schemas import FIREWALL
from netvigil.sources.readers import bad_lines, good_records, parse_log_lines

_LEDGER = "path string, size bigint, modified timestamp, digest bigint, lines bigint, batch string"


def _state() -> list:
    """A file as its reading sees it, which may grow meanwhile."""
    fields = {"path": "file_path", "size": "file_size", "modified": "file_modification_time"}
    return [F.col(f"_metadata.{field}").alias(name) for name, field in fields.items()]


class LogLedger:
    """Log files taken in under ``root``. One run at a time."""

    def __init__(
        self, spark: SparkSession, root: str, fmt: str = "json", schema: T.StructType = FIREWALL
    ):
        self.spark, self.root, self.fmt, self.schema = spark, root, fmt, schema
        spark.createDataFrame([], _LEDGER).write.mode("append").parquet(f"{root}/ledger")

    def _ledger(self) -> DataFrame:
        self.spark.catalog.refreshByPath(f"{self.root}/ledger")
        return self.spark.read.schema(_LEDGER).parquet(f"{self.root}/ledger")

    def _uploaded(self, path: str) -> DataFrame:
        """What is there: (name, path, size, modified); content is not read."""
        return self.spark.read.format("binaryFile").load(path).select(
            F.col("path").alias("name"), *_state()
        )

    def ingest(self, path: str) -> int:
        """Take in what is new at ``path``; the number of files taken. Empty files are none."""
        new = self._uploaded(path).join(self._ledger(), ["path", "size", "modified"], "left_anti")
        files = [r["name"] for r in new.collect()]  # of one run; Spark lists them as well
        if not files:
            return 0
        batch = self.spark.sql("SELECT uuid()").first()[0]
        where = f"{self.root}/lines/batch={batch}"
        lines = self.spark.read.text(files).select("value", *_state())
        lines.withColumnRenamed("path", "source_file").write.mode("errorifexists").parquet(where)
        self._enter(where, batch)
        return len(files)

    def _enter(self, where: str, batch: str) -> None:
        # A sum over line hashes and counts: the same for the same lines in any order.
        digest = F.sum(F.xxhash64("value").cast("decimal(38,0)"))
        (
            self.spark.read.parquet(where)
            .groupBy(F.col("source_file").alias("path"), "size", "modified")
            .agg(F.xxhash64(digest, F.count("*")).alias("digest"), F.count("*").alias("lines"))
            .withColumn("batch", F.lit(batch))
            .coalesce(1)
            .write.mode("append")
            .parquet(f"{self.root}/ledger")
        )

    def _counted(self) -> DataFrame:
        """(path, batch): the newest state of each file, one of several with equal lines."""
        newest = Window.partitionBy("path").orderBy(F.desc("modified"), F.desc("size"), "batch")
        equal = Window.partitionBy("digest", "lines").orderBy("path")
        return (
            self._ledger()
            .withColumn("place", F.row_number().over(newest))
            .where("place = 1")
            .withColumn("place", F.row_number().over(equal))
            .where("place = 1")
            .select(F.col("path").alias("source_file"), "batch")
        )

    def records(self) -> tuple[DataFrame, DataFrame]:
        """(good rows, quarantined lines) of all that has been taken in."""
        self.spark.catalog.refreshByPath(f"{self.root}/lines")
        stored = self.spark.read.schema(
            "value string, source_file string, size bigint, modified timestamp, batch string"
        ).parquet(f"{self.root}/lines")
        # The ledger has a row per file: few against the lines.
        lines = stored.join(self._counted(), ["source_file", "batch"], "left_semi")
        parsed = parse_log_lines(lines.select("value", "source_file"), self.fmt, self.schema)
        return good_records(parsed, self.schema), bad_lines(parsed)

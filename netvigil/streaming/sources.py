"""File streams that pick up new telemetry as it lands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netvigil.schemas import FIREWALL, PACKET
from netvigil.sources.readers import parse_log_lines


def _stream(spark, schema, path, fmt, max_files, options):
    if fmt == "csv":
        options = {"header": "true", **options}
    return (
        spark.readStream.schema(schema)
        .format(fmt)
        .options(**options)
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )


def stream_packets(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 1000, **options
) -> DataFrame:
    """Packets from a folder of files."""
    return _stream(spark, PACKET, path, fmt, max_files, options)


def stream_firewall(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 1000, **options
) -> DataFrame:
    """Firewall log from a folder of files."""
    return _stream(spark, FIREWALL, path, fmt, max_files, options)


def stream_log_lines(
    spark: SparkSession,
    path: str,
    fmt: str = "json",
    schema: T.StructType = FIREWALL,
    max_files: int = 1000,
) -> DataFrame:
    """Log lines from a folder, parsed; split with ``good_records`` and ``bad_lines``."""
    lines = (
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .text(path)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )
    return parse_log_lines(lines, fmt, schema)

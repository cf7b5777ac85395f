"""Batch readers with fixed schemas, and log ingest with a quarantine for bad lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netvigil.functions.text import parse_size, parse_ts
from netvigil.schemas import FIREWALL, PACKET

_CORRUPT = "_corrupt_record"
_LINE_END = "netvigil_line_end"


def _read(spark: SparkSession, schema: T.StructType, path: str, fmt: str, options: dict):
    if fmt == "csv":
        options = {"header": "true", **options}
    return spark.read.schema(schema).format(fmt).options(**options).load(path)


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Packet table. A folder laid out by ``date=`` also gives a ``date`` column."""
    return _read(spark, PACKET, path, fmt, options)


def read_firewall(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Firewall log. A folder laid out by ``date=`` also gives a ``date`` column."""
    return _read(spark, FIREWALL, path, fmt, options)


def packets_from_raw(raw: DataFrame, capture_date: str) -> DataFrame:
    """Typed packets from captured text: sizes to bytes, times of day to timestamps."""
    return raw.select(
        "packet_id",
        "ip",
        F.col("port").try_cast("int").alias("port"),
        "protocol",
        parse_size(F.col("size")).alias("size_bytes"),
        "status",
        parse_ts(F.col("time"), capture_date).alias("ts"),
    )


def firewall_from_raw(raw: DataFrame) -> DataFrame:
    """Typed firewall log from text ports and times."""
    return raw.select(
        "ip",
        F.col("port").try_cast("int").alias("port"),
        "action",
        "rule",
        parse_ts(F.col("time")).alias("ts"),
        "severity",
    )


def parse_log_lines(lines: DataFrame, fmt: str = "json", schema: T.StructType = FIREWALL) -> DataFrame:
    """Parse text lines (column ``value``), batch or streaming.

    Fields are read as text and then typed, so a quoted number is as good as a
    bare one; the field of ``ts`` is called ``time`` in a log. Adds ``record``
    (the typed row) and ``is_bad``: the line is not exactly one record of ``fmt``, none of
    its fields is known, or one does not fit its type. Blank lines are no records.
    """
    names = ["time" if f.name == "ts" else f.name for f in schema]
    columns = ", ".join(f"`{name}` string" for name in names)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    if fmt == "json":
        # A JSON parser stops after the first value. In an envelope whose last field has
        # to be met, whatever follows the line's record makes the whole line malformed.
        kinds = f"record struct<{columns}>, {_LINE_END} string, {_CORRUPT} string"
        envelope = F.concat(F.lit('{"record":'), "value", F.lit(f',"{_LINE_END}":"1"}}'))
        parsed = F.from_json(envelope, kinds, options)
        whole = F.col(f"parsed.{_LINE_END}").isNotNull() & ~F.contains("value", F.lit(_LINE_END))
    elif fmt == "csv":
        kinds = f"{columns}, {_CORRUPT} string"
        parsed = F.from_csv("value", kinds, options)
        whole = F.lit(True)
    else:
        raise ValueError(f"unknown log format: {fmt}")
    fields = F.col("parsed.record") if fmt == "json" else F.col("parsed")

    nothing = F.lit(True)
    for name in names:
        nothing = nothing & F.col(f"fields.{name}").isNull()
    typed, misfit = [], F.col(f"parsed.{_CORRUPT}").isNotNull() | ~whole | nothing
    for field, name in zip(schema, names):
        raw = F.col(f"fields.{name}")
        is_time = isinstance(field.dataType, T.TimestampType)
        value = parse_ts(raw) if is_time else raw.try_cast(field.dataType)
        typed.append(value.alias(field.name))
        if not isinstance(field.dataType, T.StringType):
            misfit = misfit | (raw.isNotNull() & F.col(f"record.{field.name}").isNull())
    # Exploding a single element keeps each parse in one place. As plain columns
    # they would be copied into every condition that filters the result.
    return (
        lines.where(F.trim("value") != "")
        .select("*", F.explode(F.array(parsed)).alias("parsed"))
        .select("*", fields.alias("fields"))
        .select("*", F.explode(F.array(F.struct(*typed))).alias("record"))
        .withColumn("is_bad", misfit)
        .drop("parsed", "fields")
    )


def good_records(parsed: DataFrame, schema: T.StructType = FIREWALL) -> DataFrame:
    """The typed rows of lines that parsed."""
    return parsed.where(~F.col("is_bad")).select(*[f"record.{c}" for c in schema.names])


def bad_lines(parsed: DataFrame) -> DataFrame:
    """The quarantined lines, whole, with the file each came from."""
    return parsed.where("is_bad").select(F.col("value").alias("line"), "source_file")


def _parsed_lines(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    lines = spark.read.text(path).withColumn("source_file", F.col("_metadata.file_path"))
    return parse_log_lines(lines, fmt, schema)


def ingest_logs(
    spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = FIREWALL
) -> tuple[DataFrame, DataFrame]:
    """Read uploaded log lines: (good rows, quarantined lines).

    Each of the two parses the lines when it is used; to use both, see ``store_logs``.
    """
    parsed = _parsed_lines(spark, path, fmt, schema)
    return good_records(parsed, schema), bad_lines(parsed)


def store_logs(
    spark: SparkSession, path: str, out: str, fmt: str = "json", schema: T.StructType = FIREWALL
) -> tuple[DataFrame, DataFrame]:
    """As ``ingest_logs``, but parse once, into a new Parquet table split by outcome."""
    when_bad = [F.when(F.col("is_bad"), F.col(c)).alias(c) for c in ("value", "source_file")]
    _parsed_lines(spark, path, fmt, schema).select("is_bad", "record", *when_bad).write.partitionBy(
        "is_bad"
    ).mode("errorifexists").parquet(out)
    record = T.StructField("record", schema)
    text = [T.StructField(c, T.StringType()) for c in ("value", "source_file")]
    outcome = T.StructField("is_bad", T.BooleanType())
    stored = spark.read.schema(T.StructType([record, *text, outcome])).parquet(out)
    return good_records(stored, schema), bad_lines(stored)

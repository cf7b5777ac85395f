"""Canonical table schemas. Every reader and operator speaks these column names."""

from pyspark.sql import types as T

PACKET = T.StructType(
    [
        T.StructField("packet_id", T.LongType()),
        T.StructField("ip", T.StringType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

# Packets as captured: sizes and times are still text ("1.2 KB", "14:23:45").
RAW_PACKET = T.StructType(
    [
        T.StructField("packet_id", T.LongType()),
        T.StructField("ip", T.StringType()),
        T.StructField("port", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("time", T.StringType()),
    ]
)

FIREWALL = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("action", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("severity", T.StringType()),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("severity", T.StringType()),
    ]
)

GEO = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("region", T.StringType()),
    ]
)

GEO_RANGE = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("country", T.StringType()),
    ]
)

REPUTATION = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

INDICATOR = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # "sha256" or "host"
        T.StructField("value", T.StringType()),
    ]
)

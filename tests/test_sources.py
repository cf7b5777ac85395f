"""Readers, writers and log ingest."""

import pytest
from fixtures import firewall, packets
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from netvigil.schemas import FIREWALL, PACKET
from netvigil.session import work_path
from netvigil.sources.export import export, with_date
from netvigil.sources.readers import (
    firewall_from_raw,
    ingest_logs,
    read_firewall,
    read_packets,
    store_logs,
)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_round_trip(spark, fmt):
    p, f = packets(spark), firewall(spark)
    p = p.withColumn("ts", F.col("ts") + F.expr("INTERVAL 123456 MICROSECONDS"))
    for df, read, schema in ((p, read_packets, PACKET), (f, read_firewall, FIREWALL)):
        path = work_path(spark, f"round-{fmt}")
        export(df, path, fmt)
        back = read(spark, path, fmt)
        assert back.columns == schema.names
        assert rows_of(back) == rows_of(df)


def test_export_never_overwrites(spark):
    path = work_path(spark, "once")
    export(packets(spark), path)
    with pytest.raises(AnalysisException):
        export(packets(spark), path)


def test_layout_by_date(spark):
    path = work_path(spark, "dated")
    export(with_date(packets(spark)), path, partition_by="date")
    back = read_packets(spark, path)
    assert back.columns == [*PACKET.names, "date"]
    assert dict(back.dtypes)["date"] == "date"
    assert rows_of(back.drop("date")) == rows_of(packets(spark))
    only = back.where("date = DATE '2026-04-12'")
    assert only.count() == 5


JSON_LINES = [
    '{"ip":"1.1.1.1","port":"22","action":"blocked","rule":"R","time":"2026-04-12 14:23:45","severity":"high"}',
    '{"ip":"1.1.1.2","port":80,"action":"allowed","rule":"R","time":"2026-04-12 14:23:46"}',
    '{"ip":"1.1.1.3","port":"ssh"}',
    '{"ip":"1.1.1.4","time":"yesterday"}',
    '{"ip":"1.1.1.5"',
    "not json",
    "   ",
    "[1]",
]


def test_ingest_json(spark):
    path = work_path(spark, "json")
    export(spark.createDataFrame([(x,) for x in JSON_LINES], "value string"), path, "text")
    good, bad = ingest_logs(spark, path)
    assert good.columns == FIREWALL.names
    assert [t for _, t in good.dtypes] == [f.dataType.simpleString() for f in FIREWALL]
    assert rows_of(good.select("ip", "port", "severity")) == [
        ("1.1.1.1", 22, "high"), ("1.1.1.2", 80, None),
    ]
    lines = [r["line"] for r in bad.collect()]
    assert sorted(lines) == sorted(x for x in JSON_LINES[2:] if x.strip())
    assert bad.count() == 5 and good.count() == 2
    assert all(r["source_file"].endswith(".txt") for r in bad.collect())


def test_stored_ingest_gives_the_same(spark):
    path, out = work_path(spark, "json"), work_path(spark, "stored")
    export(spark.createDataFrame([(x,) for x in JSON_LINES], "value string"), path, "text")
    for stored, read in zip(store_logs(spark, path, out), ingest_logs(spark, path)):
        assert stored.dtypes == read.dtypes
        assert rows_of(stored) == rows_of(read)
    good, _ = store_logs(spark, path, work_path(spark, "stored"))
    text = good._jdf.queryExecution().executedPlan().toString()
    assert "is_bad" in text.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(AnalysisException):
        store_logs(spark, path, out)


def test_a_date_with_most_rows_is_split_over_files(spark):
    rows = spark.range(30_000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("x"),
        F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("d"),
    )
    path = work_path(spark, "hot")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
    try:
        export(rows.repartition(16), path, partition_by="d")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    stored = spark.read.parquet(path)
    files = stored.select("d", F.input_file_name().alias("f")).distinct().groupBy("d").count()
    per_value = {r["d"]: r["count"] for r in files.collect()}
    assert stored.count() == 30_000
    assert per_value["hot"] > 1
    # Values that share the hot one's partition are split with it; most are in one file.
    others = sorted(n for d, n in per_value.items() if d != "hot")
    assert others[len(others) // 2] == 1


def test_ingest_csv(spark):
    lines = [
        "1.1.1.1,22,blocked,R,2026-04-12 14:23:45,high",
        "1.1.1.2,x,blocked,R,2026-04-12 14:23:45,high",
        "1.1.1.3,22,blocked,R,2026-04-12 99:23:45,high",
        "1.1.1.4,22",
        '"1.1.1.5",443,allowed,"A,B",2026-04-12 14:23:45,low',
    ]
    path = work_path(spark, "csv")
    export(spark.createDataFrame([(x,) for x in lines], "value string"), path, "text")
    good, bad = ingest_logs(spark, path, "csv")
    assert rows_of(good.select("ip", "rule")) == [("1.1.1.1", "R"), ("1.1.1.5", "A,B")]
    assert sorted(r["line"] for r in bad.collect()) == sorted(lines[1:4])
    with pytest.raises(ValueError):
        ingest_logs(spark, path, "xml")


def test_firewall_from_raw(spark):
    raw = firewall(spark).select(
        "ip",
        F.col("port").cast("string").alias("port"),
        "action",
        "rule",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
        "severity",
    )
    assert rows_of(firewall_from_raw(raw)) == rows_of(firewall(spark))


def test_work_path_is_in_the_shared_folder(spark):
    path = work_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert work_path(spark, "x") != path

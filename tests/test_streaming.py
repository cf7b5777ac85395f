"""Streams against their batch counterparts, late rows, and stopping and resuming."""

import time

import pytest
from fixtures import firewall, packets, traffic
from pyspark.sql import functions as F

from netvigil.operators import enrich
from netvigil.operators.trends import traffic_5m
from netvigil.session import work_path
from netvigil.sources.readers import bad_lines, good_records
from netvigil.streaming import operators as streams
from netvigil.streaming.lifecycle import run_available, start
from netvigil.streaming.sources import stream_firewall, stream_log_lines, stream_packets


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def run(spark, stream):
    path = work_path(spark, "stream")
    run_available(stream, f"{path}/rows", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@pytest.fixture(scope="module")
def landed(spark):
    rows = [
        (f"10.0.0.{i % 9}", "SSH", ("normal", "suspicious", "malicious")[i % 3], i * 37)
        for i in range(2000)
    ]
    df = traffic(spark, rows)
    path = work_path(spark, "landed")
    # Several files in order of time, one per micro-batch.
    for part in range(4):
        df.where(F.floor(F.col("packet_id") / 500) == part).coalesce(1).write.mode("append").parquet(path)
    return path, df


def closed_before(df):
    return df.agg(F.max("ts") - F.expr("INTERVAL 10 MINUTES")).first()[0]


def test_stream_traffic_equals_batch_for_closed_windows(spark, landed):
    path, df = landed
    got = run(spark, streams.stream_traffic(stream_packets(spark, path, max_files=1)))
    wide = traffic_5m(df).where(
        F.col("bucket_start") + F.expr("INTERVAL 5 MINUTES") <= F.lit(closed_before(df))
    )
    batch = wide.unpivot(["bucket_start"], ["normal", "suspicious", "malicious"], "status", "n")
    assert rows_of(got) == rows_of(batch.where("n > 0"))


def test_stream_actions_equals_batch_for_closed_windows(spark, landed):
    path, df = landed
    f = df.select("ip", "port", F.when(F.col("status") == "malicious", "blocked").otherwise(
        "allowed").alias("action"), "status", "ts")
    stream = stream_packets(spark, path, max_files=1).withColumn(
        "action", F.when(F.col("status") == "malicious", "blocked").otherwise("allowed")
    )
    got = run(spark, streams.stream_actions(stream))
    batch = (
        f.groupBy(F.window("ts", "1 hour", "5 minutes"), "action")
        .agg(F.count("*").alias("n"))
        .select("window.start", "window.end", "action", "n")
        .where(F.col("end") <= F.lit(closed_before(df)))
    )
    assert rows_of(got) == rows_of(batch)


def test_stream_suspicious_ips(spark, landed):
    path, df = landed
    got = run(spark, streams.stream_suspicious_ips(stream_packets(spark, path, max_files=1)))
    full = [n for _, n in rows_of(got)][11:]
    assert full and set(full) == {3}


def test_late_rows_are_dropped_once_behind_the_watermark(spark):
    folder = work_path(spark, "late")
    out = work_path(spark, "late-out")
    for rows in (
        [("a", "SSH", "normal", 0), ("a", "SSH", "normal", 7200)],
        [("b", "SSH", "normal", 1)],  # two hours late
        [("c", "SSH", "normal", 7100), ("c", "SSH", "normal", 14400)],  # within the delay
    ):
        traffic(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        stream = streams.stream_traffic(stream_packets(spark, folder))
        run_available(stream, f"{out}/rows", f"{out}/checkpoint")
    got = spark.read.parquet(f"{out}/rows")
    assert sorted(r["n"] for r in got.collect()) == [1, 1, 1]


def test_alert_stream_equals_batch_and_can_be_enriched(spark, landed):
    path, df = landed
    got = run(spark, streams.alert_stream(stream_packets(spark, path)))
    assert rows_of(got) == rows_of(streams.alert_rows(df))
    assert {r["severity"] for r in got.select("severity").distinct().collect()} == {"critical", "high"}
    geo = spark.createDataFrame([("10.0.0.1", "RU")], "ip string, country string")
    placed = run(spark, enrich.geo_enrich(streams.alert_stream(stream_packets(spark, path)), geo))
    assert rows_of(placed) == rows_of(enrich.geo_enrich(streams.alert_rows(df), geo))


def test_alert_rows(spark):
    got = streams.alert_rows(packets(spark)).select("type", "ip", "severity")
    assert rows_of(got) == [
        ("MALICIOUS HTTP/HTTPS", "172.16.0.88", "critical"),
        ("SUSPICIOUS Other", "10.1.1.23", "high"),
        ("SUSPICIOUS SSH", "10.0.0.234", "high"),
    ]


def test_stop_and_resume_writes_each_row_once(spark):
    folder, out = work_path(spark, "capture"), work_path(spark, "capture-out")
    log = firewall(spark)
    log.where("action = 'blocked'").write.mode("append").parquet(folder)
    query = start(
        stream_firewall(spark, folder), f"{out}/rows", f"{out}/checkpoint", every="1 second", name="capture"
    )
    query.processAllAvailable()
    assert query.isActive and query.name == "capture"
    query.stop()
    assert not query.isActive
    log.where("action = 'allowed'").write.mode("append").parquet(folder)
    time.sleep(1)
    assert spark.read.parquet(f"{out}/rows").count() == 4
    run_available(stream_firewall(spark, folder), f"{out}/rows", f"{out}/checkpoint")
    assert rows_of(spark.read.parquet(f"{out}/rows")) == rows_of(log)


def test_stream_ingest_quarantines_bad_lines(spark):
    folder = work_path(spark, "lines")
    lines = ['{"ip":"1.1.1.1","port":"22"}', '{"ip":"1.1.1.2","port":"x"}', "junk"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(folder)
    good = run(spark, good_records(stream_log_lines(spark, folder)))
    bad = run(spark, bad_lines(stream_log_lines(spark, folder)))
    assert [r["ip"] for r in good.collect()] == ["1.1.1.1"]
    assert sorted(r["line"] for r in bad.collect()) == sorted(lines[1:])

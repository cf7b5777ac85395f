"""Charts: kept panes of streams, sketches, bounds and gaps, and the dashboard from states."""

import random
from datetime import date

import pytest
from compare import normalise
from fixtures import traffic
from pyspark.sql import functions as F

from netvigil.operators import aggregates, filters, trends
from netvigil.plans import rollup as r
from netvigil.streaming import charts
from netvigil.streaming import operators as streams


def same(a, b):
    return normalise(a.columns, a.collect()) == normalise(b.columns, b.collect())


def test_far_stray_time_is_dealt_to_tasks(spark):
    packets = traffic(spark, [("10.0.0.1", "SSH", "normal", 0), ("10.0.0.1", "SSH", "odd", 3 * 365 * 86400)])
    counts = trends.traffic_5m(packets)
    spine = trends._spine(counts, "bucket_start", "5 minutes")
    sizes = [n["count"] for n in spine.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3 * 365 * 288 + 1 and max(sizes) < sum(sizes) / 3
    total = counts.agg(*[F.sum(s).alias(s) for s in trends.SERIES]).first()
    assert sum(total) == packets.count() and total["other"] == 1


def test_bounds_of_a_chart(spark):
    packets = traffic(spark, [("a", "SSH", "normal", m * 60) for m in (1, 2, 31, 59, 60)])
    origin = packets.agg(F.min("ts")).first()[0].replace(minute=0, second=0)
    start, end = str(origin.replace(minute=30)), str(origin.replace(hour=origin.hour + 1))
    rows = {x["bucket_start"]: x["normal"] for x in trends.traffic_5m(packets, start, end).collect()}
    assert len(rows) == 6 and sum(rows.values()) == 2
    assert trends.traffic_5m(packets.limit(0), start, end).count() == 6
    assert trends.traffic_5m(packets.limit(0)).count() == 0
    hours = trends.hourly_delta(packets, str(origin), end).collect()
    assert [(h["n"], h["delta"]) for h in hours] == [(4, 4)]


def test_newest_time_of_folders_named_in_two_zones(spark, tmp_path):
    rows = [("2024-01-05", "2024-01-05 23:50:00"), ("2024-01-06", "2024-01-05 23:00:00")]
    rows += [("2024-01-04", "2024-01-04 10:00:00")]
    df = spark.createDataFrame(rows, "date string, ts string").select(
        F.col("date").cast("date"), F.col("ts").cast("timestamp")
    )
    df.write.partitionBy("date").parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    newest = table.limit(1).select(filters.latest_ts(table).alias("t")).first()["t"]
    assert (newest.hour, newest.minute) == (23, 50)


def test_sketch_of_many_addresses_is_near(spark, tmp_path):
    n = 20_000
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("ip"),
        F.lit("suspicious").alias("status"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 3000).alias("ts"),
    )
    late = rows.limit(1).select("ip", "status", F.timestamp_seconds(F.lit(1704067200 + 90000)).alias("ts"))
    rows.unionByName(late).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = streams.stream_suspicious_ips(stream)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c")
    query.trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    top = spark.read.parquet(f"{tmp_path}/out").agg(F.max("suspicious_ips")).first()[0]
    assert abs(top - n) < 4 * 0.013 * n


def test_many_addresses_are_counted_exactly(spark, tmp_path):
    n = 6000
    rows = spark.range(2 * n).select(  # every address twice, in panes half an hour apart
        F.when(F.col("id") % n != 0, (F.col("id") % n).cast("string")).alias("ip"),
        F.lit("suspicious").alias("status"),
        F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("id") / n) * 1800).alias("ts"),
    )
    late = rows.limit(1).select("ip", "status", F.timestamp_seconds(F.lit(1704067200 + 90000)).alias("ts"))
    rows.unionByName(late).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")

    def counts(label, **kw):
        query = streams.stream_suspicious_ips(stream, **kw).writeStream.format("parquet")
        query = query.option("checkpointLocation", f"{tmp_path}/c-{label}").trigger(availableNow=True)
        query.start(f"{tmp_path}/{label}").awaitTermination()
        return [r["suspicious_ips"] for r in spark.read.parquet(f"{tmp_path}/{label}").collect()]

    assert counts("exact") == [n - 1] * 18
    assert all(abs(c - n) < 4 * 0.013 * n for c in counts("sketched", precision=12))


def test_late_panes_are_replaced_and_repeats_count_once(spark, tmp_path):
    first = traffic(spark, [("a", "SSH", "normal", m * 60) for m in (0, 1, 7)])
    schema = first.schema
    first.coalesce(1).write.parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        counts = streams.stream_traffic(stream)
        charts.keep_panes(counts, f"{tmp_path}/panes", f"{tmp_path}/c").awaitTermination()
        return charts.panes(spark, f"{tmp_path}/panes", counts.schema), counts.schema

    run()
    traffic(spark, [("a", "SSH", "normal", m * 60) for m in (2, 16)]).coalesce(1).write.mode(
        "append"
    ).parquet(f"{tmp_path}/in")
    kept, pane_schema = run()
    everything = spark.read.schema(schema).parquet(f"{tmp_path}/in")
    assert same(charts.traffic_chart(kept), trends.traffic_5m(everything))
    assert [x["normal"] for x in charts.traffic_chart(kept).orderBy("bucket_start").collect()] == [3, 1, 0, 1]
    charts.compact_panes(spark, f"{tmp_path}/panes", f"{tmp_path}/short", pane_schema)
    again = charts.panes(spark, f"{tmp_path}/short", pane_schema)
    assert same(again, kept)
    with pytest.raises(Exception, match="already exists"):
        charts.compact_panes(spark, f"{tmp_path}/panes", f"{tmp_path}/short", pane_schema)


@pytest.fixture(scope="module")
def busy(spark):
    rng = random.Random(5)
    rows = [
        (f"10.0.0.{rng.randrange(30)}", rng.choice(["HTTP", "SSH", "odd"]),
         rng.choice(["normal", "suspicious", "malicious", "odd"]), rng.randrange(3 * 86400))
        for _ in range(4000)
    ]
    return traffic(spark, rows).cache()


@pytest.mark.parametrize("shift", [0, 17, 300])
def test_dashboard_from_states_equals_the_telemetry(spark, busy, tmp_path, shift):
    """Also where the trailing hours begin on a border of five minutes."""
    last = busy.agg(F.max("ts")).first()[0]
    border = last.replace(second=0, microsecond=0)
    border = border.replace(minute=border.minute // 5 * 5)
    packets = busy.where(F.col("ts") <= F.lit(border) + F.expr(f"INTERVAL {shift} SECONDS")).unionByName(
        busy.limit(1).withColumn("ts", F.lit(border) + F.expr(f"INTERVAL {shift} SECONDS"))
    )
    kept = r.Rollup(spark, f"{tmp_path}/states", packets.schema["ts"].dataType)
    kept.refresh(packets)
    geo = spark.createDataFrame([("10.0.0.1", "A"), ("10.0.0.1", "B")], "ip string, country string")
    parts = r.dashboard(kept, packets, geo)
    assert same(parts["threat_score"], aggregates.threat_score(packets))
    assert same(parts["kpi_cards"], aggregates.kpi_cards(packets))
    assert same(parts["traffic"], trends.traffic_5m(packets))
    assert same(parts["hourly_delta"], trends.hourly_delta(packets))
    assert same(parts["protocol_share"], aggregates.protocol_share(packets))
    assert same(parts["top_malicious"], aggregates.top_malicious(packets, geo))
    assert same(parts["all_malicious"], aggregates.top_malicious(packets, geo, k=1000))


def test_refresh_replaces_only_its_dates(spark, busy, tmp_path):
    kept = r.Rollup(spark, f"{tmp_path}/states", busy.schema["ts"].dataType)
    days = sorted(x["d"] for x in busy.select(F.to_date("ts").alias("d")).distinct().collect())
    assert isinstance(days[0], date) and len(days) >= 3
    kept.refresh(busy.where(F.to_date("ts") != days[1]))

    def files():
        return {f for f in kept.read().inputFiles() if f"date={days[0]}" in f}

    before = files()
    for _ in range(2):  # a repeated refresh changes nothing
        kept.refresh(busy, [days[1]])
    assert files() == before and before
    assert same(kept.read().drop("date"), r.states(busy))
    halves = r.merge_states(r.states(busy.where("packet_id % 2 = 0")), r.states(busy.where("packet_id % 2 = 1")))
    assert same(halves, r.states(busy))

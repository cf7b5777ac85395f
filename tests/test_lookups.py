"""Lookups: stored once, measured, one row per key, hot keys split, refreshed on streams."""

import random

import pytest
from fixtures import traffic
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_skew import rows_of, shuffled, skewed  # noqa: F401

from netvigil.functions.text import long_to_ip
from netvigil.operators import correlate, enrich, trends
from netvigil.operators.bitfilter import key_filter
from netvigil.operators.sizing import store_lookup
from netvigil.streaming.lookups import LookupVersions, enrich_stream, enriched_rows

SKEW = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
}


def test_lookup_is_measured_while_it_is_written(spark):
    df = spark.createDataFrame([("ab", 1), (None, 2)], "s string, n int")
    lookup = store_lookup(df)
    assert lookup.n_bytes == 2 * 16 + 2 and rows_of(lookup.table) == rows_of(df)
    assert store_lookup(df.limit(0)).n_bytes == 0

    def is_hinted(limit):
        return "broadcast" in lookup.hinted(limit)._jdf.queryExecution().logical().toString()

    assert is_hinted(34) and not is_hinted(33) and not is_hinted(None)


def test_hot_address_is_split_for_scores(spark, skewed, shuffled):  # noqa: F811
    scores = spark.range(700).select(
        long_to_ip(F.lit(167772160) + F.col("id")).alias("ip"), (F.col("id") % 9).cast("double").alias("score")
    )
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    try:
        facts = skewed.repartition(16).select("packet_id", "ip", "ts", "protocol")
        joined = enrich.reputation_enrich(facts, scores.unionByName(scores), None)
        rows = joined.collect()
        text = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in SKEW:
            spark.conf.unset(key)
    assert len(rows) == skewed.count()
    assert "SortMergeJoin(skew=true)" in text


def test_repeated_places_change_no_count(spark):
    packets = traffic(spark, [("10.0.0.1", "SSH", "malicious", i * 86400) for i in range(10)] * 3)
    geo = spark.createDataFrame(
        [("10.0.0.1", "B", "r"), ("10.0.0.1", "A", "s")], "ip string, country string, region string"
    )
    for limit in (None, 1 << 20):
        counts = trends.bucket_counts(packets, geo, "1 day", limit)
        assert {(r["region"], r["n"]) for r in counts.collect()} == {("s", 3)}
    scores = spark.createDataFrame([("10.0.0.1", 1.0), ("10.0.0.1", 3.0)], "ip string, score double")
    odd = packets.withColumn("status", F.when(F.col("packet_id") % 3 == 0, "odd").otherwise(F.col("status")))
    log = packets.select("ip", "ts", F.lit("blocked").alias("action"))
    ips = spark.createDataFrame([("10.0.0.1",), ("10.0.0.1",), ("10.9.9.9",), (None,)], "ip string")
    for limit in (None, 1 << 20):
        found = {
            r["ip"]: r for r in correlate.ip_profile(odd, log, geo, ips, scores, limit).collect()
        }
        assert set(found) == {"10.0.0.1", "10.9.9.9"}
        one = found["10.0.0.1"]
        assert (one["packets"], one["country"], one["score"], one["blocked"]) == (30, "A", 3.0, 30)
        assert one["normal"] + one["suspicious"] + one["malicious"] + one["other"] == 30
        assert one["other"] > 0 and found["10.9.9.9"]["packets"] == 0


def test_spikes_of_huge_counts(spark):
    days = [(10**12 + d % 2, d) for d in range(8)] + [(3 * 10**12, 8)]
    counts = spark.createDataFrame(days, "n bigint, day int").select(
        F.lit("SSH").alias("protocol"),
        F.lit("r").alias("region"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, day)").alias("bucket_start"),
        "n",
    )
    found = trends.spikes_of(counts, counts.agg(F.min("bucket_start")).scalar(), "1 day", 7, 2.0)
    (spike,) = [r for r in found.collect() if r["n"] == 3 * 10**12]
    assert spike["mean"] == pytest.approx(10**12 + 4 / 7) and spike["stddev"] == pytest.approx(0.5345, abs=1e-4)


@pytest.mark.parametrize("limit", [None, 1 << 20])
def test_nested_ranges_against_brute_force(spark, limit):
    rng = random.Random(12)
    ranges = [(0, 2**32 - 1, "all"), (9, 4, "upside down"), (5, 2**20, None)]
    for i in range(120):
        start = rng.randrange(2**24)
        width = rng.choice([1, 7, 256, 300, rng.randrange(1, 2**16), 2**16, rng.randrange(1, 2**22)])
        ranges.append((start, start + width - 1, f"C{i}"))
    ranges += [(ranges[5][0], ranges[5][1], "A first"), ranges[9], ranges[9]]
    probes = {0, 2**32 - 1}
    for start, end, _ in ranges:
        probes |= {max(start - 1, 0), start, (start + end) // 2, end, end + 1}
    probes = sorted(p for p in probes if p < 2**32)

    def brute(n):
        held = [(e - s, c) for s, e, c in ranges if s <= n <= e and c is not None]
        return min(held)[1]

    df = spark.createDataFrame([(n,) for n in probes], "ip_long bigint").repartition(3)
    table = spark.createDataFrame(ranges, "start bigint, end bigint, country string")
    got = enrich.geo_enrich_ranges(df, table, limit).collect()
    assert sorted((r["ip_long"], r["country"]) for r in got) == [(n, brute(n)) for n in probes]
    flat = enrich.flat_ranges(table).orderBy("lo").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(flat[:-1], flat[1:], strict=True))


def test_ranges_of_nothing(spark):
    df = spark.createDataFrame([(7,)], "ip_long bigint")
    empty = spark.createDataFrame([], "start bigint, end bigint, country string")
    assert [r["country"] for r in enrich.geo_enrich_ranges(df, empty).collect()] == ["-"]


def test_key_filter_loses_nothing(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), F.col("id") * 3).alias("key"))
    may_contain = key_filter(keys, "key", bits=16)
    rows = spark.range(12000).select(F.concat(F.lit("k"), "id").alias("key"))
    passed = {r["key"] for r in rows.where(may_contain(F.col("key"))).collect()}
    wanted = {f"k{3 * i}" for i in range(4000)}
    assert wanted <= passed and len(passed - wanted) < 1200
    nothing = key_filter(keys.limit(0), "key", bits=10)
    assert rows.where(nothing(F.col("key"))).count() == 0
    assert spark.createDataFrame([(None,)], "key string").where(may_contain(F.col("key"))).count() == 0


@pytest.mark.parametrize("limit", [None, 1 << 20])
def test_timeline_of_addresses(spark, limit):
    packets = traffic(spark, [(f"10.0.0.{i % 5}", "SSH", "malicious", i) for i in range(40)])
    log = packets.select("ip", "ts", F.lit("SSH-BLOCK").alias("rule"), F.lit("high").alias("severity"))
    alerts = packets.select("ip", "ts", F.lit("T").alias("type"), F.lit("low").alias("severity"))
    ips = spark.createDataFrame([("10.0.0.2",), ("10.0.0.4",), (None,)], "ip string")
    got = correlate.timeline_of(packets, log, alerts, ips, limit)
    every = correlate.timeline(packets, log, alerts).where("ip IN ('10.0.0.2', '10.0.0.4')")
    assert rows_of(got) == rows_of(every) and got.count() == 48


def test_unscanned_and_hashed_are_all_rows(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "x" * 30)], "doc_id int, content string")
    left = enrich.unscanned(docs, max_bytes=10)
    assert rows_of(left) == [(2, None, "missing"), (3, 30, "oversize")]
    bad = docs.where("content IS NOT NULL").select(
        F.lit("sha256").alias("kind"), F.sha2("content", 256).alias("value")
    )
    assert [r["doc_id"] for r in enrich.match_hashes(docs, bad, max_bytes=10).collect()] == [1]
    assert enrich.match_hashes(docs, bad, max_bytes=30).count() == 2


def _geo(spark, n, name):
    return spark.range(n).select(
        F.concat(F.lit("10.0.0."), "id").alias("ip"), F.lit(name).alias("country")
    )


def test_stream_takes_new_versions_and_outgrows_the_broadcast(spark, tmp_path):
    versions = LookupVersions(spark, f"{tmp_path}/lookup").create()
    limit, plans = None, []

    def join(batch, known):
        out = enrich.geo_enrich(batch, known, limit)
        plans.append("ResolvedHint (strategy=broadcast)" in out._jdf.queryExecution().analyzed().toString())
        return out

    for i, (size, name) in enumerate([(3, "old"), (200, "new")]):
        versions.publish(enrich.geo_lookup(_geo(spark, size, name)).table)
        limit = versions.get(1).n_bytes
        rows = spark.range(5).select((F.col("id") + 10 * i).alias("n"), F.concat(F.lit("10.0.0."), "id").alias("ip"))
        rows.write.mode("append").parquet(f"{tmp_path}/landed")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/landed")
        enrich_stream(stream, versions, join, f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    assert plans == [True, False]
    got = {r["n"]: r["country"] for r in enriched_rows(spark, f"{tmp_path}/out").collect()}
    assert got == {**{n: "old" if n < 3 else "-" for n in range(5)}, **{10 + n: "new" for n in range(5)}}


def test_repeated_batch_keeps_its_version_and_writes_once(spark, tmp_path):
    versions = LookupVersions(spark, f"{tmp_path}/lookup").create()
    versions.publish(enrich.geo_lookup(_geo(spark, 5, "first")).table)
    spark.range(5).select(F.concat(F.lit("10.0.0."), "id").alias("ip")).write.parquet(f"{tmp_path}/landed")
    stream = spark.readStream.schema("ip string").parquet(f"{tmp_path}/landed")
    fails = [True]

    def join(batch, known):
        out = enrich.geo_enrich(batch, known)
        if fails:
            # What a first attempt had written is replaced by the second.
            out.write.parquet(f"{tmp_path}/out/rows/batch=0")
            fails.clear()
            raise RuntimeError("lost")
        return out

    with pytest.raises(StreamingQueryException):
        enrich_stream(stream, versions, join, f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    versions.publish(enrich.geo_lookup(_geo(spark, 5, "second")).table)
    enrich_stream(stream, versions, join, f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    assert [r["country"] for r in enriched_rows(spark, f"{tmp_path}/out").collect()] == ["first"] * 5


def test_stream_without_a_version_is_an_error(spark, tmp_path):
    versions = LookupVersions(spark, f"{tmp_path}/lookup").create()
    assert versions.newest() is None
    spark.range(1).write.parquet(f"{tmp_path}/landed")
    stream = spark.readStream.schema("id bigint").parquet(f"{tmp_path}/landed")
    with pytest.raises(StreamingQueryException):
        enrich_stream(stream, versions, lambda b, k: b, f"{tmp_path}/out", f"{tmp_path}/m").awaitTermination()

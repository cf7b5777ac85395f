"""Large lookups and hot keys: same answers as the broadcast way, and hot partitions are split."""

import random

import pytest
from fixtures import traffic
from pyspark.sql import functions as F

from netvigil.functions.text import long_to_ip
from netvigil.operators import correlate, enrich, trends
from netvigil.operators.sizing import broadcast_if_small, payload_bytes

NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture()
def shuffled(spark):
    """No broadcast unless hinted, as with a lookup table that is really large."""
    for key, value in NO_BROADCAST.items():
        spark.conf.set(key, value)
    yield
    for key in NO_BROADCAST:
        spark.conf.unset(key)


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all packets come from one address."""
    rng = random.Random(7)
    rows = [
        (
            "10.0.0.1" if i % 3 == 0 else f"10.0.{rng.randrange(4)}.{rng.randrange(200)}",
            rng.choice(["HTTPS", "SSH", "DNS"]),
            rng.choice(["normal", "suspicious", "malicious"]),
            rng.randrange(10 * 86400),
        )
        for i in range(6000)
    ]
    return traffic(spark, rows).cache()


@pytest.fixture(scope="module")
def geo(spark):
    return spark.range(700).select(
        long_to_ip(F.lit(167772160) + F.col("id")).alias("ip"),
        F.concat(F.lit("C"), F.col("id") % 9).alias("country"),
        F.concat(F.lit("R"), F.col("id") % 4).alias("region"),
    )


def test_size_is_measured(spark):
    df = spark.createDataFrame([("ab", 1), (None, 2)], "s string, n int")
    assert payload_bytes(df) == 2 * 16 + 2
    assert payload_bytes(df.where("false")) == 0
    hinted = broadcast_if_small(df, 100)._jdf.queryExecution().logical().toString()
    plain = broadcast_if_small(df, 10)._jdf.queryExecution().logical().toString()
    assert "broadcast" in hinted and "broadcast" not in plain


def test_large_lookups_give_the_same_rows(spark, skewed, geo, shuffled):
    assert rows_of(enrich.geo_enrich(skewed, geo, 0)) == rows_of(enrich.geo_enrich(skewed, geo))
    rep = geo.select("ip", F.lit(1).alias("score"))
    assert rows_of(enrich.reputation_enrich(skewed, rep, 0)) == rows_of(
        enrich.reputation_enrich(skewed, rep)
    )
    assert rows_of(trends.bucket_counts(skewed, geo, "1 day", 0)) == rows_of(
        trends.bucket_counts(skewed, geo, "1 day")
    )
    log = skewed.select("ip", "ts", F.lit("blocked").alias("action"))
    ips = geo.select("ip")
    assert rows_of(correlate.ip_profile(skewed, log, geo, ips, limit_bytes=0)) == rows_of(
        correlate.ip_profile(skewed, log, geo, ips)
    )


def test_hot_address_is_split_in_a_shuffled_lookup(spark, skewed, geo, shuffled):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
    }
    expected = skewed.count()
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        facts = skewed.repartition(16).select("packet_id", "ip", "ts", "protocol")
        joined = enrich.geo_enrich(facts, geo, 0)
        rows = joined.collect()
        text = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert len(rows) == expected
    assert "SortMergeJoin(skew=true)" in text


def test_copies_of_one_text_match_once_each(spark, shuffled):
    """A third of the documents are copies of one known-bad text."""
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "bad").otherwise(F.col("id").cast("string")).alias("content"),
    )
    ind = spark.createDataFrame([("bad",), ("7",), ("absent",)], "t string").select(
        F.lit("sha256").alias("kind"), F.sha2("t", 256).alias("value")
    )
    for limit in (0, 1 << 20):
        assert enrich.match_hashes(docs, ind, limit_bytes=limit).count() == 1001


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_ranges_against_brute_force(spark, shuffled, limit):
    """Random ranges of every width, some over several /16 blocks, probed at their edges."""
    rng = random.Random(11)
    ranges, at = [], 0
    while at < 2**32 - 2**22:
        start = at + rng.choice([0, 1, rng.randrange(2**20), rng.randrange(2**26)])
        width = rng.choice([1, 2, 256, rng.randrange(1, 2**12), 2**16, rng.randrange(1, 2**22)])
        end = min(start + width - 1, 2**32 - 1)
        if start > end:
            break
        ranges.append((start, end, f"C{len(ranges)}"))
        at = end + 1
        if len(ranges) == 150:
            at = 2**32
    ranges.append((5, 4, "upside down"))
    probes = {0, 2**32 - 1}
    for start, end, _ in ranges:
        probes |= {max(start - 1, 0), start, (start + end) // 2, end, min(end + 1, 2**32 - 1)}
    probes |= {rng.randrange(2**32) for _ in range(300)}

    def brute(n):
        return next((c for s, e, c in ranges if s <= n <= e), "-")

    df = spark.createDataFrame([(n,) for n in sorted(probes)], "ip_long bigint")
    table = spark.createDataFrame(ranges, "start bigint, end bigint, country string")
    got = {r["ip_long"]: r["country"] for r in enrich.geo_enrich_ranges(df, table, limit).collect()}
    assert got == {n: brute(n) for n in probes}


def test_range_lookup_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (1, 5)], "packet_id int, ip_long bigint")
    ranges = spark.createDataFrame([(0, 9, "A")], "start bigint, end bigint, country string")
    out = enrich.geo_enrich_ranges(df, ranges)
    assert out.columns == ["packet_id", "ip_long", "country"]
    assert rows_of(out) == [("-", None, 1), ("A", 5, 1), ("A", 5, 1)]

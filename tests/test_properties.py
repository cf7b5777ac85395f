"""Expressions and operators against plain Python on many random values."""

import random
from collections import Counter
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

from fixtures import traffic
from pyspark.sql import functions as F

from netvigil.functions import text
from netvigil.operators import aggregates, trends

START = datetime(2026, 4, 12)


def test_sizes(spark):
    rng = random.Random(1)
    units = ["B", "KB", "MB", "GB", "TB", "kb", "Mb"]
    rows = [(i, f"{rng.randrange(10**4)}.{rng.randrange(10)}", rng.choice(units)) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, number string, unit string").select(
        "i", text.parse_size(F.concat_ws(" ", "number", "unit")).alias("b")
    )
    got = {r["i"]: r["b"] for r in df.collect()}
    for i, number, unit in rows:
        power = ["B", "KB", "MB", "GB", "TB"].index(unit.upper())
        exact = Decimal(number) * 1024**power
        assert got[i] == int(exact.quantize(Decimal(1), ROUND_HALF_UP))


def test_size_text_is_read_back(spark):
    df = spark.range(0, 100_000, 37).select(
        "id", text.parse_size(text.format_size(F.col("id"))).alias("b")
    )
    # Half of the last shown digit, a tenth of a KB.
    assert df.where(F.abs(F.col("b") - F.col("id")) > 52).count() == 0
    assert df.where((F.col("id") < 1024) & (F.col("b") != F.col("id"))).count() == 0


def test_compact_counts_never_show_a_thousand(spark):
    rng = random.Random(2)
    numbers = [10**e + d for e in range(12) for d in (-51, -50, -1, 0, 1)] + [
        rng.randrange(10**11) for _ in range(300)
    ]
    df = spark.createDataFrame([(n,) for n in numbers if n >= 0], "n bigint").select(
        "n", text.format_count(F.col("n")).alias("s")
    )
    scale = {"K": 10**3, "M": 10**6, "B": 10**9}
    for r in df.collect():
        if r["n"] < 1000:
            assert r["s"] == str(r["n"])
            continue
        number, unit = r["s"][:-1], scale[r["s"][-1]]
        assert abs(Decimal(number) * unit - r["n"]) <= Decimal(unit) / 20
        assert unit == 10**9 or Decimal(number) < 1000


def test_trends_and_top_lists(spark):
    rng = random.Random(3)
    rows = [
        (
            f"10.0.0.{min(rng.randrange(40), rng.randrange(40))}",
            rng.choice(["HTTPS", "SSH", "MySQL"]),
            rng.choice(["normal", "suspicious", "malicious"]),
            rng.randrange(3 * 86400) // 7 * 7,
        )
        for _ in range(800)
    ]
    p = traffic(spark, rows, str(START)).cache()
    at = [START + timedelta(seconds=r[3]) for r in rows]

    hours = Counter(t.replace(minute=0, second=0) for t in at)
    got = {r["hour"]: (r["n"], r["delta"]) for r in trends.hourly_delta(p).collect()}
    hour, expected = min(hours), {}
    while hour <= max(hours):
        expected[hour] = (hours[hour], hours[hour] - hours[hour - timedelta(hours=1)])
        hour += timedelta(hours=1)
    assert got == expected

    buckets = Counter(
        (t.replace(minute=t.minute // 5 * 5, second=0), r[2]) for t, r in zip(at, rows)
    )
    traffic_rows = trends.traffic_5m(p).collect()
    assert len(traffic_rows) == len({r["bucket_start"] for r in traffic_rows})
    for r in traffic_rows:
        for status in ("normal", "suspicious", "malicious"):
            assert r[status] == buckets[(r["bucket_start"], status)]
    assert sum(buckets.values()) == sum(sum(r[1:]) for r in traffic_rows)

    bad = Counter(r[0] for r in rows if r[2] == "malicious")
    best = sorted(bad.items(), key=lambda x: (-x[1], x[0]))[:4]
    geo = spark.createDataFrame([], "ip string, country string")
    got = [(r["ip"], r["attempts"]) for r in aggregates.top_malicious(p, geo).collect()]
    assert got == best

    log = p.select("ip", F.col("protocol").alias("rule"), F.lit("blocked").alias("action"))
    per_rule = Counter((r[0], r[1]) for r in rows)
    per_ip = Counter(r[0] for r in rows)
    expected = [
        (ip, min((-n, rule) for (i, rule), n in per_rule.items() if i == ip)[1], total)
        for ip, total in sorted(per_ip.items(), key=lambda x: (-x[1], x[0]))[:4]
    ]
    assert [tuple(r) for r in aggregates.top_blocked(log).collect()] == expected


def test_addresses_round_trip(spark):
    df = spark.range(0, 2**32, 2**32 // 1000).select(
        "id", text.ip_to_long(text.long_to_ip(F.col("id"))).alias("back")
    )
    assert df.where("back IS NULL OR back <> id").count() == 0

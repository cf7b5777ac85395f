"""Hand-computed answers on the literal rows, and the edge cases of each expression."""

import pytest
from fixtures import alerts, at, firewall, packets, raw_packets, traffic
from pyspark.sql import functions as F

from netvigil.functions import columns, labels, text
from netvigil.operators import aggregates, correlate, enrich, filters, lookup, ranking, trends


def values(df, *names):
    rows = [tuple(r[n] for n in names) if names else tuple(r) for r in df.collect()]
    return [r[0] for r in rows] if len(names) == 1 else rows


def scalar(spark, column):
    return spark.range(1).select(column).first()[0]


def test_parse_size(spark):
    assert values(packets(spark).orderBy("packet_id"), "size_bytes") == [1229, 512, 2458, 3174, 768]
    sizes = ["3 MB", "1 gb", "", "KB", "1.2.3 KB", "-1 KB", "7 XB", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s string")
    parsed = values(df.select("i", text.parse_size(F.col("s")).alias("b")).orderBy("i"), "b")
    assert parsed == [3 * 1024**2, 1024**3, None, None, None, None, None, None]


def test_parse_ts(spark):
    assert values(packets(spark).orderBy("packet_id"), "ts")[0] == at("14:23:45")
    ts = text.parse_ts(F.col("t"), "2026-04-12")
    df = spark.createDataFrame([(t,) for t in ("25:00:00", "noon", "", None)], "t string")
    assert values(df.select(ts.alias("ts")), "ts") == [None] * 4
    full = text.parse_ts(F.lit("2026-04-12 14:23:45"))
    assert scalar(spark, full) == at("14:23:45")


def test_defaults_fill_null_and_missing_but_keep_empty(spark):
    df = spark.createDataFrame(
        [("1.1.1.1", None, None), ("", "blocked", "")], "ip string, action string, rule string"
    )
    filled = columns.fill_defaults(df, {"ip": "-", "action": "allowed", "rule": "-", "port": "-"})
    assert values(filled, "ip", "action", "rule", "port") == [
        ("1.1.1.1", "allowed", "-", "-"),
        ("", "blocked", "", "-"),
    ]


def test_labels_of_unknown_values(spark):
    assert scalar(spark, labels.classify(F.lit("foo"))) == "FOO"
    assert scalar(spark, labels.severity_rank(F.lit("foo"))) == -1
    assert scalar(spark, labels.severity_rank(F.lit(None).cast("string"))) == -1
    assert scalar(spark, labels.protocol_family(F.lit("MySQL"))) == "Other"
    assert scalar(spark, labels.protocol_family(F.lit("https"))) == "HTTP/HTTPS"


def test_risk_label(spark):
    df = spark.createDataFrame([(342,), (289,), (234,), (187,), (99,)], "n bigint")
    got = values(df.select(labels.risk_label(F.col("n")).alias("r")), "r")
    assert got == ["CRITICAL", "CRITICAL", "HIGH", "HIGH", "LOW"]


@pytest.mark.parametrize(
    ("n", "shown"),
    [
        (23, "23"), (999, "999"), (1000, "1.0K"), (999_949, "999.9K"), (999_950, "1.0M"),
        (2_400_000, "2.4M"), (999_950_000, "1.0B"), (None, None),
    ],
)
def test_format_count(spark, n, shown):
    assert scalar(spark, text.format_count(F.lit(n).cast("bigint"))) == shown


@pytest.mark.parametrize(
    ("change", "pct", "shown"),
    [(5, False, "+5"), (-8, False, "-8"), (0, False, "+0"), (12.5, True, "+12.5%"),
     (-0.04, True, "+0.0%"), (None, True, None)],
)
def test_format_delta(spark, change, pct, shown):
    assert scalar(spark, text.format_delta(F.lit(change).cast("double"), pct)) == shown


def test_age_text(spark):
    df = alerts(spark).select(
        "ip", text.age_text(F.col("ts"), F.lit("2026-04-12 14:30:00").cast("timestamp")).alias("age")
    )
    assert values(df, "age") == ["2m ago", "5m ago", "8m ago", "12m ago"]


def test_addresses(spark):
    ips = ["10.0.0.1", "255.255.255.255", "0.0.0.0", "256.1.1.1", "1.2.3", "a.b.c.d", None]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    numbers = values(df.select(text.ip_to_long(F.col("ip")).alias("n")), "n")
    assert numbers == [167772161, 2**32 - 1, 0, None, None, None, None]
    back = df.limit(3).select(text.long_to_ip(text.ip_to_long(F.col("ip"))).alias("ip"))
    assert values(back, "ip") == ips[:3]


def test_url_host(spark):
    urls = ["https://User:pw@Bad.Example.com:8443/x?y#z", "no url", "http://[bad", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert values(df.select(text.url_host(F.col("url")).alias("h")), "h") == [
        "bad.example.com", None, None, None,
    ]


def test_activity_view_hides_severity(spark):
    assert columns.activity_view(firewall(spark)).columns == ["ip", "port", "action", "rule", "ts"]


def test_filters(spark):
    p = packets(spark)
    assert filters.filter_protocol(p, "http/https").count() == 3
    assert filters.filter_protocol(p, "ftp").count() == 0
    assert filters.filter_protocol(p, None).count() == 5
    assert filters.filter_status(p, None).count() == 5
    assert values(filters.filter_packets(p, "http/https", "malicious"), "ip") == ["172.16.0.88"]
    assert filters.blocked(firewall(spark)).count() == 4
    with pytest.raises(ValueError):
        filters.filter_protocol(p, "gopher")
    with pytest.raises(ValueError):
        filters.filter_status(p, "odd")


def test_filter_protocol_agrees_with_the_family_in_any_case(spark):
    names = ["http", "Http", "HTTPS", "hTTps", "ssh", "Dns", "FTP", "MySQL", "", None]
    df = spark.createDataFrame([(n,) for n in names], "protocol string")
    for family in labels.FAMILY_MEMBERS:
        by_family = df.where(labels.protocol_family(F.col("protocol")) == family)
        by_filter = filters.filter_protocol(df, family.lower())
        assert sorted(values(by_filter, "protocol")) == sorted(values(by_family, "protocol"))


def test_last_window_bounds(spark):
    rows = [("a", "SSH", "normal", s) for s in (0, 1, 3600, 7200)]
    p = traffic(spark, rows)
    ids = lambda df: sorted(values(df, "packet_id"))
    assert ids(filters.last_window(p)) == [3]
    assert ids(filters.last_window(p, "2026-04-12 01:00:00")) == [1, 2]
    assert ids(filters.last_window(p, "2026-04-12 02:00:00", skip_hours=1)) == [1, 2]
    assert ids(filters.last_window(p, skip_hours=1)) == [1, 2]
    assert ids(filters.last_window(p, hours=2)) == [1, 2, 3]


def test_lookup_or_first(spark):
    p = packets(spark)
    assert values(lookup.lookup_or_first(p, 3), "ip") == ["192.168.0.156"]
    for bad in (-1, 99, None):
        assert values(lookup.lookup_or_first(p, bad), "ip") == ["192.168.1.45"]
    empty = lookup.lookup_or_first(p.where("false"), 0)
    assert values(empty, "ip", "protocol", "status", "port", "ts") == [
        ("-", "-", "normal", None, None)
    ]
    raw = lookup.lookup_or_first(raw_packets(spark).where("false"), 0, order=("time",))
    assert values(raw, "ip", "port", "protocol", "size", "status", "time") == [
        ("-", "-", "-", "-", "normal", "-")
    ]


def test_search_is_literal_and_reads_whole_texts(spark):
    long = "x" * 300_000 + " 100%_Secret tail"
    df = spark.createDataFrame(
        [(1, long, None), (2, "nothing", "a 100%_SECRET"), (3, "100 secret", "b")],
        "id int, body string, note string",
    )
    hits = lookup.search({"mail": (df, ["id"], ["body", "note"])}, "100%_secret", context=3)
    assert sorted(values(hits, "source", "key", "column", "snippet")) == [
        ("mail", "1", "body", "xx 100%_Secret ta"),
        ("mail", "2", "note", "a 100%_SECRET"),
    ]


def test_counts(spark):
    p, f = packets(spark), firewall(spark)
    assert values(aggregates.kpi_packets(p)) == [(5,)]
    by_status = dict(values(aggregates.status_counts(p), "status", "n"))
    assert by_status == {"normal": 2, "suspicious": 2, "malicious": 1}
    assert values(aggregates.kpi_suspicious_ips(p)) == [(2,)]
    assert values(aggregates.kpi_suspicious_ips(p, approx=True)) == [(2,)]
    assert values(aggregates.kpi_active_threats(p)) == [(1,)]
    assert values(aggregates.events_last_hour(f)) == [(7,)]
    assert values(aggregates.action_breakdown(f)) == [("blocked", 4, 0.5714), ("allowed", 3, 0.4286)]


def test_protocol_share_and_segments(spark):
    shares = aggregates.protocol_share(packets(spark))
    assert values(shares) == [("HTTP/HTTPS", 3, 0.6), ("Other", 1, 0.2), ("SSH", 1, 0.2)]
    assert values(trends.cumulative_share(shares)) == [
        ("HTTP/HTTPS", 0.0, 0.6), ("Other", 0.6, 0.8), ("SSH", 0.8, 1.0),
    ]


def test_segments_of_the_displayed_shares(spark):
    # The shares the chart shows.
    shown = [("HTTP/HTTPS", 0.45), ("SSH", 0.20), ("FTP", 0.15), ("DNS", 0.12), ("Other", 0.08)]
    counts = [(family, round(100 * share)) for family, share in shown]
    df = spark.createDataFrame(counts, "family string, n long")
    assert values(trends.cumulative_share(df)) == [
        ("HTTP/HTTPS", 0.0, 0.45), ("SSH", 0.45, 0.65), ("FTP", 0.65, 0.8), ("DNS", 0.8, 0.92),
        ("Other", 0.92, 1.0),
    ]


def test_threat_score(spark):
    p = packets(spark)
    assert values(aggregates.threat_score(p)) == [(40.0, "HIGH")]
    assert values(aggregates.threat_score(p.where("false"))) == [(0.0, "LOW")]


def test_top_blocked(spark):
    assert values(aggregates.top_blocked(firewall(spark))) == [
        ("177.21.9.77", "SMTP-SHIELD", 1),
        ("185.220.101.45", "SSH-BRUTE-FORCE", 1),
        ("210.48.12.19", "PORT-SCAN", 1),
        ("45.142.120.67", "RDP-BLOCK", 1),
    ]


def test_top_blocked_rule_ties_and_null_address(spark):
    rows = [("a", "R2")] * 2 + [("a", "R1")] * 2 + [("a", "R0")] + [(None, "R9")] * 6
    df = spark.createDataFrame(rows, "ip string, rule string").withColumn("action", F.lit("blocked"))
    assert values(aggregates.top_blocked(df)) == [(None, "R9", 6), ("a", "R1", 5)]


def test_top_malicious_reproduces_the_displayed_table(spark):
    # The displayed attempts and countries.
    shown = [
        ("185.220.101.45", "RU", 342), ("103.56.207.23", "CN", 289),
        ("45.142.120.67", "NL", 234), ("193.164.132.88", "DE", 187),
    ]
    rows = [(ip, "SSH", "malicious", i) for ip, _, n in shown for i in range(n)]
    rows += [("9.9.9.9", "SSH", "malicious", i) for i in range(5)]
    rows += [("8.8.8.8", "SSH", "normal", i) for i in range(500)]
    geo = spark.createDataFrame([(ip, c) for ip, c, _ in shown[:3]], "ip string, country string")
    got = values(aggregates.top_malicious(traffic(spark, rows), geo))
    assert got == [
        ("185.220.101.45", "RU", 342, "CRITICAL"), ("103.56.207.23", "CN", 289, "CRITICAL"),
        ("45.142.120.67", "NL", 234, "HIGH"), ("193.164.132.88", "-", 187, "HIGH"),
    ]


def test_active_alerts(spark):
    panel = aggregates.active_alerts(alerts(spark), "2026-04-12 14:30:00", k=3)
    assert values(panel) == [
        ("DDoS Attack", "192.168.1.45", "2m ago", "CRITICAL", 4),
        ("Port Scan", "10.0.0.234", "5m ago", "HIGH", 4),
        ("SQL Injection", "172.16.0.88", "8m ago", "CRITICAL", 4),
    ]
    earlier = aggregates.active_alerts(alerts(spark), "2026-04-12 14:20:00")
    assert values(earlier, "type", "age", "total_active") == [("Malware Detected", "2m ago", 1)]


def test_kpi_cards(spark):
    rows = (
        [("a", "SSH", "malicious", 10)] * 8 + [("b", "SSH", "suspicious", 20)] * 2
        + [("c", "SSH", "malicious", 3700)] * 5 + [("b", "SSH", "suspicious", 3700)]
        + [("d", "SSH", "suspicious", 3700), ("e", "SSH", "normal", 7000)]
    )
    cards = aggregates.kpi_cards(traffic(spark, rows), "2026-04-12 02:00:00").orderBy("position")
    assert values(cards, "label", "value", "delta") == [
        ("Active Threats", "5", "-3"), ("Packets Analyzed", "18", "-20.0%"),
        ("Suspicious IPs", "2", "+1"),
    ]
    empty = aggregates.kpi_cards(traffic(spark, rows).where("false"), "2026-04-12 02:00:00")
    assert values(empty.orderBy("position"), "value", "delta") == [("0", "+0"), ("0", None), ("0", "+0")]


def test_worst_status(spark):
    rows = [("a", "SSH", "normal", 1), ("a", "SSH", "malicious", 2), ("b", "SSH", "odd", 3)]
    got = values(aggregates.worst_status(traffic(spark, rows)).orderBy("ip"))
    assert got == [("a", 2, "MALICIOUS"), ("b", -1, "ODD")]


def test_traffic_fills_gaps(spark):
    rows = [("a", "SSH", "normal", 0), ("a", "SSH", "odd", 299), ("a", "SSH", "malicious", 1800)]
    got = values(trends.traffic_5m(traffic(spark, rows)).orderBy("bucket_start"))
    assert [r[1:] for r in got] == [(1, 0, 0, 1)] + [(0, 0, 0, 0)] * 5 + [(0, 0, 1, 0)]
    assert trends.traffic_5m(traffic(spark, rows).where("false")).count() == 0


def test_traffic_fills_gaps_over_days(spark):
    rows = [("a", "SSH", "normal", 600), ("a", "SSH", "normal", 3 * 86400)]
    filled = trends.traffic_5m(traffic(spark, rows))
    assert filled.count() == 3 * 288 - 2 + 1
    assert filled.select("bucket_start").distinct().count() == filled.count()


def test_hourly_delta(spark):
    rows = [("a", "SSH", "normal", s) for s in (1, 2, 3600, 3601, 3602, 3 * 3600)]
    got = values(trends.hourly_delta(traffic(spark, rows)).orderBy("hour"), "n", "delta", "pct")
    assert got == [(2, 2, None), (3, 1, 50.0), (0, -3, -100.0), (1, 1, None)]


def test_spikes_need_a_full_baseline(spark):
    day = 86400
    geo = spark.createDataFrame([("a", "EAST")], "ip string, region string")
    rows = [("a", "SSH", "normal", d * day) for d in range(7) for _ in range(10 + d % 2)]
    rows += [("a", "SSH", "normal", 7 * day)] * 40
    rows += [("b", "SSH", "normal", 0)] + [("b", "SSH", "normal", 3 * day)] * 90
    got = values(trends.spikes(traffic(spark, rows), geo), "protocol", "region", "n", "mean")
    assert got == [("SSH", "EAST", 40, 10.4286)]


def test_quiet_buckets_count_as_zero_before_a_spike(spark):
    geo = spark.createDataFrame([("a", "EAST")], "ip string, region string")
    rows = [("a", "SSH", "normal", d * 10 * 86400) for d in range(4) for _ in range(3)]
    got = values(trends.spikes(traffic(spark, rows), geo), "n", "mean", "stddev")
    assert got == [(3, 0.0, 0.0)] * 3


def test_top_malicious_shows_an_address_once(spark):
    geo = spark.createDataFrame([("a", "NL"), ("a", "DE")], "ip string, country string")
    got = values(aggregates.top_malicious(traffic(spark, [("a", "SSH", "malicious", 1)]), geo))
    assert got == [("a", "DE", 1, "LOW")]


def test_order(spark):
    newest = values(ranking.latest(firewall(spark), 2, "ip"), "ip")
    assert newest == ["185.220.101.45", "103.56.207.23"]
    assert values(ranking.in_arrival_order(packets(spark), 2), "packet_id") == [0, 1]


def test_correlation(spark):
    # The addresses of the top-malicious table.
    ips = ["185.220.101.45", "103.56.207.23", "45.142.120.67", "193.164.132.88"]
    p = traffic(spark, [(ip, "SSH", "malicious", 1) for ip in ips for _ in range(3)])
    f = firewall(spark)
    anti = values(correlate.never_blocked(p, f, on=("ip",)), "ip")
    assert sorted(anti) == ["103.56.207.23", "193.164.132.88"]
    semi = values(correlate.also_blocked(p, f, on=("ip",)), "ip")
    assert sorted(semi) == ["185.220.101.45", "45.142.120.67"]


def test_timeline(spark):
    rows = correlate.timeline(packets(spark), firewall(spark), alerts(spark))
    assert rows.columns == ["ts", "source", "ip", "kind", "severity"]
    counts = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    assert counts == {"packet": 5, "firewall": 7, "alert": 4}
    assert set(values(rows.where("source = 'alert'"), "severity")) == {"CRITICAL", "HIGH"}


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_ip_profile(spark, limit):
    ips = spark.createDataFrame([("10.0.0.234",), ("1.2.3.4",), ("185.220.101.45",)], "ip string")
    geo = spark.createDataFrame([("185.220.101.45", "RU")], "ip string, country string")
    rep = spark.createDataFrame([("1.2.3.4", 90)], "ip string, score int")
    got = correlate.ip_profile(packets(spark), firewall(spark), geo, ips, rep, limit_bytes=limit)
    rows = {r["ip"]: r for r in got.collect()}
    assert len(rows) == 3
    seen = rows["10.0.0.234"]
    assert (seen["packets"], seen["bytes"], seen["suspicious"], seen["blocked"]) == (1, 512, 1, 0)
    assert seen["first_seen"] == seen["last_seen"] == at("14:23:46")
    unknown = rows["1.2.3.4"]
    assert (unknown["packets"], unknown["bytes"], unknown["country"], unknown["score"]) == (0, 0, "-", 90)
    assert unknown["first_seen"] is None
    stopped = rows["185.220.101.45"]
    assert (stopped["packets"], stopped["blocked"], stopped["country"]) == (0, 1, "RU")


def test_match_hashes_and_oversize(spark):
    docs = spark.createDataFrame([(1, "bad"), (2, "good"), (3, "bad"), (4, None)], "doc_id int, content string")
    ind = spark.createDataFrame([("sha256", "BAD"), ("host", "x")], "kind string, value string").select(
        "kind", F.when(F.col("kind") == "sha256", F.upper(F.sha2(F.lower("value"), 256))).otherwise(
            F.col("value")).alias("value")
    )
    assert sorted(values(enrich.match_hashes(docs, ind), "doc_id")) == [1, 3]
    assert values(enrich.oversize(docs, max_bytes=3)) == [(2, 4)]


def test_match_hosts(spark):
    pages = spark.createDataFrame(
        [(1, "http://EVIL.example/x"), (2, "http://evil.example.org"), (3, "junk")],
        "page_id int, url string",
    )
    ind = spark.createDataFrame([("host", "evil.example")], "kind string, value string")
    assert values(enrich.match_hosts(pages, ind)) == [(1, "evil.example")]

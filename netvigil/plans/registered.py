"""Every operator as a query over the driver's tables: (spark, sf_dir) -> DataFrame.

Times leave a query without zone, as the source tables hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.functions import columns, labels, text
from netvigil.operators import aggregates, correlate, enrich, filters, heavy, lookup, ranking, trends
from netvigil.operators.postings import SearchIndex
from netvigil.plans import binding as b
from netvigil.plans import pages
from netvigil.plans.rollup import Rollup, dashboard
from netvigil.session import work_path
from netvigil.sources.export import export, with_date
from netvigil.sources.ledger import LogLedger
from netvigil.sources.readers import (
    bad_lines,
    firewall_from_raw,
    good_records,
    ingest_logs,
    packets_from_raw,
    read_firewall,
    read_packets,
    store_logs,
)
from netvigil.streaming import charts
from netvigil.streaming import operators as streams
from netvigil.streaming.lifecycle import run_available
from netvigil.streaming.lookups import LookupVersions, enrich_stream, enriched_rows
from netvigil.streaming.sources import stream_firewall, stream_log_lines, stream_packets

PACKET_COLUMNS = ("packet_id", "ip", "port", "protocol", "size_bytes", "status", "ts")
FIREWALL_COLUMNS = ("ip", "port", "action", "rule", "ts", "severity")


def _plain_times(df: DataFrame) -> DataFrame:
    zoned = [c for c, kind in df.dtypes if kind == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})


def _packet_files(spark: SparkSession, sf: str, fmt: str = "parquet", **kw) -> str:
    path = work_path(spark, "packets")
    export(b.as_stream_rows(b.packets(spark, sf)).select(*PACKET_COLUMNS), path, fmt, **kw)
    return path


def _firewall_files(spark: SparkSession, sf: str, fmt: str = "parquet", **kw) -> str:
    path = work_path(spark, "firewall")
    export(b.as_stream_rows(b.firewall(spark, sf)).select(*FIREWALL_COLUMNS), path, fmt, **kw)
    return path


def _log_lines(spark: SparkSession, sf: str) -> str:
    """Firewall log as JSON lines. Some uploads are bad: purchases carry a port
    that is no number, and lines of signups are cut off."""
    rows = b.firewall(spark, sf)
    is_cut = F.col("event_type") == "signup"
    port = F.when(F.col("event_type") == "purchase", "n/a").otherwise(F.col("port").cast("string"))
    line = F.to_json(
        F.struct(
            "ip",
            port.alias("port"),
            "action",
            "rule",
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
            "severity",
        )
    )
    path = work_path(spark, "lines")
    export(
        rows.select(
            F.when(is_cut, F.concat(F.lit('{"ip":"'), F.col("ip"))).otherwise(line).alias("value")
        ),
        path,
        "text",
    )
    return path


def _streamed(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is there and read its files back."""
    path = work_path(spark, label)
    run_available(stream, f"{path}/rows", f"{path}/checkpoint")
    return _plain_times(spark.read.schema(stream.schema).parquet(f"{path}/rows"))


# Sources and sinks


def s1_read_packets(spark, sf):
    return _plain_times(read_packets(spark, _packet_files(spark, sf)))


def s2_read_firewall(spark, sf):
    return _plain_times(read_firewall(spark, _firewall_files(spark, sf, "csv"), "csv"))


def s3_ingest_good(spark, sf):
    good, _ = ingest_logs(spark, _log_lines(spark, sf))
    return _plain_times(good)


def s3_ingest_quarantine(spark, sf):
    _, bad = ingest_logs(spark, _log_lines(spark, sf))
    return bad.select("line")


def s3_store_logs(spark, sf):
    """Both outcomes of an ingest that parses the lines once."""
    good, bad = store_logs(spark, _log_lines(spark, sf), work_path(spark, "stored"))
    rule = F.coalesce("rule", F.lit("none")).alias("rule")
    kept = good.groupBy(rule, F.lit("good").alias("outcome")).agg(F.count("*").alias("n"))
    quarantined = bad.groupBy(
        F.lit("none").alias("rule"), F.lit("bad").alias("outcome")
    ).agg(F.count("*").alias("n"))
    return kept.unionByName(quarantined)


def s3_reingest(spark, sf):
    """The log uploaded in two goes, the first of them once more under other names."""
    ledger = LogLedger(spark, work_path(spark, "ledger"))
    lines = spark.read.text(_log_lines(spark, sf))
    path = work_path(spark, "uploads")
    is_short = F.length("value") % 2 == 0
    for name, part in (("first", is_short), ("second", ~is_short), ("again", is_short)):
        lines.where(part).sort("value").coalesce(1).write.text(f"{path}/{name}")
        ledger.ingest(f"{path}/*")
    return _plain_times(ledger.records()[0])


def s4_stream_firewall(spark, sf):
    return _streamed(spark, stream_firewall(spark, _firewall_files(spark, sf)), "s4")


def s4_stream_packets(spark, sf):
    return _streamed(spark, stream_packets(spark, _packet_files(spark, sf)), "s4")


def s5_export_by_date(spark, sf):
    path = work_path(spark, "export")
    export(
        with_date(b.as_stream_rows(b.packets(spark, sf)).select(*PACKET_COLUMNS)),
        path,
        partition_by="date",
    )
    day = F.col("date").cast("string").alias("day")
    return read_packets(spark, path).groupBy(day).agg(
        F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")
    )


def s6_capture_restart(spark, sf):
    """Capture runs, is stopped, more rows arrive, and it resumes from its checkpoint."""
    rows = b.as_stream_rows(b.firewall(spark, sf)).select(*FIREWALL_COLUMNS)
    path = work_path(spark, "capture")
    for action in labels.ACTIONS:
        rows.where(F.col("action") == action).write.mode("append").parquet(f"{path}/landed")
        capture = stream_firewall(spark, f"{path}/landed")
        run_available(capture, f"{path}/rows", f"{path}/checkpoint")
    return _plain_times(read_firewall(spark, f"{path}/rows"))


# Projections and scalar functions


def p1_fill_defaults(spark, sf):
    sparse = b.firewall(spark, sf).select(
        "log_id",
        F.nullif("protocol", F.lit("MySQL")).alias("protocol"),
        F.nullif("action", F.lit("allowed")).alias("action"),
        F.when(F.col("rule") == "SSH-BLOCK", "").otherwise(
            F.nullif("rule", F.lit("DNS-ALLOW"))
        ).alias("rule"),
    )
    return columns.fill_defaults(
        sparse, {"ip": "-", "protocol": "-", "rule": "-", "action": "allowed"}
    )


def p2_classify(spark, sf):
    return b.packets(spark, sf).select(
        "packet_id",
        labels.classify(F.col("status")).alias("label"),
        labels.classify(F.col("event_type")).alias("unknown_label"),
    )


def p3_severity_rank(spark, sf):
    p = b.packets(spark, sf)
    return p.select(
        "packet_id",
        labels.severity_rank(F.col("status")).alias("status_rank"),
        labels.severity_rank(F.col("event_type")).alias("unknown_rank"),
    )


def p3_worst_status(spark, sf):
    return aggregates.worst_status(b.packets(spark, sf))


def p4_parse_size(spark, sf):
    size = text.format_size(F.col("size_bytes"))
    malformed = text.parse_size(F.concat(F.col("size"), F.lit("?")))
    return (
        b.packets(spark, sf)
        .select("packet_id", size.alias("size"))
        .withColumn("size_bytes", text.parse_size(F.col("size")))
        .withColumn("malformed", F.coalesce(malformed.cast("string"), F.lit("none")))
    )


def p5_format_count(spark, sf):
    p = b.packets(spark, sf)
    total = F.sum("size_bytes").alias("bytes")
    sums = p.groupBy(F.col("ip").alias("of")).agg(total).unionByName(
        p.groupBy(F.col("protocol").alias("of")).agg(total)
    )
    return sums.select("of", "bytes", text.format_count(F.col("bytes")).alias("shown"))


def p5_format_delta(spark, sf):
    return trends.hourly_delta(b.packets(spark, sf)).select(
        "hour",
        text.format_delta(F.col("delta")).alias("delta_text"),
        text.format_delta(F.col("pct"), pct=True).alias("pct_text"),
    )


def p6_age_text(spark, sf):
    p = b.packets(spark, sf)
    return p.select("packet_id", text.age_text(F.col("ts"), filters.latest_ts(p)).alias("age"))


def p7_parse_ts(spark, sf):
    shown = b.packets(spark, sf).select(
        "packet_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("full"),
        F.date_format("ts", "HH:mm:ss").alias("time"),
    )
    return _plain_times(
        shown.select(
            "packet_id",
            text.parse_ts(F.col("full")).alias("full_ts"),
            text.parse_ts(F.col("time"), "2024-01-31").alias("time_ts"),
            F.coalesce(
                text.parse_ts(F.concat(F.lit("x"), F.col("full"))).cast("string"), F.lit("none")
            ).alias("malformed"),
        )
    )


def p7_raw_packets(spark, sf):
    raw = b.packets(spark, sf).select(
        "packet_id",
        "ip",
        F.col("port").cast("string").alias("port"),
        "protocol",
        text.format_size(F.col("size_bytes")).alias("size"),
        "status",
        F.date_format("ts", "HH:mm:ss").alias("time"),
    )
    return _plain_times(packets_from_raw(raw, "2024-01-31"))


def p7_raw_firewall(spark, sf):
    raw = b.firewall(spark, sf).select(
        "ip",
        F.col("port").cast("string").alias("port"),
        "action",
        "rule",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
        "severity",
    )
    return _plain_times(firewall_from_raw(raw))


def p8_protocol_family(spark, sf):
    return b.packets(spark, sf).select(
        "packet_id",
        labels.protocol_family(F.col("protocol")).alias("family"),
        labels.protocol_family(F.lower("protocol")).alias("family_of_lower"),
    )


def p9_risk_label(spark, sf):
    counts = b.packets(spark, sf).groupBy("ip").agg(F.count("*").alias("attempts"))
    return counts.withColumn("risk", labels.risk_label(F.col("attempts"), 72, 64))


def p10_activity_view(spark, sf):
    return columns.activity_view(b.firewall(spark, sf))


def p10_packet_view(spark, sf):
    return columns.activity_view(b.packets(spark, sf), columns.PACKET_VIEW)


# Filters


def f1_filter_protocol(spark, sf):
    return filters.filter_protocol(b.packets(spark, sf), "http/https").select(*PACKET_COLUMNS)


def f2_filter_status(spark, sf):
    return filters.filter_status(b.packets(spark, sf), "suspicious").select(*PACKET_COLUMNS)


def f3_filter_packets(spark, sf):
    return filters.filter_packets(b.packets(spark, sf), "ssh", "malicious").select(*PACKET_COLUMNS)


def f4_blocked(spark, sf):
    return filters.blocked(b.firewall(spark, sf)).select(*FIREWALL_COLUMNS)


def f5_last_window(spark, sf):
    return filters.last_window(b.packets(spark, sf), hours=6).select(*PACKET_COLUMNS)


def f5_last_window_by_date(spark, sf):
    """The same window over packets laid out by date: only the newest folders are opened."""
    path = work_path(spark, "by-date")
    rows = b.as_stream_rows(b.packets(spark, sf)).select(*PACKET_COLUMNS)
    export(with_date(rows), path, partition_by="date")
    laid_out = read_packets(spark, path)
    return _plain_times(filters.last_window_by_date(laid_out, hours=6).select(*PACKET_COLUMNS))


def f6_search(spark, sf):
    return lookup.search(_searched_tables(spark, sf), "LICENSE")


def _searched_tables(spark, sf):
    return {
        "documents": (b.table(spark, sf, "documents"), ["doc_id"], ["text", "lang", "source"]),
        "pages": (b.table(spark, sf, "pages"), ["page_id"], ["url", "html"]),
        "conversations": (
            b.table(spark, sf, "conversations"), ["conv_id", "turn"], ["role", "text"],
        ),
    }


def f6_indexed(spark, sf):
    """The same search through trigram postings."""
    tables = _searched_tables(spark, sf)
    index = SearchIndex(spark, work_path(spark, "postings"))
    for source, (df, keys, columns_) in tables.items():
        index.refresh(source, df, keys, columns_)
    return index.search(tables, "LICENSE")


def f6_search_telemetry(spark, sf):
    return lookup.search(
        {
            "packets": (b.packets(spark, sf), ["packet_id"], ["ip", "protocol", "status"]),
            "firewall": (b.firewall(spark, sf), ["log_id"], ["ip", "action", "rule"]),
        },
        "ssh",
    )


def f7_lookup(spark, sf):
    """A key that exists, one that does not, and an empty table."""
    p = b.packets(spark, sf).select(*PACKET_COLUMNS)
    newest = p.agg(F.max("packet_id")).scalar()
    parts = (
        ("present", p, newest),
        ("out of range", p, newest + 1),
        ("empty table", p.where(F.col("ts").isNull()), newest),
    )
    result = None
    for name, df, key in parts:
        row = lookup.lookup_or_first(df, key).withColumn("asked", F.lit(name))
        result = row if result is None else result.unionByName(row)
    # As shown: numbers are text, and what the sentinel lacks is a dash.
    numbers = ("packet_id", "port", "size_bytes")
    shown = result.withColumns({c: F.col(c).cast("string") for c in numbers})
    return columns.fill_defaults(shown, dict.fromkeys(numbers, "-"))


# Joins


def j1_geo_enrich(spark, sf):
    p = b.packets(spark, sf).select("packet_id", "ip")
    return enrich.geo_enrich(p, b.geo(spark, sf))


def j2_geo_enrich_ranges(spark, sf):
    p = b.packets(spark, sf).select("packet_id", "ip_long")
    return enrich.geo_enrich_ranges(p, b.geo_ranges(spark, sf))


def j2_nested(spark, sf):
    """Ranges over each other: a region owns a stretch, its nations parts of it, with gaps."""
    p = b.packets(spark, sf).select("packet_id", "ip_long")
    return enrich.geo_enrich_ranges(p, b.nested_ranges(spark, sf))


def j1_gaps(spark, sf):
    """A table that lacks addresses and names others twice: places of customers in debt."""
    p = b.packets(spark, sf).select("packet_id", "ip")
    return enrich.geo_enrich(p, b.geo_of_debtors(spark, sf))


def _refreshed(spark, sf, make, join):
    """A stream over two arrivals of packets; the lookup grows past its limit in between."""
    path = work_path(spark, "refreshed")
    rows = b.as_stream_rows(b.packets(spark, sf)).select("packet_id", "ip", "status")
    versions = LookupVersions(spark, f"{path}/lookup").create()
    limit = None
    for calm, lookup in ((True, b.geo_of_debtors(spark, sf)), (False, b.geo(spark, sf))):
        version = versions.publish(make(lookup))
        limit = versions.get(version).n_bytes if limit is None else limit
        arrived = rows.where((F.col("status") == "normal") == calm)
        arrived.write.mode("append").parquet(f"{path}/landed")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/landed")
        enrich_stream(
            stream, versions, lambda df, known: join(df, known, limit), f"{path}/out", f"{path}/checkpoint"
        ).awaitTermination()
    return enriched_rows(spark, f"{path}/out").drop("status")


def j1_stream(spark, sf):
    return _refreshed(spark, sf, lambda geo: enrich.geo_lookup(geo).table, enrich.geo_enrich)


def j3_reputation_enrich(spark, sf):
    p = b.packets(spark, sf).select("packet_id", "ip")
    return enrich.reputation_enrich(p, b.reputation(spark, sf))


def j4_match_hashes(spark, sf):
    docs = b.table(spark, sf, "documents")
    return enrich.match_hashes(docs, b.indicators(spark, sf), "doc_id", "text")


def j4_match_hosts(spark, sf):
    return enrich.match_hosts(b.table(spark, sf, "pages"), b.indicators(spark, sf))


def j4_match_urls(spark, sf):
    return enrich.match_urls(b.table(spark, sf, "pages"), b.url_indicators(spark, sf))


def j4_oversize(spark, sf):
    """With a limit of 20 KB instead of 256 MB."""
    return enrich.oversize(b.table(spark, sf, "documents"), "doc_id", "text", 20 * 1024)


def j4_unscanned(spark, sf):
    """What a hash match limited to 20 KB leaves out; short texts stand for missing content."""
    docs = b.table(spark, sf, "documents").select(
        "doc_id", F.when(F.length("text") >= 200, F.col("text")).alias("text")
    )
    out = enrich.unscanned(docs, "doc_id", "text", 20 * 1024)
    return out.withColumn("n_bytes", F.coalesce("n_bytes", F.lit(-1)))


def j5_also_blocked(spark, sf):
    return correlate.also_blocked(b.packets(spark, sf), b.firewall(spark, sf))


def j5_never_blocked(spark, sf):
    return correlate.never_blocked(b.packets(spark, sf), b.firewall(spark, sf))


# Aggregations


def a1_active_threats(spark, sf):
    return aggregates.kpi_active_threats(b.packets(spark, sf))


def a2_packets(spark, sf):
    return aggregates.kpi_packets(b.packets(spark, sf))


def a2_status_counts(spark, sf):
    return aggregates.status_counts(b.packets(spark, sf))


def a3_suspicious_ips(spark, sf):
    return aggregates.kpi_suspicious_ips(b.packets(spark, sf))


def a4_events_last_hour(spark, sf):
    return aggregates.events_last_hour(b.firewall(spark, sf))


def a5_action_breakdown(spark, sf):
    return aggregates.action_breakdown(b.firewall(spark, sf))


def a6_protocol_share(spark, sf):
    return aggregates.protocol_share(b.packets(spark, sf))


def a7_traffic_5m(spark, sf):
    return trends.traffic_5m(b.packets(spark, sf))


def a8_top_malicious(spark, sf):
    return aggregates.top_malicious(
        b.packets(spark, sf), b.geo(spark, sf), critical_min=9, high_min=5
    )


def a9_top_blocked(spark, sf):
    return aggregates.top_blocked(b.firewall(spark, sf))


def a8_heavy(spark, sf):
    """The same list by counts of hash buckets first, then of the addresses that they leave."""
    return heavy.heavy_malicious(
        b.packets(spark, sf), b.geo(spark, sf), critical_min=9, high_min=5
    )


def a9_heavy(spark, sf):
    return heavy.heavy_blocked(b.firewall(spark, sf))


def a10_threat_score(spark, sf):
    return aggregates.threat_score(b.packets(spark, sf))


def a11_active_alerts(spark, sf):
    return aggregates.active_alerts(b.alerts(spark, sf))


def a_kpi_cards(spark, sf):
    return aggregates.kpi_cards(b.packets(spark, sf))


# Windows, order, set operations, composites


def w1_hourly_delta(spark, sf):
    return trends.hourly_delta(b.packets(spark, sf))


def w1_threats_delta(spark, sf):
    """Hours of malicious packets, most of them quiet at small size."""
    threats = b.packets(spark, sf).where(F.col("status") == "malicious")
    return trends.hourly_delta(threats)


def a7_traffic_of_a_day(spark, sf):
    """A chart with given bounds, which reach beyond the traffic."""
    return trends.traffic_5m(b.packets(spark, sf), "2023-12-31 18:00:00", "2024-01-01 06:00:00")


def w3_cumulative_share(spark, sf):
    return trends.cumulative_share(aggregates.protocol_share(b.packets(spark, sf)))


def l1_latest(spark, sf):
    log = b.firewall(spark, sf)
    return ranking.latest(log, 20, "log_id").select("log_id", *FIREWALL_COLUMNS)


def l2_in_arrival_order(spark, sf):
    return ranking.in_arrival_order(b.packets(spark, sf), 20).select(*PACKET_COLUMNS)


def u1_timeline(spark, sf):
    return correlate.timeline(
        b.packets(spark, sf), b.firewall(spark, sf), b.alerts(spark, sf)
    )


def e1_ip_profile(spark, sf):
    """All addresses of customers: those without traffic show the empty state."""
    return correlate.ip_profile(
        b.packets(spark, sf),
        b.firewall(spark, sf),
        b.geo(spark, sf),
        b.geo(spark, sf).select("ip"),
        b.reputation(spark, sf),
    )


def e1_long_list(spark, sf):
    """A list that is too long to broadcast: all addresses with malicious packets."""
    p = b.packets(spark, sf)
    ips = p.where(F.col("status") == "malicious").select("ip")
    return correlate.ip_profile(
        p, b.firewall(spark, sf), b.geo(spark, sf), ips, b.reputation(spark, sf), limit_bytes=None
    )


def u1_of_addresses(spark, sf):
    """Everything about the addresses that were blocked most."""
    log = b.firewall(spark, sf)
    ips = aggregates.top_blocked(log, 10).select("ip")
    return correlate.timeline_of(b.packets(spark, sf), log, b.alerts(spark, sf), ips)


def n1_spikes(spark, sf):
    return trends.spikes(b.packets(spark, sf), b.geo(spark, sf))


# Pages


def _dashboard(spark, sf):
    """All parts over one table of states; the telemetry is scanned once to make it."""
    p = b.packets(spark, sf)
    rollup = Rollup(spark, work_path(spark, "states"), p.schema["ts"].dataType)
    rollup.refresh(p)
    return dashboard(rollup, p, b.geo(spark, sf), critical_min=9, high_min=5)


def page_dashboard_threat_score(spark, sf):
    return _dashboard(spark, sf)["threat_score"]


def page_dashboard_cards(spark, sf):
    return _dashboard(spark, sf)["kpi_cards"]


def page_dashboard_traffic(spark, sf):
    return _dashboard(spark, sf)["traffic"]


def page_dashboard_hourly(spark, sf):
    return _dashboard(spark, sf)["hourly_delta"]


def page_dashboard_protocols(spark, sf):
    return _dashboard(spark, sf)["protocol_share"]


def page_dashboard_segments(spark, sf):
    return _dashboard(spark, sf)["protocol_segments"]


def page_dashboard_top(spark, sf):
    return _dashboard(spark, sf)["top_malicious"]


def page_dashboard_view_all(spark, sf):
    """Every address behind "View All", not the first four."""
    return _dashboard(spark, sf)["all_malicious"]


def page_packets_table(spark, sf):
    p = b.packets(spark, sf).select(*PACKET_COLUMNS)
    return pages.packet_page(p, "http/https", "malicious")["packets"]


def page_packets_details(spark, sf):
    p = b.packets(spark, sf).select(*PACKET_COLUMNS)
    return pages.packet_page(p, selected=17)["details"]


def page_firewall_activity(spark, sf):
    parts = pages.firewall_page(b.firewall(spark, sf), b.packets(spark, sf), b.geo(spark, sf))
    return parts["activity"]


# Streaming


def t1_stream_traffic(spark, sf):
    p = b.packets(spark, sf, b.event_stream(spark, sf))
    return _streamed(spark, streams.stream_traffic(p), "t1")


def t1_chart(spark, sf):
    """The traffic chart as the stream of five-minute counts keeps it."""
    counts = streams.stream_traffic(b.packets(spark, sf, b.event_stream(spark, sf)))
    path = work_path(spark, "chart")
    charts.keep_panes(counts, f"{path}/panes", f"{path}/checkpoint").awaitTermination()
    kept = charts.panes(spark, f"{path}/panes", counts.schema)
    return _plain_times(charts.traffic_chart(kept))


def t_suspicious_ips(spark, sf):
    p = b.packets(spark, sf, b.event_stream(spark, sf))
    return _streamed(spark, streams.stream_suspicious_ips(p), "suspicious")


def t3_shares(spark, sf):
    """Shares of the actions in each trailing hour of the stream."""
    return charts.action_shares(t3_stream_actions(spark, sf))


def t2_stream_ingest_good(spark, sf):
    return _streamed(spark, good_records(stream_log_lines(spark, _log_lines(spark, sf))), "t2")


def t2_stream_ingest_quarantine(spark, sf):
    bad = bad_lines(stream_log_lines(spark, _log_lines(spark, sf)))
    return _streamed(spark, bad, "t2").select("line")


def t3_stream_actions(spark, sf):
    log = b.firewall(spark, sf, b.event_stream(spark, sf))
    return _streamed(spark, streams.stream_actions(log), "t3")


def t4_alert_stream(spark, sf):
    p = b.packets(spark, sf, b.event_stream(spark, sf))
    return _streamed(spark, streams.alert_stream(p), "t4")


QUERIES = {
    f.__name__: f
    for f in (
        s1_read_packets, s2_read_firewall, s3_ingest_good, s3_ingest_quarantine, s3_store_logs, s3_reingest,
        s4_stream_firewall, s4_stream_packets, s5_export_by_date, s6_capture_restart,
        p1_fill_defaults, p2_classify, p3_severity_rank, p3_worst_status, p4_parse_size,
        p5_format_count, p5_format_delta, p6_age_text, p7_parse_ts, p7_raw_packets,
        p7_raw_firewall, p8_protocol_family, p9_risk_label, p10_activity_view, p10_packet_view,
        f1_filter_protocol, f2_filter_status, f3_filter_packets, f4_blocked, f5_last_window,
        f5_last_window_by_date,
        f6_search, f6_indexed, f6_search_telemetry, f7_lookup,
        j1_geo_enrich, j1_gaps, j1_stream, j2_geo_enrich_ranges, j2_nested, j3_reputation_enrich,
        j4_match_hashes, j4_match_hosts, j4_match_urls, j4_oversize, j4_unscanned, j5_also_blocked, j5_never_blocked,
        a1_active_threats, a2_packets, a2_status_counts, a3_suspicious_ips, a4_events_last_hour,
        a5_action_breakdown, a6_protocol_share, a7_traffic_5m, a8_top_malicious, a9_top_blocked,
        a8_heavy, a9_heavy,
        a10_threat_score, a11_active_alerts, a_kpi_cards,
        a7_traffic_of_a_day, w1_hourly_delta, w1_threats_delta, w3_cumulative_share,
        l1_latest, l2_in_arrival_order,
        u1_timeline, u1_of_addresses, e1_ip_profile, e1_long_list, n1_spikes,
        page_dashboard_threat_score, page_dashboard_cards, page_dashboard_traffic,
        page_dashboard_hourly, page_dashboard_protocols, page_dashboard_segments,
        page_dashboard_top, page_dashboard_view_all, page_packets_table, page_packets_details,
        page_firewall_activity,
        t1_stream_traffic, t1_chart, t2_stream_ingest_good, t2_stream_ingest_quarantine,
        t3_stream_actions, t3_shares, t4_alert_stream, t_suspicious_ips,
    )
}

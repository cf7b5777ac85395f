"""The same queries as plain SQL over the driver's tables, for checking results."""

from __future__ import annotations

_CTES = {
    "packets": """
  SELECT event_id AS packet_id, ts, event_type, 167772160 + user_id AS ip_long,
    concat_ws('.', ((167772160 + user_id) >> 24) & 255, ((167772160 + user_id) >> 16) & 255,
      ((167772160 + user_id) >> 8) & 255, (167772160 + user_id) & 255) AS ip,
    CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 6
      WHEN 0 THEN 'HTTPS' WHEN 1 THEN 'HTTP' WHEN 2 THEN 'SSH' WHEN 3 THEN 'FTP'
      WHEN 4 THEN 'DNS' ELSE 'MySQL' END AS protocol,
    CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 6
      WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 22 WHEN 3 THEN 21
      WHEN 4 THEN 53 ELSE 3306 END AS port,
    CAST(round(value * 100) AS BIGINT) AS size_bytes,
    CASE WHEN value < 90 THEN 'normal' WHEN value < 150 THEN 'suspicious'
      ELSE 'malicious' END AS status
  FROM events""",
    "fw": """
  SELECT packet_id AS log_id, ts, event_type, ip, port, protocol,
    CASE WHEN event_type = 'error' THEN 'blocked' ELSE 'allowed' END AS action,
    concat(upper(protocol), CASE WHEN event_type = 'error' THEN '-BLOCK' ELSE '-ALLOW' END) AS rule,
    CASE WHEN event_type = 'error' THEN 'high' ELSE 'low' END AS severity
  FROM packets""",
    "families": """
  SELECT *, CASE WHEN upper(protocol) IN ('HTTP', 'HTTPS') THEN 'HTTP/HTTPS'
      WHEN upper(protocol) IN ('SSH', 'FTP', 'DNS') THEN upper(protocol) ELSE 'Other' END AS family
  FROM packets""",
    "alerts": """
  SELECT concat(upper(status), ' ', family) AS type, ip, ts,
    CASE status WHEN 'malicious' THEN 'critical' ELSE 'high' END AS severity
  FROM families WHERE status <> 'normal'""",
    "geo": """
  SELECT concat_ws('.', ((167772160 + c_custkey) >> 24) & 255, ((167772160 + c_custkey) >> 16) & 255,
      ((167772160 + c_custkey) >> 8) & 255, (167772160 + c_custkey) & 255) AS ip,
    n_name AS country, r_name AS region, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "rep": """
  SELECT ip, round(-c_acctbal / 10) AS score FROM geo WHERE c_acctbal < 0""",
    "nested": """
  SELECT 167772160 + r_regionkey * 500 AS lo, 167772160 + r_regionkey * 500 + 449 AS hi,
    r_name AS country FROM region
  UNION ALL SELECT 167772160 + n_regionkey * 500 + (n_nationkey % 13) * 30,
    167772160 + n_regionkey * 500 + (n_nationkey % 13) * 30 + 29, n_name FROM nation
  UNION ALL SELECT 167772160 + n_regionkey * 500 + (n_nationkey % 13) * 30,
    167772160 + n_regionkey * 500 + (n_nationkey % 13) * 30 + 14, lower(n_name) FROM nation
  WHERE n_nationkey % 5 = 0""",
    "threat_hours": """
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n FROM packets
  WHERE status = 'malicious' GROUP BY 1""",
    "recent": """
  SELECT * FROM packets WHERE ts > (SELECT max(ts) FROM packets) - INTERVAL 1 HOUR""",
    "earlier": """
  SELECT * FROM packets WHERE ts > (SELECT max(ts) FROM packets) - INTERVAL 2 HOUR
    AND ts <= (SELECT max(ts) FROM packets) - INTERVAL 1 HOUR""",
    "recent_fw": """
  SELECT * FROM fw WHERE ts > (SELECT max(ts) FROM fw) - INTERVAL 1 HOUR""",
    "hours": """
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n FROM packets GROUP BY 1""",
    "hour_spine": """
  SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hours""",
    "hourly": """
  SELECT s.hour, coalesce(c.n, 0) AS n, coalesce(c.n, 0) - coalesce(p.n, 0) AS delta,
    CASE WHEN coalesce(p.n, 0) > 0
      THEN round(100.0 * (coalesce(c.n, 0) - p.n)::DOUBLE / p.n, 4) END AS pct
  FROM hour_spine s LEFT JOIN hours c ON c.hour = s.hour
    LEFT JOIN hours p ON p.hour = s.hour - INTERVAL 1 HOUR""",
    "closed": """
  SELECT max(ts) - INTERVAL 10 MINUTE AS watermark FROM packets""",
    "shares": """
  SELECT family, count(*) AS n,
    round(count(*)::DOUBLE / (SELECT count(*) FROM packets), 4) AS share
  FROM families GROUP BY family""",
    "daily": """
  SELECT p.protocol, coalesce(g.region, '-') AS region,
    time_bucket(INTERVAL 1 DAY, p.ts) AS bucket_start, count(*) AS n
  FROM packets p LEFT JOIN geo g ON g.ip = p.ip GROUP BY 1, 2, 3""",
}

_NEEDS = {
    "fw": ("packets",),
    "families": ("packets",),
    "alerts": ("packets", "families"),
    "rep": ("geo",),
    "recent": ("packets",),
    "earlier": ("packets",),
    "recent_fw": ("packets", "fw"),
    "hours": ("packets",),
    "threat_hours": ("packets",),
    "hour_spine": ("packets", "hours"),
    "hourly": ("packets", "hours", "hour_spine"),
    "closed": ("packets",),
    "shares": ("packets", "families"),
    "daily": ("packets", "geo"),
}


def _sql(ctes: str, body: str) -> str:
    """``body`` after the named common tables and those they need."""
    wanted: set[str] = set()
    for name in ctes.split():
        wanted |= {name, *_NEEDS.get(name, ())}
    listed = [f"{name} AS ({text})" for name, text in _CTES.items() if name in wanted]
    return (f"WITH {', '.join(listed)}\n" if listed else "") + body.strip()


_PACKET = "packet_id, ip, port, protocol, size_bytes, status, ts"
_FIREWALL = "ip, port, action, rule, ts, severity"
_SIZE = """CASE WHEN size_bytes < 1024 THEN concat(size_bytes, ' B')
    ELSE concat(round(size_bytes / 1024.0::DOUBLE, 1), ' KB') END"""
_PARSED = """CAST(CASE WHEN size LIKE '% KB' THEN round(CAST(replace(size, ' KB', '') AS DOUBLE) * 1024)
    ELSE CAST(replace(size, ' B', '') AS DOUBLE) END AS BIGINT)"""
_COUNT = """CASE WHEN {0} >= 999950000 THEN printf('%.1fB', round({0} / 1e9, 1))
    WHEN {0} >= 999950 THEN printf('%.1fM', round({0} / 1e6, 1))
    WHEN {0} >= 1000 THEN printf('%.1fK', round({0} / 1e3, 1))
    ELSE CAST({0} AS VARCHAR) END"""
_GOOD = f"""SELECT ip, port, action, rule, date_trunc('second', ts) AS ts, severity
FROM fw WHERE event_type NOT IN ('purchase', 'signup')"""
_BAD = """SELECT CASE event_type WHEN 'signup' THEN concat('{"ip":"', ip)
  ELSE concat('{"ip":"', ip, '","port":"n/a","action":"', action, '","rule":"', rule,
    '","time":"', strftime(ts, '%Y-%m-%d %H:%M:%S'), '","severity":"', severity, '"}') END AS line
FROM fw WHERE event_type IN ('purchase', 'signup')"""


def _rank(column: str) -> str:
    return (
        f"CAST(CASE {column} WHEN 'normal' THEN 0 WHEN 'suspicious' THEN 1 "
        "WHEN 'malicious' THEN 2 ELSE -1 END AS INT)"
    )


def _hit(source: str, key: str, column: str, table: str, term: str) -> str:
    at = f"instr(lower({column}), '{term}')"
    start = f"greatest({at} - 20, 1)"
    return (
        f"SELECT '{source}' AS source, {key} AS key, '{column}' AS \"column\", "
        f"substr({column}, {start}, {at} - {start} + {len(term)} + 20) AS snippet "
        f"FROM {table} WHERE contains(lower({column}), '{term}')"
    )


ORACLE_SQL = {
    "s1_read_packets": _sql("packets", f"SELECT {_PACKET} FROM packets"),
    "s2_read_firewall": _sql("fw", f"SELECT {_FIREWALL} FROM fw"),
    "s3_ingest_good": _sql("fw", _GOOD),
    "s3_ingest_quarantine": _sql("fw", _BAD),
    "s3_store_logs": _sql(
        "fw",
        """SELECT rule, 'good' AS outcome, count(*) AS n FROM fw
WHERE event_type NOT IN ('purchase', 'signup') GROUP BY rule
UNION ALL SELECT 'none', 'bad', count(*) FROM fw WHERE event_type IN ('purchase', 'signup')""",
    ),
    "s4_stream_packets": _sql("packets", f"SELECT {_PACKET} FROM packets"),
    "s4_stream_firewall": _sql("fw", f"SELECT {_FIREWALL} FROM fw"),
    "s5_export_by_date": _sql(
        "packets",
        """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes
FROM packets GROUP BY 1""",
    ),
    "s6_capture_restart": _sql("fw", f"SELECT {_FIREWALL} FROM fw"),
    "p1_fill_defaults": _sql(
        "fw",
        """SELECT log_id, '-' AS ip, CASE WHEN protocol = 'MySQL' THEN '-' ELSE protocol END AS protocol,
  action, CASE rule WHEN 'SSH-BLOCK' THEN '' WHEN 'DNS-ALLOW' THEN '-' ELSE rule END AS rule
FROM fw""",
    ),
    "p2_classify": _sql(
        "packets",
        "SELECT packet_id, upper(status) AS label, upper(event_type) AS unknown_label FROM packets",
    ),
    "p3_severity_rank": _sql(
        "packets",
        f"SELECT packet_id, {_rank('status')} AS status_rank, {_rank('event_type')} AS unknown_rank"
        " FROM packets",
    ),
    "p3_worst_status": _sql(
        "packets",
        f"""SELECT ip, max({_rank('status')}) AS rank,
  CASE max({_rank('status')}) WHEN 2 THEN 'MALICIOUS' WHEN 1 THEN 'SUSPICIOUS'
    ELSE 'NORMAL' END AS label
FROM packets GROUP BY ip""",
    ),
    "p4_parse_size": _sql(
        "packets",
        f"""SELECT packet_id, size, {_PARSED} AS size_bytes, 'none' AS malformed
FROM (SELECT packet_id, {_SIZE} AS size FROM packets)""",
    ),
    "p5_format_count": _sql(
        "packets",
        f"""SELECT "of", bytes, {_COUNT.format('bytes')} AS shown FROM (
  SELECT ip AS "of", CAST(sum(size_bytes) AS BIGINT) AS bytes FROM packets GROUP BY 1
  UNION ALL
  SELECT protocol, CAST(sum(size_bytes) AS BIGINT) FROM packets GROUP BY 1)""",
    ),
    "p5_format_delta": _sql(
        "hourly",
        """SELECT hour, printf('%+d', delta) AS delta_text,
  printf('%+.1f%%', round(pct, 1) + 0.0) AS pct_text FROM hourly""",
    ),
    "p6_age_text": _sql(
        "packets",
        """SELECT packet_id,
  concat(date_sub('minute', ts, (SELECT max(ts) FROM packets)), 'm ago') AS age FROM packets""",
    ),
    "p7_parse_ts": _sql(
        "packets",
        """SELECT packet_id, date_trunc('second', ts) AS full_ts,
  TIMESTAMP '2024-01-31 00:00:00' + (date_trunc('second', ts) - date_trunc('day', ts)) AS time_ts,
  'none' AS malformed FROM packets""",
    ),
    "p7_raw_packets": _sql(
        "packets",
        f"""SELECT packet_id, ip, port, protocol, {_PARSED} AS size_bytes, status,
  TIMESTAMP '2024-01-31 00:00:00' + (date_trunc('second', ts) - date_trunc('day', ts)) AS ts
FROM (SELECT packet_id, ip, port, protocol, status, ts, {_SIZE} AS size FROM packets)""",
    ),
    "p7_raw_firewall": _sql(
        "fw",
        "SELECT ip, port, action, rule, date_trunc('second', ts) AS ts, severity FROM fw",
    ),
    "p8_protocol_family": _sql(
        "families", "SELECT packet_id, family, family AS family_of_lower FROM families"
    ),
    "p9_risk_label": _sql(
        "packets",
        """SELECT ip, count(*) AS attempts, CASE WHEN count(*) >= 72 THEN 'CRITICAL'
  WHEN count(*) >= 64 THEN 'HIGH' ELSE 'LOW' END AS risk FROM packets GROUP BY ip""",
    ),
    "p10_activity_view": _sql("fw", "SELECT ip, port, action, rule, ts FROM fw"),
    "p10_packet_view": _sql(
        "packets", "SELECT ip, port, protocol, size_bytes, status, ts FROM packets"
    ),
    "f1_filter_protocol": _sql(
        "families", f"SELECT {_PACKET} FROM families WHERE family = 'HTTP/HTTPS'"
    ),
    "f2_filter_status": _sql(
        "packets", f"SELECT {_PACKET} FROM packets WHERE status = 'suspicious'"
    ),
    "f3_filter_packets": _sql(
        "packets",
        f"SELECT {_PACKET} FROM packets WHERE protocol = 'SSH' AND status = 'malicious'",
    ),
    "f4_blocked": _sql("fw", f"SELECT {_FIREWALL} FROM fw WHERE action = 'blocked'"),
    "f5_last_window": _sql(
        "packets",
        f"""SELECT {_PACKET} FROM packets
WHERE ts > (SELECT max(ts) FROM packets) - INTERVAL 6 HOUR""",
    ),
    "f6_search": " UNION ALL ".join(
        _hit(source, key, column, source, "license")
        for source, key, columns in (
            ("documents", "CAST(doc_id AS VARCHAR)", ("text", "lang", "source")),
            ("pages", "CAST(page_id AS VARCHAR)", ("url", "html")),
            ("conversations", "concat(conv_id, ':', turn)", ("role", "text")),
        )
        for column in columns
    ),
    "f6_search_telemetry": _sql(
        "fw",
        " UNION ALL ".join(
            _hit(source, f"CAST({key} AS VARCHAR)", column, table, "ssh")
            for source, key, table, columns in (
                ("packets", "packet_id", "packets", ("ip", "protocol", "status")),
                ("firewall", "log_id", "fw", ("ip", "action", "rule")),
            )
            for column in columns
        ),
    ),
    "f7_lookup": _sql(
        "packets",
        f"""SELECT CAST(packet_id AS VARCHAR) AS packet_id, ip, CAST(port AS VARCHAR) AS port, protocol,
  CAST(size_bytes AS VARCHAR) AS size_bytes, status, ts, asked FROM (
    SELECT {_PACKET}, 'present' AS asked FROM packets
    WHERE packet_id = (SELECT max(packet_id) FROM packets)
    UNION ALL
    SELECT * FROM (SELECT {_PACKET}, 'out of range' FROM packets ORDER BY ts, packet_id LIMIT 1))
UNION ALL
SELECT '-', '-', '-', '-', '-', 'normal', NULL, 'empty table'""",
    ),
    "j1_geo_enrich": _sql(
        "packets geo",
        """SELECT p.packet_id, p.ip, coalesce(g.country, '-') AS country,
  coalesce(g.region, '-') AS region FROM packets p LEFT JOIN geo g ON g.ip = p.ip""",
    ),
    "j2_geo_enrich_ranges": _sql(
        "packets",
        """SELECT p.packet_id, p.ip_long, coalesce(n.n_name, '-') AS country
FROM packets p LEFT JOIN nation n
  ON p.ip_long BETWEEN 167772160 + n.n_nationkey * 60 AND 167772160 + n.n_nationkey * 60 + 59""",
    ),
    "j1_gaps": _sql(
        "packets rep",
        """SELECT p.packet_id, p.ip, coalesce(g.country, '-') AS country,
  coalesce(g.region, '-') AS region
FROM packets p LEFT JOIN (SELECT * FROM geo WHERE c_acctbal < 0) g ON g.ip = p.ip""",
    ),
    "j1_stream": _sql(
        "packets geo",
        """SELECT p.packet_id, p.ip, coalesce(g.country, '-') AS country,
  coalesce(g.region, '-') AS region
FROM packets p LEFT JOIN geo g ON g.ip = p.ip AND (p.status <> 'normal' OR g.c_acctbal < 0)""",
    ),
    "j2_nested": _sql(
        "packets nested",
        """SELECT p.packet_id, p.ip_long,
  coalesce(min_by(n.country, (n.hi - n.lo, n.country)), '-') AS country
FROM packets p LEFT JOIN nested n ON p.ip_long BETWEEN n.lo AND n.hi
GROUP BY p.packet_id, p.ip_long""",
    ),
    "j4_unscanned": """SELECT doc_id, CAST(CASE WHEN length(text) >= 200 THEN strlen(text) ELSE -1 END AS BIGINT)
  AS n_bytes, CASE WHEN length(text) >= 200 THEN 'oversize' ELSE 'missing' END AS reason
FROM documents WHERE coalesce(length(text), 0) < 200 OR strlen(text) > 20480""",
    "j3_reputation_enrich": _sql(
        "packets rep",
        "SELECT p.packet_id, p.ip, r.score FROM packets p LEFT JOIN rep r ON r.ip = p.ip",
    ),
    "j4_match_hashes": """SELECT doc_id, sha256(text) AS sha256 FROM documents
WHERE sha256(text) IN (SELECT sha256(d.text) FROM documents d JOIN labels l
  ON l.doc_id = d.doc_id WHERE l.toxic = 1)""",
    "j4_match_hosts": """WITH hosts AS (
  SELECT page_id, html, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages)
SELECT page_id, host FROM hosts WHERE host IN (SELECT host FROM hosts WHERE contains(html, 'free'))""",
    "j4_match_urls": """WITH cut AS (
  SELECT page_id, html, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host,
    rtrim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') AS path,
    regexp_extract(url, '[?][^#]*') AS query FROM pages),
whole AS (SELECT *, concat(host, path, CASE WHEN length(query) > 1 THEN concat('/', query) ELSE '' END)
  AS url FROM cut),
known AS (SELECT rtrim(concat(host, '/', split_part(path, '/', 2)), '/') AS value FROM whole
    WHERE contains(html, 'free')
  UNION SELECT url FROM whole WHERE page_id % 2 = 0
  UNION SELECT host FROM whole WHERE contains(host, 'adult'))
SELECT page_id, max_by(value, length(value)) AS matched
FROM whole JOIN known ON url = value OR starts_with(url, concat(value, '/')) GROUP BY page_id""",
    "j4_oversize": """SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents
WHERE strlen(text) > 20480""",
    "j5_also_blocked": _sql(
        "fw",
        """SELECT DISTINCT ip, protocol FROM packets p WHERE status = 'malicious'
AND EXISTS (SELECT 1 FROM fw f
  WHERE f.ip = p.ip AND f.protocol = p.protocol AND f.action = 'blocked')""",
    ),
    "j5_never_blocked": _sql(
        "fw",
        """SELECT DISTINCT ip, protocol FROM packets p WHERE status = 'malicious'
AND NOT EXISTS (SELECT 1 FROM fw f
  WHERE f.ip = p.ip AND f.protocol = p.protocol AND f.action = 'blocked')""",
    ),
    "a1_active_threats": _sql(
        "recent", "SELECT count(*) AS active_threats FROM recent WHERE status = 'malicious'"
    ),
    "a2_packets": "SELECT count(*) AS packets FROM events",
    "a2_status_counts": _sql(
        "packets", "SELECT status, count(*) AS n FROM packets GROUP BY status"
    ),
    "a3_suspicious_ips": _sql(
        "packets",
        "SELECT count(DISTINCT ip) AS suspicious_ips FROM packets WHERE status = 'suspicious'",
    ),
    "a4_events_last_hour": _sql("recent_fw", "SELECT count(*) AS events FROM recent_fw"),
    "a5_action_breakdown": _sql(
        "recent_fw",
        """SELECT action, count(*) AS n,
  round(count(*)::DOUBLE / (SELECT count(*) FROM recent_fw), 4) AS share
FROM recent_fw GROUP BY action""",
    ),
    "a6_protocol_share": _sql("shares", "SELECT family, n, share FROM shares"),
    "a7_traffic_5m": _sql(
        "packets",
        """SELECT s.bucket_start, count(*) FILTER (p.status = 'normal') AS normal,
  count(*) FILTER (p.status = 'suspicious') AS suspicious,
  count(*) FILTER (p.status = 'malicious') AS malicious,
  count(p.ts) - count(p.ts) FILTER (p.status IN ('normal', 'suspicious', 'malicious')) AS other
FROM (SELECT unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, min(ts)),
    time_bucket(INTERVAL 5 MINUTE, max(ts)), INTERVAL 5 MINUTE)) AS bucket_start FROM packets) s
LEFT JOIN packets p ON time_bucket(INTERVAL 5 MINUTE, p.ts) = s.bucket_start
GROUP BY s.bucket_start""",
    ),
    "a7_traffic_of_a_day": _sql(
        "packets",
        """SELECT s.bucket_start, count(*) FILTER (p.status = 'normal') AS normal,
  count(*) FILTER (p.status = 'suspicious') AS suspicious,
  count(*) FILTER (p.status = 'malicious') AS malicious, CAST(0 AS BIGINT) AS other
FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-31 18:00:00', TIMESTAMP '2024-01-01 05:55:00',
    INTERVAL 5 MINUTE)) AS bucket_start) s
LEFT JOIN packets p ON time_bucket(INTERVAL 5 MINUTE, p.ts) = s.bucket_start
GROUP BY s.bucket_start""",
    ),
    "a8_top_malicious": _sql(
        "packets geo",
        """SELECT t.ip, coalesce(g.country, '-') AS country, t.attempts,
  CASE WHEN t.attempts >= 9 THEN 'CRITICAL' WHEN t.attempts >= 5 THEN 'HIGH' ELSE 'LOW' END AS risk
FROM (SELECT ip, count(*) AS attempts FROM packets WHERE status = 'malicious'
  GROUP BY ip ORDER BY attempts DESC, ip LIMIT 4) t LEFT JOIN geo g ON g.ip = t.ip""",
    ),
    "a9_top_blocked": _sql(
        "fw",
        """SELECT ip, rule, n FROM (
  SELECT ip, rule, CAST(sum(rule_n) OVER (PARTITION BY ip) AS BIGINT) AS n,
    row_number() OVER (PARTITION BY ip ORDER BY rule_n DESC, rule) AS place
  FROM (SELECT ip, rule, count(*) AS rule_n FROM fw WHERE action = 'blocked' GROUP BY ip, rule))
WHERE place = 1 ORDER BY n DESC, ip LIMIT 4""",
    ),
    "a10_threat_score": _sql(
        "recent",
        """SELECT score, CASE WHEN score >= 70 THEN 'CRITICAL' WHEN score >= 40 THEN 'HIGH'
  ELSE 'LOW' END AS band
FROM (SELECT coalesce(round(avg(CASE status WHEN 'malicious' THEN 1.0::DOUBLE
  WHEN 'suspicious' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) * 100, 4), 0.0::DOUBLE) AS score FROM recent)""",
    ),
    "a11_active_alerts": _sql(
        "alerts",
        """SELECT type, ip, concat(date_sub('minute', ts, (SELECT max(ts) FROM alerts)), 'm ago') AS age,
  upper(severity) AS severity, (SELECT count(*) FROM alerts) AS total_active
FROM alerts ORDER BY ts DESC, ip, type LIMIT 4""",
    ),
    "a_kpi_cards": _sql(
        "recent earlier",
        f"""SELECT 1 AS position, 'Active Threats' AS label, {_COUNT.format('a')} AS value,
  printf('%+d', a - a1) AS delta FROM (
    SELECT (SELECT count(*) FROM recent WHERE status = 'malicious') AS a,
      (SELECT count(*) FROM earlier WHERE status = 'malicious') AS a1)
UNION ALL
SELECT 2, 'Packets Analyzed', {_COUNT.format('a')},
  CASE WHEN n1 > 0 THEN printf('%+.1f%%', round(100.0::DOUBLE * (n - n1) / n1, 1) + 0.0) END FROM (
    SELECT (SELECT count(*) FROM packets) AS a, (SELECT count(*) FROM recent) AS n,
      (SELECT count(*) FROM earlier) AS n1)
UNION ALL
SELECT 3, 'Suspicious IPs', {_COUNT.format('a')}, printf('%+d', n - n1) FROM (
    SELECT (SELECT count(DISTINCT ip) FROM packets WHERE status = 'suspicious') AS a,
      (SELECT count(DISTINCT ip) FROM recent WHERE status = 'suspicious') AS n,
      (SELECT count(DISTINCT ip) FROM earlier WHERE status = 'suspicious') AS n1)""",
    ),
    "w1_hourly_delta": _sql("hourly", "SELECT hour, n, delta, pct FROM hourly"),
    "w1_threats_delta": _sql(
        "threat_hours",
        """SELECT s.hour, coalesce(c.n, 0) AS n, coalesce(c.n, 0) - coalesce(p.n, 0) AS delta,
  CASE WHEN coalesce(p.n, 0) > 0
    THEN round(100.0 * (coalesce(c.n, 0) - p.n)::DOUBLE / p.n, 4) END AS pct
FROM (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM threat_hours) s
  LEFT JOIN threat_hours c ON c.hour = s.hour
  LEFT JOIN threat_hours p ON p.hour = s.hour - INTERVAL 1 HOUR""",
    ),
    "w3_cumulative_share": _sql(
        "shares",
        """SELECT family, round(("upto" - n) / total, 4) AS start, round("upto" / total, 4) AS "end" FROM (
  SELECT family, n, sum(n) OVER () AS total, sum(n) OVER (ORDER BY n DESC, family
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "upto" FROM shares)""",
    ),
    "l1_latest": _sql("fw", f"SELECT log_id, {_FIREWALL} FROM fw ORDER BY ts DESC, log_id LIMIT 20"),
    "l2_in_arrival_order": _sql(
        "packets", f"SELECT {_PACKET} FROM packets ORDER BY ts, packet_id LIMIT 20"
    ),
    "u1_timeline": _sql(
        "fw alerts",
        """SELECT ts, 'packet' AS source, ip, protocol AS kind, upper(status) AS severity FROM packets
UNION ALL SELECT ts, 'firewall', ip, rule, upper(severity) FROM fw
UNION ALL SELECT ts, 'alert', ip, type, upper(severity) FROM alerts""",
    ),
    "u1_of_addresses": _sql(
        "fw alerts",
        """SELECT * FROM (
  SELECT ts, 'packet' AS source, ip, protocol AS kind, upper(status) AS severity FROM packets
  UNION ALL SELECT ts, 'firewall', ip, rule, upper(severity) FROM fw
  UNION ALL SELECT ts, 'alert', ip, type, upper(severity) FROM alerts)
WHERE ip IN (SELECT ip FROM fw WHERE action = 'blocked' GROUP BY ip
  ORDER BY count(*) DESC, ip LIMIT 10)""",
    ),
    "e1_ip_profile": _sql(
        "fw rep",
        """SELECT g.ip, coalesce(p.packets, 0) AS packets, coalesce(p.bytes, 0) AS bytes,
  coalesce(p.normal, 0) AS normal, coalesce(p.suspicious, 0) AS suspicious,
  coalesce(p.malicious, 0) AS malicious, CAST(0 AS BIGINT) AS other,
  coalesce(f.blocked, 0) AS blocked,
  coalesce(f.allowed, 0) AS allowed, least(p.first_ts, f.first_ts) AS first_seen,
  greatest(p.last_ts, f.last_ts) AS last_seen, g.country, r.score
FROM geo g
LEFT JOIN (SELECT ip, count(*) AS packets, CAST(sum(size_bytes) AS BIGINT) AS bytes,
    count(*) FILTER (status = 'normal') AS normal,
    count(*) FILTER (status = 'suspicious') AS suspicious,
    count(*) FILTER (status = 'malicious') AS malicious,
    min(ts) AS first_ts, max(ts) AS last_ts FROM packets GROUP BY ip) p ON p.ip = g.ip
LEFT JOIN (SELECT ip, count(*) FILTER (action = 'blocked') AS blocked,
    count(*) FILTER (action = 'allowed') AS allowed,
    min(ts) AS first_ts, max(ts) AS last_ts FROM fw GROUP BY ip) f ON f.ip = g.ip
LEFT JOIN rep r ON r.ip = g.ip""",
    ),
    "e1_long_list": _sql(
        "fw rep",
        """SELECT a.ip, coalesce(p.packets, 0) AS packets, coalesce(p.bytes, 0) AS bytes,
  coalesce(p.normal, 0) AS normal, coalesce(p.suspicious, 0) AS suspicious,
  coalesce(p.malicious, 0) AS malicious, CAST(0 AS BIGINT) AS other,
  coalesce(f.blocked, 0) AS blocked,
  coalesce(f.allowed, 0) AS allowed, least(p.first_ts, f.first_ts) AS first_seen,
  greatest(p.last_ts, f.last_ts) AS last_seen, coalesce(g.country, '-') AS country, r.score
FROM (SELECT DISTINCT ip FROM packets WHERE status = 'malicious') a
LEFT JOIN geo g ON g.ip = a.ip
LEFT JOIN (SELECT ip, count(*) AS packets, CAST(sum(size_bytes) AS BIGINT) AS bytes,
    count(*) FILTER (status = 'normal') AS normal,
    count(*) FILTER (status = 'suspicious') AS suspicious,
    count(*) FILTER (status = 'malicious') AS malicious,
    min(ts) AS first_ts, max(ts) AS last_ts FROM packets GROUP BY ip) p ON p.ip = a.ip
LEFT JOIN (SELECT ip, count(*) FILTER (action = 'blocked') AS blocked,
    count(*) FILTER (action = 'allowed') AS allowed,
    min(ts) AS first_ts, max(ts) AS last_ts FROM fw GROUP BY ip) f ON f.ip = a.ip
LEFT JOIN rep r ON r.ip = a.ip""",
    ),
    "n1_spikes": _sql(
        "daily",
        """SELECT protocol, region, bucket_start, n, round(mean, 4) AS mean, round(sd, 4) AS stddev
FROM (SELECT c.protocol, c.region, c.bucket_start, c.n, coalesce(sum(b.n), 0) / 7 AS mean,
    sqrt((7 * coalesce(sum(b.n * b.n), 0) - coalesce(sum(b.n), 0) ** 2) / 42) AS sd
  FROM daily c CROSS JOIN range(1, 8) d(back) LEFT JOIN daily b ON b.protocol = c.protocol
    AND b.region = c.region AND b.bucket_start = c.bucket_start - d.back * INTERVAL 1 DAY
  WHERE c.bucket_start - 7 * INTERVAL 1 DAY >= (SELECT min(bucket_start) FROM daily)
  GROUP BY c.protocol, c.region, c.bucket_start, c.n)
WHERE n > mean + 2 * sd""",
    ),
    "t1_stream_traffic": _sql(
        "closed",
        """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket_start, status, count(*) AS n
FROM packets GROUP BY 1, 2
HAVING time_bucket(INTERVAL 5 MINUTE, min(ts)) + INTERVAL 5 MINUTE
  <= (SELECT watermark FROM closed)""",
    ),
    "t2_stream_ingest_good": _sql("fw", _GOOD),
    "t2_stream_ingest_quarantine": _sql("fw", _BAD),
    "t3_stream_actions": _sql(
        "fw closed",
        """SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, action, count(*) AS n
FROM (SELECT action, time_bucket(INTERVAL 5 MINUTE, ts) - unnest(range(12)) * INTERVAL 5 MINUTE
    AS window_start FROM fw)
GROUP BY ALL HAVING window_start + INTERVAL 1 HOUR <= (SELECT watermark FROM closed)""",
    ),
    "t3_shares": _sql(
        "fw closed",
        """SELECT window_start + INTERVAL 1 HOUR AS window_end, action, count(*) AS n,
  round(count(*)::DOUBLE / CAST(sum(count(*)) OVER (PARTITION BY window_start) AS DOUBLE), 4) AS share
FROM (SELECT action, time_bucket(INTERVAL 5 MINUTE, ts) - unnest(range(12)) * INTERVAL 5 MINUTE
    AS window_start FROM fw)
GROUP BY window_start, action
HAVING window_start + INTERVAL 1 HOUR <= (SELECT watermark FROM closed)""",
    ),
    "t_suspicious_ips": _sql(
        "packets closed",
        """SELECT window_start + INTERVAL 1 HOUR AS window_end, count(DISTINCT ip) AS suspicious_ips
FROM (SELECT ip, time_bucket(INTERVAL 5 MINUTE, ts) - unnest(range(12)) * INTERVAL 5 MINUTE
    AS window_start FROM packets WHERE status = 'suspicious')
GROUP BY window_start HAVING window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE
  FROM packets WHERE status = 'suspicious')""",
    ),
    "t4_alert_stream": _sql("alerts", "SELECT type, ip, ts, severity FROM alerts"),
}
ORACLE_SQL["t1_chart"] = ORACLE_SQL["a7_traffic_5m"]
ORACLE_SQL |= {
    "f5_last_window_by_date": ORACLE_SQL["f5_last_window"],
    "f6_indexed": ORACLE_SQL["f6_search"],
    "a8_heavy": ORACLE_SQL["a8_top_malicious"],
    "a9_heavy": ORACLE_SQL["a9_top_blocked"],
    "s3_reingest": ORACLE_SQL["s3_ingest_good"],
    "page_dashboard_threat_score": ORACLE_SQL["a10_threat_score"],
    "page_dashboard_cards": ORACLE_SQL["a_kpi_cards"],
    "page_dashboard_traffic": ORACLE_SQL["a7_traffic_5m"],
    "page_dashboard_hourly": ORACLE_SQL["w1_hourly_delta"],
    "page_dashboard_protocols": ORACLE_SQL["a6_protocol_share"],
    "page_dashboard_segments": ORACLE_SQL["w3_cumulative_share"],
    "page_dashboard_top": ORACLE_SQL["a8_top_malicious"],
    "page_dashboard_view_all": ORACLE_SQL["a8_top_malicious"].replace("LIMIT 4", ""),
    "page_packets_table": _sql(
        "packets",
        f"""SELECT {_PACKET} FROM packets WHERE protocol IN ('HTTP', 'HTTPS') AND status = 'malicious'
ORDER BY ts, packet_id LIMIT 100""",
    ),
    "page_packets_details": _sql("packets", f"SELECT {_PACKET} FROM packets WHERE packet_id = 17"),
    "page_firewall_activity": _sql("recent_fw", "SELECT ip, port, action, rule, ts FROM recent_fw"),
}

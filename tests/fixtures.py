"""The literal rows the dashboard shows (fixed values) as DataFrames."""

from datetime import datetime

from pyspark.sql import functions as F

from netvigil.schemas import ALERT, FIREWALL, PACKET, RAW_PACKET
from netvigil.sources.readers import packets_from_raw

DAY = "2026-04-12"

# Ip, port, protocol, size, status, time.
PACKET_ROWS = [
    ("192.168.1.45", "443", "HTTPS", "1.2 KB", "normal", "14:23:45"),
    ("10.0.0.234", "22", "SSH", "512 B", "suspicious", "14:23:46"),
    ("172.16.0.88", "80", "HTTP", "2.4 KB", "malicious", "14:23:47"),
    ("192.168.0.156", "8080", "HTTP", "3.1 KB", "normal", "14:23:48"),
    ("10.1.1.23", "3306", "MySQL", "768 B", "suspicious", "14:23:49"),
]
# Ip, port, action, rule, time, severity.
FIREWALL_ROWS = [
    ("185.220.101.45", 22, "blocked", "SSH-BRUTE-FORCE", "14:23:45", "high"),
    ("103.56.207.23", 443, "allowed", "HTTPS-ALLOW", "14:23:42", "low"),
    ("45.142.120.67", 3389, "blocked", "RDP-BLOCK", "14:23:38", "high"),
    ("193.164.132.88", 80, "allowed", "HTTP-ALLOW", "14:23:35", "low"),
    ("91.234.55.13", 53, "allowed", "DNS-ALLOW", "14:23:31", "low"),
    ("177.21.9.77", 25, "blocked", "SMTP-SHIELD", "14:23:28", "high"),
    ("210.48.12.19", 8080, "blocked", "PORT-SCAN", "14:23:21", "high"),
]
# Type, ip, minutes ago, severity.
ALERT_ROWS = [
    ("DDoS Attack", "192.168.1.45", 2, "critical"),
    ("Port Scan", "10.0.0.234", 5, "high"),
    ("SQL Injection", "172.16.0.88", 8, "critical"),
    ("Malware Detected", "192.168.0.156", 12, "high"),
]


def raw_packets(spark):
    rows = [(i, *row) for i, row in enumerate(PACKET_ROWS)]
    return spark.createDataFrame(rows, RAW_PACKET)


def packets(spark):
    return packets_from_raw(raw_packets(spark), DAY)


def at(time):
    return datetime.fromisoformat(f"{DAY} {time}")


def firewall(spark):
    rows = [(ip, port, action, rule, at(t), sev) for ip, port, action, rule, t, sev in FIREWALL_ROWS]
    return spark.createDataFrame(rows, FIREWALL)


def alerts(spark):
    rows = [(kind, ip, at(f"14:{30 - age:02d}:00"), sev) for kind, ip, age, sev in ALERT_ROWS]
    return spark.createDataFrame(rows, ALERT)


def traffic(spark, rows, start="2026-04-12 00:00:00"):
    """Packets from (ip, protocol, status, seconds after start)."""
    schema = "packet_id bigint, ip string, protocol string, status string, after bigint"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("after"))
    return df.select(
        "packet_id",
        "ip",
        F.lit(443).alias("port"),
        "protocol",
        F.lit(100).cast("bigint").alias("size_bytes"),
        "status",
        ts.alias("ts"),
    ).select(*PACKET.names)

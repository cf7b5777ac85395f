"""Counts, shares, top lists and the threat score.

Every aggregation combines on the map side first, so a single address that
holds a large part of the rows sends one partial row per task to the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netvigil.functions.labels import (
    classify,
    protocol_family,
    risk_label,
    severity_rank,
    status_weight,
    threat_band,
)
from netvigil.functions.text import age_text, format_count, format_delta
from netvigil.operators.enrich import UNKNOWN_PLACE
from netvigil.operators.filters import as_of_column, blocked, last_window, latest_ts
from netvigil.operators.ranking import latest
from netvigil.operators.sizing import broadcast_top


def kpi_active_threats(df: DataFrame, as_of=None) -> DataFrame:
    """Malicious packets in the trailing hour."""
    recent = last_window(df, as_of)
    return recent.where(F.col("status") == "malicious").agg(F.count("*").alias("active_threats"))


def kpi_packets(df: DataFrame) -> DataFrame:
    """Packets analysed."""
    return df.agg(F.count("*").alias("packets"))


def kpi_suspicious_ips(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct addresses with suspicious packets; ``approx`` for streams or a rough answer."""
    ip = df.where(F.col("status") == "suspicious").select("ip")
    count = F.approx_count_distinct("ip") if approx else F.count_distinct("ip")
    return ip.agg(count.alias("suspicious_ips"))


def status_counts(df: DataFrame) -> DataFrame:
    """Packets per status: (status, n)."""
    return df.groupBy("status").agg(F.count("*").alias("n"))


def events_last_hour(firewall: DataFrame, as_of=None) -> DataFrame:
    """Firewall events in the trailing hour."""
    return last_window(firewall, as_of).agg(F.count("*").alias("events"))


def share_of_counts(counts: DataFrame) -> DataFrame:
    """``counts`` with the share of each ``n``; for the few aggregated rows of an enumeration."""
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", F.round(F.col("n").cast("double") / total, 4))


def action_breakdown(firewall: DataFrame, as_of=None) -> DataFrame:
    """Actions in the trailing hour: (action, n, share)."""
    counts = last_window(firewall, as_of).groupBy("action").agg(F.count("*").alias("n"))
    return share_of_counts(counts).orderBy(F.desc("n"), "action")


def protocol_share(packets: DataFrame) -> DataFrame:
    """Share per protocol family, largest first: (family, n, share)."""
    counts = packets.groupBy(protocol_family(F.col("protocol")).alias("family")).agg(
        F.count("*").alias("n")
    )
    return share_of_counts(counts).orderBy(F.desc("n"), "family")


def top_malicious(
    packets: DataFrame,
    geo: DataFrame,
    k: int = 4,
    critical_min: int = 250,
    high_min: int = 100,
) -> DataFrame:
    """Addresses with most malicious packets: (ip, country, attempts, risk).

    See ``operators/heavy.py`` for telemetry with very many addresses.
    """
    top = (
        packets.where(F.col("status") == "malicious")
        .groupBy("ip")
        .agg(F.count("*").alias("attempts"))
        .orderBy(F.desc("attempts"), "ip")
        .limit(k)
    )
    return malicious_places(top, geo, k, critical_min, high_min)


def malicious_places(
    top: DataFrame, geo: DataFrame, k: int, critical_min: int, high_min: int
) -> DataFrame:
    """The k winners (ip, attempts) with country and risk.

    Only they meet the geo table: they are broadcast (k rows) to pick their rows out of
    it, so the geo table is neither shuffled nor broadcast. An address with several geo
    rows is shown once, with the country that sorts first.
    """
    places = (
        geo.select("ip", "country")
        .join(broadcast_top(top.select("ip"), k), "ip", "left_semi")
        .groupBy("ip")
        .agg(F.min("country").alias("country"))
    )
    return (
        top.join(broadcast_top(places, k), "ip", "left")
        .select(
            "ip",
            F.coalesce("country", F.lit(UNKNOWN_PLACE)).alias("country"),
            "attempts",
            risk_label(F.col("attempts"), critical_min, high_min).alias("risk"),
        )
        .orderBy(F.desc("attempts"), "ip")
    )


def top_blocked(firewall: DataFrame, k: int = 4) -> DataFrame:
    """Most blocked addresses with their most frequent rule: (ip, rule, n).

    Ties: lower address text first, lower rule text first.
    """
    counts = blocked(firewall).groupBy("ip", "rule").agg(F.count("*").alias("rule_n"))
    top = (
        counts.groupBy("ip")
        .agg(F.sum("rule_n").alias("n"))
        .orderBy(F.desc("n"), "ip")
        .limit(k)
        .select(F.col("ip").alias("top_ip"), "n")
    )
    return _with_rule(counts, top, k)


def most_frequent_rules(events: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """The k winners (top_ip, n) with their most frequent rule, counted for them only."""
    of_top = F.col("ip").eqNullSafe(F.col("top_ip"))
    kept = events.select("ip", "rule").join(broadcast_top(top, k), of_top, "left_semi")
    return _with_rule(kept.groupBy("ip", "rule").agg(F.count("*").alias("rule_n")), top, k)


def _with_rule(counts: DataFrame, top: DataFrame, k: int) -> DataFrame:
    return (
        counts.join(broadcast_top(top, k), F.col("ip").eqNullSafe(F.col("top_ip")))
        .groupBy("ip", "n")
        .agg(F.min_by("rule", F.struct(-F.col("rule_n"), F.col("rule"))).alias("rule"))
        .select("ip", "rule", "n")
        .orderBy(F.desc("n"), "ip")
        .limit(k)
    )


def threat_score(packets: DataFrame, as_of=None) -> DataFrame:
    """Mean packet weight of the trailing hour as 0-100, with its band; no packets give 0."""
    mean = F.avg(status_weight(F.col("status"))) * 100
    score = F.coalesce(F.round(mean, 4), F.lit(0.0))
    return (
        last_window(packets, as_of)
        .agg(score.alias("score"))
        .withColumn("band", threat_band(F.col("score")))
    )


def active_alerts(alerts: DataFrame, as_of=None, k: int = 4) -> DataFrame:
    """The latest k alerts with the number of all: (type, ip, age, severity, total_active).

    The total is a scalar subquery over a bare count, not a window over every alert.
    """
    when = as_of_column(alerts, as_of)
    known = alerts if as_of is None else alerts.where(F.col("ts") <= when)
    total = known.agg(F.count("*")).scalar()
    return latest(known, k, "ip", "type").select(
        "type",
        "ip",
        age_text(F.col("ts"), when).alias("age"),
        F.upper("severity").alias("severity"),
        total.alias("total_active"),
    )


def kpi_cards(packets: DataFrame, as_of=None) -> DataFrame:
    """The three KPI cards as shown: (position, label, value, delta).

    ``delta`` compares the trailing hour with the hour before it.
    """

    hour_ago = (
        latest_ts(packets, "1 HOURS")
        if as_of is None
        else as_of_column(packets, as_of) - F.expr("INTERVAL 1 HOURS")
    )
    now = F.col("ts") > hour_ago
    malicious = F.col("status") == "malicious"
    suspicious_ip = F.when(F.col("status") == "suspicious", F.col("ip"))
    hours = last_window(packets, as_of, hours=2).agg(
        F.count_if(now).alias("volume"),
        F.count_if(~now).alias("volume_before"),
        (F.count_if(now & malicious) - F.count_if(~now & malicious)).alias("threats_change"),
        F.count_if(now & malicious).alias("threats"),
        (
            F.count_distinct(F.when(now, suspicious_ip)) - F.count_distinct(F.when(~now, suspicious_ip))
        ).alias("ips_change"),
    )
    upto = packets if as_of is None else packets.where(F.col("ts") <= as_of_column(packets, as_of))
    total = upto.agg(F.count("*")).scalar()
    suspicious = kpi_suspicious_ips(upto).scalar()
    growth = F.try_divide(
        100.0 * (F.col("volume") - F.col("volume_before")), F.col("volume_before").cast("double")
    )
    cards = (
        ("Active Threats", F.col("threats"), format_delta(F.col("threats_change"))),
        ("Packets Analyzed", total, format_delta(growth, pct=True)),
        ("Suspicious IPs", suspicious, format_delta(F.col("ips_change"))),
    )
    return card_rows(hours, cards, format_count)


def card_rows(figures: DataFrame, cards: tuple, shown) -> DataFrame:
    """One row of figures as cards: (position, label, value, delta)."""
    return figures.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(position).alias("position"),
                        F.lit(label).alias("label"),
                        shown(value).alias("value"),
                        delta.alias("delta"),
                    )
                    for position, (label, value, delta) in enumerate(cards, 1)
                ]
            )
        )
    )


def worst_status(packets: DataFrame) -> DataFrame:
    """Worst classification per address: (ip, rank, label).

    Of several unknown statuses the label that sorts last is shown. Text can only be
    aggregated by sorting, so the distinct pairs are taken first, by hash: what is
    sorted is a few rows per address and not the telemetry.
    """
    rank, label = severity_rank(F.col("status")), classify(F.col("status"))
    return (
        packets.select("ip", rank.alias("rank"), label.alias("label"))
        .distinct()
        .groupBy("ip")
        .agg(F.max("rank").alias("rank"), F.max_by("label", F.struct("rank", "label")).alias("label"))
    )

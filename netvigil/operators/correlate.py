"""Combining sources: correlation, one timeline, address profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.functions.labels import STATUSES
from netvigil.operators.bitfilter import key_filter
from netvigil.operators.enrich import UNKNOWN_PLACE
from netvigil.operators.filters import blocked
from netvigil.operators.sizing import BROADCAST_BYTES, store_lookup


def _bad_and_blocked(
    packets: DataFrame, firewall: DataFrame, on: tuple[str, ...]
) -> tuple[DataFrame, DataFrame]:
    # Distinct keys on both sides: repeats of a busy address are removed before
    # the shuffle, and the join then reuses the distincts' partitioning.
    bad = packets.where(F.col("status") == "malicious").select(*on).distinct()
    return bad, blocked(firewall).select(*on).distinct()


def also_blocked(
    packets: DataFrame, firewall: DataFrame, on: tuple[str, ...] = ("ip", "protocol")
) -> DataFrame:
    """Keys with malicious packets that the firewall also blocked."""
    bad, stopped = _bad_and_blocked(packets, firewall, on)
    return bad.join(stopped, list(on), "left_semi")


def never_blocked(
    packets: DataFrame, firewall: DataFrame, on: tuple[str, ...] = ("ip", "protocol")
) -> DataFrame:
    """Keys with malicious packets that the firewall never blocked."""
    bad, stopped = _bad_and_blocked(packets, firewall, on)
    return bad.join(stopped, list(on), "left_anti")


def timeline(packets: DataFrame, firewall: DataFrame, alerts: DataFrame) -> DataFrame:
    """One event list: (ts, source, ip, kind, severity). Severities are upper case."""

    def part(df, source, kind, severity):
        return df.select(
            "ts",
            F.lit(source).alias("source"),
            "ip",
            F.col(kind).alias("kind"),
            F.upper(severity).alias("severity"),
        )

    return (
        part(packets, "packet", "protocol", "status")
        .unionByName(part(firewall, "firewall", "rule", "severity"))
        .unionByName(part(alerts, "alert", "type", "severity"))
    )


def only_of(df: DataFrame, ips: DataFrame, limit_bytes: int | None = BROADCAST_BYTES) -> DataFrame:
    """Rows whose address is in the list ``ips``; null is in no list.

    A list that measures small is broadcast. With a longer one, a filter of a million bytes
    turns away most other addresses at the scan, and what passes is joined by shuffle.
    """
    return _restrict(ips, limit_bytes)[1](df)


def _restrict(
    ips: DataFrame, limit_bytes: int | None
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """(the list, rows of the list only, rows of the list and perhaps some others)."""
    wanted = store_lookup(ips.where("ip IS NOT NULL").select("ip").distinct(), "addresses")
    small = limit_bytes is not None and wanted.n_bytes <= limit_bytes
    if small:
        listed = F.broadcast(wanted.table)
        exact = lambda df: df.join(listed, "ip", "left_semi")
        return wanted.table, exact, exact
    may_contain = key_filter(wanted.table, "ip")
    rough = lambda df: df.where(may_contain(F.col("ip")))
    return wanted.table, lambda df: rough(df).join(wanted.table, "ip", "left_semi"), rough


def ip_profile(
    packets: DataFrame,
    firewall: DataFrame,
    geo: DataFrame,
    ips: DataFrame,
    reputation: DataFrame | None = None,
    limit_bytes: int | None = BROADCAST_BYTES,
) -> DataFrame:
    """One row per requested address, from all sources; unknown addresses count zero.

    ``other`` counts packets of unknown and null status, so that the statuses add up to
    ``packets``. An address with several geo or reputation rows has one profile, with what
    ``geo_enrich`` and ``reputation_enrich`` show.

    A short address list is broadcast to cut every source at its scan, a long one cuts them
    by a filter of fixed size and is joined after each source has been reduced to one row
    per address. Both sources go through a single aggregation, so there is one shuffle of
    partial counts and none of raw rows.
    """
    wanted, _, restrict = _restrict(ips, limit_bytes)
    known = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    is_packet = F.col("source") == "packet"

    flows = restrict(packets.select("ip", "ts", "size_bytes", "status")).withColumn(
        "source", F.lit("packet")
    )
    logs = restrict(firewall.select("ip", "ts", "action")).withColumn("source", F.lit("firewall"))
    activity = (
        flows.unionByName(logs, allowMissingColumns=True)
        .groupBy("ip")
        .agg(
            F.count_if(is_packet).alias("packets"),
            F.sum("size_bytes").alias("bytes"),
            *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
            F.count_if(is_packet & ~known).alias("other"),
            *[F.count_if(F.col("action") == a).alias(a) for a in ("blocked", "allowed")],
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
    )
    places = restrict(geo.select("ip", "country")).groupBy("ip").agg(F.min("country").alias("country"))
    profile = wanted.join(activity, "ip", "left").join(places, "ip", "left")
    if reputation is not None:
        scores = restrict(reputation.select("ip", "score")).groupBy("ip").agg(
            F.max("score").alias("score")
        )
        profile = profile.join(scores, "ip", "left")
    return profile.na.fill(
        0, ["packets", "bytes", *STATUSES, "other", "blocked", "allowed"]
    ).na.fill(UNKNOWN_PLACE, ["country"])


def timeline_of(
    packets: DataFrame,
    firewall: DataFrame,
    alerts: DataFrame,
    ips: DataFrame,
    limit_bytes: int | None = BROADCAST_BYTES,
) -> DataFrame:
    """The timeline of given addresses: each source is cut at its scan."""
    _, only, _ = _restrict(ips, limit_bytes)
    return timeline(only(packets), only(firewall), only(alerts))

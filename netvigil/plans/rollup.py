"""The dashboard from one scan: partial states of the telemetry per five minutes.

A state is a row per bucket, address, protocol and status with its packets and bytes. All
figures of the dashboard but one follow from states: totals, shares, top lists, the traffic
chart and distinct addresses are exact, as every address has rows of its own. The trailing
hour of a reference time between two borders also takes in part of two buckets; for these
the packets themselves are read, whose time filter reaches the scan.

States live in folders by date. A refresh replaces the folders of the dates it is given and
no others, so that it can be repeated, and late packets only cost their own dates.
"""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netvigil.functions.labels import (
    STATUSES,
    protocol_family,
    risk_label,
    status_weight,
    threat_band,
)
from netvigil.functions.text import format_count, format_delta
from netvigil.operators import trends
from netvigil.operators.aggregates import card_rows, share_of_counts
from netvigil.operators.enrich import UNKNOWN_PLACE, geo_lookup
from netvigil.operators.sizing import Lookup, broadcast_top

STEP = "5 minutes"
KEYS = ("bucket_start", "ip", "protocol", "status")


def states(packets: DataFrame) -> DataFrame:
    """Partial states of packets: (bucket_start, ip, protocol, status, n, bytes, first, last).

    Packets without time have a state of their own, whose bucket is null.
    """
    return (
        packets.select(
            trends.bucket_start(STEP).alias("bucket_start"), "ip", "protocol", "status", "size_bytes", "ts"
        )
        .groupBy(*KEYS)
        .agg(
            F.count("*").alias("n"),
            F.sum("size_bytes").alias("bytes"),
            F.min("ts").alias("first"),
            F.max("ts").alias("last"),
        )
    )


def merge_states(*parts: DataFrame) -> DataFrame:
    """States of several parts of the telemetry added up."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy(*KEYS).agg(
        F.sum("n").alias("n"),
        F.sum("bytes").alias("bytes"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )


class Rollup:
    """States kept in a table by date."""

    def __init__(self, spark: SparkSession, path: str, ts_type: T.DataType):
        self.spark, self.path = spark, path
        self.schema = T.StructType(
            [
                T.StructField("bucket_start", ts_type),
                T.StructField("ip", T.StringType()),
                T.StructField("protocol", T.StringType()),
                T.StructField("status", T.StringType()),
                T.StructField("n", T.LongType()),
                T.StructField("bytes", T.LongType()),
                T.StructField("first", ts_type),
                T.StructField("last", ts_type),
                T.StructField("date", T.DateType()),
            ]
        )

    def refresh(self, packets: DataFrame, dates: list[Date] | None = None) -> None:
        """Compute the states of the given dates, or of all, from ``packets`` anew.

        Only the folders of dates that have packets are replaced. ``packets`` must hold all
        packets of the dates it is refreshed for.
        """
        if dates is not None:
            first, last = min(dates), max(dates)
            day = F.to_date("ts")
            near = F.col("ts") >= F.lit(str(first)).cast(packets.schema["ts"].dataType)
            end = F.lit(str(last)).cast(packets.schema["ts"].dataType) + F.expr("INTERVAL 24 HOURS")
            packets = packets.where(near & (F.col("ts") < end) & day.isin(dates))
        dated = states(packets).withColumn("date", F.to_date("bucket_start"))
        (
            # A date goes to few files; one that holds most rows is still split.
            dated.hint("rebalance", "date")
            .write.partitionBy("date")
            .mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .parquet(self.path)
        )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshByPath(self.path)
        return self.spark.read.schema(self.schema).parquet(self.path)


def trailing(kept: DataFrame, packets: DataFrame, hours: int = 1, skip_hours: int = 0) -> DataFrame:
    """States of ``(newest - hours, newest]``, moved back by ``skip_hours``.

    Buckets that lie in the window as a whole come from the states, the parts of the two at
    its ends from the packets.
    """
    last = F.max("last")
    start = kept.agg(last - F.expr(f"INTERVAL {hours + skip_hours} HOURS")).scalar()
    end = kept.agg(last - F.expr(f"INTERVAL {skip_hours} HOURS")).scalar()
    bucket = F.col("bucket_start")
    whole = kept.where((bucket > start) & (bucket + F.expr(f"INTERVAL {STEP}") <= end))

    def border(back: int):
        """Where the bucket of a moment begins."""
        moment = kept.agg((last - F.expr(f"INTERVAL {back} HOURS")).alias("ts"))
        return moment.select(trends.bucket_start(STEP)).scalar()

    # A window that begins on a border has its first bucket but for that one instant.
    ts = F.col("ts")
    in_first = ts < border(hours + skip_hours) + F.expr(f"INTERVAL {STEP}")
    in_last = ts >= border(skip_hours)
    edge = states(packets.where((ts > start) & (ts <= end) & (in_first | in_last)))
    return whole.select(*edge.columns).unionByName(edge)


def dashboard_states(rollup: Rollup, packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states of all time, states of the last two hours with ``now`` telling the last one)."""
    kept = rollup.read().drop("date")
    hours = trailing(kept, packets).withColumn("now", F.lit(True)).unionByName(
        trailing(kept, packets, skip_hours=1).withColumn("now", F.lit(False))
    )
    return kept, hours


def threat_score(hours: DataFrame) -> DataFrame:
    """A10: mean packet weight of the trailing hour as 0-100, with its band."""
    now = F.when(F.col("now"), F.col("n"))
    mean = F.try_divide(F.sum(now * status_weight(F.col("status"))), F.sum(now)) * 100
    score = F.coalesce(F.round(mean, 4), F.lit(0.0))
    return hours.agg(score.alias("score")).withColumn("band", threat_band(F.col("score")))


def kpi_cards(kept: DataFrame, hours: DataFrame) -> DataFrame:
    """A1-A3: the three cards with their changes against the hour before."""

    def volume(now: bool, status: str | None = None):
        wanted = F.col("now") if now else ~F.col("now")
        if status is not None:
            wanted = wanted & (F.col("status") == status)
        return F.coalesce(F.sum(F.when(wanted, F.col("n"))), F.lit(0))

    def addresses(now: bool):
        wanted = (F.col("now") if now else ~F.col("now")) & (F.col("status") == "suspicious")
        return F.count_distinct(F.when(wanted, F.col("ip")))

    recent = hours.agg(
        volume(True).alias("volume"),
        volume(False).alias("volume_before"),
        volume(True, "malicious").alias("threats"),
        (volume(True, "malicious") - volume(False, "malicious")).alias("threats_change"),
        (addresses(True) - addresses(False)).alias("ips_change"),
    )
    total = kept.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    suspicious = kept.where(F.col("status") == "suspicious").agg(F.count_distinct("ip")).scalar()
    growth = F.try_divide(
        100.0 * (F.col("volume") - F.col("volume_before")), F.col("volume_before").cast("double")
    )
    return card_rows(
        recent,
        (
            ("Active Threats", F.col("threats"), format_delta(F.col("threats_change"))),
            ("Packets Analyzed", total, format_delta(growth, pct=True)),
            ("Suspicious IPs", suspicious, format_delta(F.col("ips_change"))),
        ),
        format_count,
    )


def traffic(kept: DataFrame) -> DataFrame:
    """A7: packets per five minutes and status."""
    known = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    n = F.col("n")
    counts = (
        kept.where("bucket_start IS NOT NULL")
        .groupBy("bucket_start")
        .agg(
            *[F.sum(F.when(F.col("status") == s, n).otherwise(0)).alias(s) for s in STATUSES],
            F.sum(F.when(~known, n).otherwise(0)).alias("other"),
        )
    )
    return trends.filled_traffic(counts)


def hourly_delta(kept: DataFrame) -> DataFrame:
    """W1 over states: buckets are weighed by their packets."""
    return trends.hourly_delta(
        kept.where("bucket_start IS NOT NULL").withColumnRenamed("bucket_start", "ts"), weight="n"
    )


def protocol_share(kept: DataFrame) -> DataFrame:
    """A6: share per protocol family."""
    counts = kept.groupBy(protocol_family(F.col("protocol")).alias("family")).agg(F.sum("n").alias("n"))
    return share_of_counts(counts).orderBy(F.desc("n"), "family")


def top_malicious(
    kept: DataFrame,
    geo: DataFrame | Lookup,
    k: int | None = 4,
    critical_min: int = 250,
    high_min: int = 100,
) -> DataFrame:
    """A8; with ``k`` None every address with malicious packets ("View All")."""
    counts = (
        kept.where(F.col("status") == "malicious").groupBy("ip").agg(F.sum("n").alias("attempts"))
    )
    places = geo_lookup(geo)
    if k is not None:
        counts = counts.orderBy(F.desc("attempts"), "ip").limit(k)
        table = places.table.join(broadcast_top(counts.select("ip"), k), "ip", "left_semi")
        table = broadcast_top(table, k)
    else:
        table = places.hinted()
    return (
        counts.join(table.select("ip", "country"), "ip", "left")
        .select(
            "ip",
            F.coalesce("country", F.lit(UNKNOWN_PLACE)).alias("country"),
            "attempts",
            risk_label(F.col("attempts"), critical_min, high_min).alias("risk"),
        )
        .orderBy(F.desc("attempts"), "ip")
    )


def dashboard(
    rollup: Rollup, packets: DataFrame, geo: DataFrame | Lookup, **risk: int
) -> dict[str, DataFrame]:
    """The dashboard's parts; the telemetry itself is read for the edges of two hours only."""
    kept, hours = dashboard_states(rollup, packets)
    shares = protocol_share(kept)
    return {
        "threat_score": threat_score(hours),
        "kpi_cards": kpi_cards(kept, hours),
        "traffic": traffic(kept),
        "hourly_delta": hourly_delta(kept),
        "protocol_share": shares,
        "protocol_segments": trends.cumulative_share(shares),
        "top_malicious": top_malicious(kept, geo, **risk),
        "all_malicious": top_malicious(kept, geo, k=None, **risk),
    }

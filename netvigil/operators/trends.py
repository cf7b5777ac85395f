"""Time buckets, hour-over-hour change, cumulative share and spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netvigil.functions.labels import STATUSES
from netvigil.operators.enrich import UNKNOWN_PLACE, geo_lookup
from netvigil.operators.sizing import BROADCAST_BYTES, Lookup


def bucket_start(step: str, ts: str = "ts"):
    """Start of the tumbling window a row falls in; keeps the type of ``ts``."""
    return F.window(ts, step)["start"]


def _spine(
    counts: DataFrame, bucket: str, step: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Every bucket from the first to the last one in ``counts``; ``step`` divides a day.

    ``start`` and ``end``, if given, stand for the first bucket and for the time at which
    the last one is over. Days are unfolded first and dealt to all tasks, and buckets
    within each day there, so that a single time far off the others makes no task long.
    The bounds are taken with a total over all counts: were those columns unused, the
    optimizer would drop the grouping and scan the telemetry a second time instead of
    reusing its shuffle.
    """
    kind = counts.schema[bucket].dataType
    total = sum((F.sum(c) for c in counts.columns if c != bucket), F.lit(0))
    low, high = F.min(bucket), F.max(bucket)
    if start is not None:
        low = F.lit(start).cast(kind)
    if end is not None:
        high = F.lit(end).cast(kind) - F.expr(f"INTERVAL {step}")
    tasks = counts.sparkSession.sparkContext.defaultParallelism
    return (
        counts.agg(low.alias("lo"), high.alias("hi"), total.alias("total"))
        .where(F.coalesce("total", F.lit(0)) >= 0)
        .where("lo <= hi")
        .select(F.explode(F.expr("sequence(lo, hi, INTERVAL 24 HOURS)")).alias("day"), "hi")
        .repartition(tasks, "day")
        .select(
            F.explode(
                F.expr(
                    "sequence(day, least(hi, day + INTERVAL 24 HOURS - "
                    f"INTERVAL {step}), INTERVAL {step})"
                )
            ).alias(bucket)
        )
    )


SERIES = (*STATUSES, "other")


def _within(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows with ``ts`` in [start, end)."""
    kind = df.schema["ts"].dataType
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col("ts") < F.lit(end).cast(kind))
    return df


def filled_traffic(
    counts: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Counts per five minutes (bucket_start and the series) with quiet buckets as 0.

    Zero rows are added to the aggregated counts and summed again: no join.
    """
    zero = [F.lit(0).cast("bigint").alias(s) for s in SERIES]
    zeros = _spine(counts, "bucket_start", "5 minutes", start, end).select("bucket_start", *zero)
    both = counts.select("bucket_start", *SERIES).unionByName(zeros)
    return both.groupBy("bucket_start").agg(*[F.sum(s).alias(s) for s in SERIES])


def traffic_5m(
    packets: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Packets per five minutes and status, quiet buckets as 0.

    Columns: (bucket_start, normal, suspicious, malicious, other); ``other`` counts
    unknown and null statuses. A packet without time is in no bucket. ``start`` and ``end``,
    on borders of five minutes, bound the chart, and buckets before the first packet or
    after the last one are 0 as well.
    """
    step = "5 minutes"
    known = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    counts = (
        _within(packets, start, end)
        .select(bucket_start(step).alias("bucket_start"), "status")
        .groupBy("bucket_start")
        .agg(
            *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
            F.count_if(~known).alias("other"),
        )
    )
    return filled_traffic(counts, start, end)


def hourly_delta(
    df: DataFrame, start: str | None = None, end: str | None = None, weight: str | None = None
) -> DataFrame:
    """Change against the calendar hour before: (hour, n, delta, pct).

    ``start`` and ``end``, on full hours, bound the hours shown; the first one is compared
    with nothing. A row counts once, or as often as ``weight`` says.

    A quiet hour counts 0; ``pct`` is null if the hour before was quiet. Each
    hour's count is also handed to the following hour, and both are summed per
    hour: this needs neither a self join nor a window over all hours.
    """
    counts = (
        _within(df, start, end)
        .select(bucket_start("1 hour").alias("hour"), *([weight] if weight else []))
        .groupBy("hour")
        .agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    )
    zero = F.lit(0).cast("bigint")
    own = F.struct(
        F.col("hour"), F.col("n"), zero.alias("before"), F.lit(True).alias("in_range")
    )
    handed_on = F.struct(
        (F.col("hour") + F.expr("INTERVAL 1 HOUR")).alias("hour"),
        zero.alias("n"),
        F.col("n").alias("before"),
        F.lit(False).alias("in_range"),
    )
    zeros = _spine(counts, "hour", "1 HOUR", start, end).select(
        "hour", zero.alias("n"), zero.alias("before"), F.lit(True).alias("in_range")
    )
    change = F.col("n") - F.col("before")
    return (
        counts.select(F.inline(F.array(own, handed_on)))
        .unionByName(zeros)
        .groupBy("hour")
        .agg(F.sum("n").alias("n"), F.sum("before").alias("before"), F.max("in_range").alias("keep"))
        .where("keep")
        .select(
            "hour",
            "n",
            change.alias("delta"),
            F.round(
                F.try_divide(F.lit(100.0) * change, F.col("before").cast("double")), 4
            ).alias("pct"),
        )
    )


def cumulative_share(shares: DataFrame) -> DataFrame:
    """Chart segments in display order: (family, start, end), from (family, n).

    Shares are running counts over the total, rounded once, so the last one ends at 1.
    The running sum is global, over one row per protocol family.
    """
    order = Window.orderBy(F.desc("n"), "family").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy())
    end = F.sum("n").over(order)
    return shares.select(
        "family",
        F.round((end - F.col("n")) / total, 4).alias("start"),
        F.round(end / total, 4).alias("end"),
    )


def bucket_counts(
    packets: DataFrame,
    geo: DataFrame | Lookup,
    bucket: str,
    limit_bytes: int | None = BROADCAST_BYTES,
) -> DataFrame:
    """Packets per protocol, region and bucket: (protocol, region, bucket_start, n).

    An address with several geo rows counts once, with the place that ``geo_enrich`` shows.
    A small geo table is broadcast into the scan, and one aggregation follows.
    With a large one, packets are first counted per address, so that counts and
    not packets are shuffled to the join.
    """
    keyed = packets.select("ip", "protocol", bucket_start(bucket).alias("bucket_start"))
    lookup = geo_lookup(geo)
    places = lookup.hinted(limit_bytes).select("ip", "region")
    keys = ("protocol", "region", "bucket_start")
    if limit_bytes is not None and lookup.n_bytes <= limit_bytes:
        placed = keyed.join(places, "ip", "left").na.fill(UNKNOWN_PLACE, ["region"])
        return placed.groupBy(*keys).agg(F.count("*").alias("n"))
    per_ip = keyed.groupBy("ip", "protocol", "bucket_start").agg(F.count("*").alias("ip_n"))
    placed = per_ip.join(places, "ip", "left").na.fill(UNKNOWN_PLACE, ["region"])
    return placed.groupBy(*keys).agg(F.sum("ip_n").alias("n"))


def spikes(
    packets: DataFrame,
    geo: DataFrame | Lookup,
    bucket: str = "1 day",
    n: int = 7,
    k: float = 2.0,
    limit_bytes: int | None = BROADCAST_BYTES,
) -> DataFrame:
    """Buckets whose count exceeds mean + k standard deviations of the n before them.

    Columns: (protocol, region, bucket_start, n, mean, stddev). A quiet bucket counts
    0, as in the other trends: the window spans times, and sums over it need no rows for
    quiet buckets. There is no spike in the first n buckets of the table. Above a baseline
    without spread every larger count is a spike. ``bucket`` is a number and a unit.
    """
    counts = bucket_counts(packets, geo, bucket, limit_bytes)
    return spikes_of(counts, packets.agg(F.min("ts")).scalar(), bucket, n, k)


def spikes_of(counts: DataFrame, first, bucket: str, n: int, k: float) -> DataFrame:
    """``spikes`` of given counts; ``first`` is the oldest time in the telemetry.

    The sums of squares are decimals of 38 digits: counts of any size fit.
    """
    number, unit = bucket.split()
    span = f"""OVER (PARTITION BY protocol, region ORDER BY bucket_start
        RANGE BETWEEN INTERVAL {n * int(number)} {unit} PRECEDING AND INTERVAL {bucket} PRECEDING)"""
    reaches_back = first < F.col("bucket_start") - F.expr(f"INTERVAL {(n - 1) * int(number)} {unit}")
    exact = "CAST(n AS DECIMAL(19, 0))"
    spread = n * F.col("squares") - F.col("total") * F.col("total")
    return (
        counts.withColumns(
            {
                "total": F.coalesce(F.expr(f"CAST(sum({exact}) {span} AS DECIMAL(19, 0))"), F.lit(0)),
                "squares": F.coalesce(F.expr(f"sum({exact} * {exact}) {span}"), F.lit(0)),
            }
        )
        .withColumns(
            {
                "mean": F.col("total").cast("double") / n,
                "stddev": F.sqrt(spread.cast("double") / (n * (n - 1))),
            }
        )
        .where(reaches_back & (F.col("n") > F.col("mean") + k * F.col("stddev")))
        .select(
            "protocol",
            "region",
            "bucket_start",
            "n",
            F.round("mean", 4).alias("mean"),
            F.round("stddev", 4).alias("stddev"),
        )
    )

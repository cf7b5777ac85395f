"""The most frequent keys of a table with very many keys.

A plain count sends nearly every row to the shuffle if keys seldom repeat within a task.
Here keys are first counted by bucket of their hash: at most ``BUCKETS`` short rows a task.
A bucket's count is at least that of each key in it, which bounds the keys not yet counted:

1. count rows by bucket;
2. count the keys of the k fullest buckets; the k-th largest of these counts is a floor
   that the answer cannot fall below;
3. count the keys of the other buckets that reach the floor. No other key can be in the answer.

The answer is exact on any data. If the buckets that reach the floor hold more than
``MOST`` of all rows, as on flat data, the bound does not separate and the keys are counted
plainly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.operators.aggregates import malicious_places, most_frequent_rules
from netvigil.operators.filters import blocked
from netvigil.operators.sizing import store_measured

BUCKETS = 1 << 16
MOST = 0.5


def _largest(counts: DataFrame, key: str, k: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), key).limit(k)


def top_keys(df: DataFrame, key: str, k: int, buckets: int = BUCKETS, most: float = MOST) -> DataFrame:
    """The k most frequent values of a column, exactly: (key, n); ties by lower key.

    Null counts as a value and comes first among ties. Fewer than k values are all
    returned, an empty table gives no row.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = df.select(key)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    sizes, totals = store_measured(
        rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("size")),
        "buckets",
        n=F.sum("size"),
    )

    def of_buckets(chosen: DataFrame) -> DataFrame:
        """Counts of the keys in some of the buckets, of which there are at most ``buckets``."""
        kept = rows.withColumn("bucket", bucket)
        kept = kept.join(F.broadcast(chosen.select("bucket")), "bucket", "left_semi")
        return kept.groupBy(key).agg(F.count("*").alias("n"))

    fullest = sizes.orderBy(F.desc("size"), "bucket").limit(k)
    probed, of_probed = store_measured(
        _largest(of_buckets(fullest), key, k), "probed", least=F.min("n"), found=F.count("*")
    )
    floor = of_probed["least"] if of_probed["found"] == k else 0
    reach = sizes.where(F.col("size") >= floor)
    if (reach.agg(F.sum("size")).first()[0] or 0) > most * totals["n"]:
        return _largest(rows.groupBy(key).agg(F.count("*").alias("n")), key, k)
    others = of_buckets(reach.join(F.broadcast(fullest), "bucket", "left_anti"))
    return _largest(probed.unionByName(others), key, k)


def heavy_malicious(
    packets: DataFrame,
    geo: DataFrame,
    k: int = 4,
    critical_min: int = 250,
    high_min: int = 100,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``top_malicious`` for very many addresses, with the same result."""
    top = top_keys(packets.where(F.col("status") == "malicious"), "ip", k, buckets)
    top = top.withColumnRenamed("n", "attempts")
    return malicious_places(top, geo, k, critical_min, high_min)


def heavy_blocked(firewall: DataFrame, k: int = 4, buckets: int = BUCKETS) -> DataFrame:
    """``top_blocked`` for very many addresses, with the same result.

    Rules are counted for the winners only.
    """
    top = top_keys(blocked(firewall), "ip", k, buckets).select(F.col("ip").alias("top_ip"), "n")
    return most_frequent_rules(blocked(firewall), top, k)

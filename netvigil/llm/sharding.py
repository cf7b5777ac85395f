"""Uniform sharding by a hypergeometric communication matrix.

Rows lie in buckets. How many rows of each bucket go to each shard is drawn first, from
the exact multivariate hypergeometric law, so that shard sizes are fixed and differ by
at most one. The matrix is drawn by halving: a node of a binary tree over the buckets
knows how many rows each shard takes from it and draws what its left half contributes;
nodes of a level are independent. Then each bucket is permuted and dealt by its row of
the matrix, rows are exchanged, and each shard is permuted again.

No task holds a bucket or shard whole because it must: buckets hold about ``bucket_rows``
rows, and a shard is permuted in parts of that size. The matrix has at most
``MAX_BUCKETS`` rows, whatever the input; it and the parts' offsets are what is broadcast.

A row is told by ``doc_id`` and its text unless other columns are named; reruns agree. Repeated rows are dealt
separately, null ids and texts are values like others, an empty table gives no rows, and
other columns are carried along unless they bear the names of the added ones, which are
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netvigil.llm.common import let, stored, uniform

MAX_BUCKETS = 1 << 15
BUCKET_ROWS = 4096
# The law is cut where a tail of this many standard deviations begins: below 1e-30.
TAIL = 12.0


def _walk(mode: Column, end: Column, ratio, up: bool):
    """(sum of the weights from the mode to ``end``, search for a weight), the mode weighing 1."""
    step = 1 if up else -1
    far = F.when(end > mode, end) if up else F.when(end < mode, end)
    points = F.coalesce(
        F.when(far.isNotNull(), F.sequence(mode + step, far, F.lit(step).cast("long"))),
        F.array().cast("array<bigint>"),
    )

    def total():
        zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))

        def add(s, k):
            return let(
                s.w * ratio(k),
                lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum")),
            )

        return F.aggregate(points, zero, add, lambda s: s["sum"])

    def find(target: Column):
        zero = F.struct(
            F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("at")
        )

        def add(s, k):
            return let(
                s.w * ratio(k),
                lambda w: F.struct(
                    w.alias("w"),
                    (s["sum"] + w).alias("sum"),
                    F.coalesce(s.at, F.when(s["sum"] + w >= target, k)).alias("at"),
                ),
            )

        return F.aggregate(points, zero, add, lambda s: F.coalesce(s.at, mode))

    return total, find


def _hypergeometric(u: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """How many of ``drawn`` rows out of ``population`` are among its ``marked``: inverse of
    the distribution function, its points taken from the mode upwards, then downwards."""
    lo = F.greatest(F.lit(0).cast("long"), drawn - (population - marked))
    hi = F.least(marked, drawn)
    mode = F.greatest(
        lo,
        F.least(hi, F.floor((drawn + 1.0) * (marked + 1.0) / (population + 2.0)).cast("long")),
    )
    share = marked / F.greatest(population, F.lit(1))
    reach = (
        F.ceil(TAIL * F.sqrt(F.greatest(F.lit(0.0), drawn * share * (1.0 - share)))) + 16
    ).cast("long")

    def upward(k):  # weight(k) / weight(k - 1)
        return ((marked - k + 1.0) * (drawn - k + 1.0)) / (
            k * (population - marked - drawn + k * 1.0)
        )

    def downward(k):  # weight(k) / weight(k + 1)
        return ((k + 1.0) * (population - marked - drawn + k + 1.0)) / (
            (marked - k) * (drawn - k * 1.0)
        )

    above, find_above = _walk(mode, F.least(hi, mode + reach), upward, True)
    below, find_below = _walk(mode, F.greatest(lo, mode - reach), downward, False)

    def choose(sums):
        target = u * (1.0 + sums.above + sums.below)
        return (
            F.when(target < 1.0, mode)
            .when(target - 1.0 < sums.above, find_above(target - 1.0))
            .otherwise(find_below(target - 1.0 - sums.above))
        )

    return let(F.struct(above().alias("above"), below().alias("below")), choose)


def _share_out(caps: Column, drawn: Column, node: Column, level: int, seed: int) -> Column:
    """How ``drawn`` rows split over shards that still take ``caps`` rows each."""
    start = F.struct(
        F.aggregate(caps, F.lit(0).cast("long"), lambda a, c: a + c).alias("left"),
        drawn.alias("drawn"),
        F.array().cast("array<bigint>").alias("out"),
    )

    def step(s, cap):
        u = uniform(F.lit(seed), F.lit(level), node, F.size(s.out))
        return let(
            _hypergeometric(u, s.left, cap, s.drawn),
            lambda n: F.struct(
                (s.left - cap).alias("left"),
                (s.drawn - n).alias("drawn"),
                F.concat(s.out, F.array(n)).alias("out"),
            ),
        )

    return F.aggregate(caps, start, step, lambda s: s.out)


def communication_matrix(counts: DataFrame, levels: int, shards: int, seed: int) -> DataFrame:
    """(bucket, row_count, takes): what each shard takes from each of 2**levels buckets.

    ``counts`` has (bucket, row_count), missing buckets being empty.
    """
    spark = counts.sparkSession
    grid = spark.range(2**levels).withColumnRenamed("id", "bucket")
    sizes = grid.join(counts, "bucket", "left").agg(
        F.sort_array(
            F.collect_list(F.struct("bucket", F.coalesce("row_count", F.lit(0)).alias("n")))
        ).alias("rows")
    )
    nodes = sizes.select(
        F.lit(0).cast("long").alias("node"), F.transform("rows", lambda r: r.n).alias("sizes")
    ).withColumn(
        "caps",
        let(
            F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n),
            lambda n: F.transform(
                F.sequence(F.lit(0), F.lit(shards - 1)),
                lambda k: F.floor(n / shards).cast("long")
                + F.when(k < n % shards, 1).otherwise(0).cast("long"),
            ),
        ),
    )
    for level in range(levels):
        if level == 6:  # from here on there is enough to share out
            nodes = nodes.repartition("node")
        half = 2 ** (levels - level - 1)
        left = F.slice("sizes", 1, half)
        nodes = (
            nodes.withColumn("left", left)
            .withColumn("right", F.slice("sizes", half + 1, half))
            .withColumn("drawn", F.aggregate("left", F.lit(0).cast("long"), lambda a, n: a + n))
            .withColumn(
                "taken", _share_out(F.col("caps"), F.col("drawn"), F.col("node"), level, seed)
            )
            .select(
                F.explode(
                    F.array(
                        F.struct(
                            (F.col("node") * 2).alias("node"),
                            F.col("left").alias("sizes"),
                            F.col("taken").alias("caps"),
                        ),
                        F.struct(
                            (F.col("node") * 2 + 1).alias("node"),
                            F.col("right").alias("sizes"),
                            F.zip_with("caps", "taken", lambda a, b: a - b).alias("caps"),
                        ),
                    )
                ).alias("child")
            )
            .select("child.*")
        )
    return nodes.select(
        F.col("node").alias("bucket"),
        F.get("sizes", F.lit(0)).alias("row_count"),
        F.col("caps").alias("takes"),
    )


def _until(numbers: Column) -> Column:
    """Running totals of an array."""
    return F.aggregate(
        numbers,
        F.array().cast("array<bigint>"),
        lambda a, n: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + n)),
    )


def shard(
    docs: DataFrame,
    shards: int = 8,
    seed: int = 17,
    bucket_rows: int = BUCKET_ROWS,
    identity: tuple[str, ...] = ("doc_id", "text"),
) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard).

    ``identity`` names the columns that tell rows apart.
    """
    docs = docs.drop("shard", "slot")
    told_by = F.xxhash64(F.lit(seed), *identity)

    def bucket_of(levels: int) -> Column:
        return F.pmod(told_by, F.lit(2**levels)).alias("bucket")

    # The finest grid is counted once; how many buckets are used follows from the total.
    fine = int(math.log2(MAX_BUCKETS))
    counted = stored(
        docs.groupBy(bucket_of(fine)).agg(F.count("*").alias("row_count")), "shard-buckets"
    )
    total = counted.agg(F.coalesce(F.sum("row_count"), F.lit(0))).first()[0]
    levels = min(fine, max(0, math.ceil(math.log2(max(1, total / bucket_rows)))))
    counts = counted.groupBy(F.pmod("bucket", F.lit(2**levels)).alias("bucket")).agg(
        F.sum("row_count").alias("row_count")
    )
    matrix = stored(communication_matrix(counts, levels, shards, seed), "shard-matrix").withColumn(
        "until", _until(F.col("takes"))
    )

    # Where a row of a bucket goes depends on its place in the permuted bucket only.
    parts = max(1, math.ceil(total / shards / bucket_rows))
    to_shard = F.size(F.filter("until", lambda n: n < F.col("place"))).alias("shard")
    ticket = F.xxhash64(F.lit(seed + 1), "bucket", "place")

    def part_of(ticket: Column) -> Column:
        return F.pmod(F.shiftrightunsigned(ticket, 20), F.lit(parts)).alias("part")

    dealt = (
        matrix.where("row_count > 0")
        .repartition("bucket")
        .withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), "row_count")))
        .select(to_shard, part_of(ticket))
        .groupBy("shard", "part")
        .agg(F.count("*").alias("n"))
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = stored(
        dealt.select(
            "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
        ),
        "shard-offsets",
    )

    carried = [F.col(c) for c in docs.columns]
    row = F.struct(*carried).alias("row")
    placed = (
        docs.select(row, bucket_of(levels), told_by.alias("ticket"))
        .withColumn(
            "place",
            F.row_number()
            .over(
                Window.partitionBy("bucket").orderBy(
                    F.xxhash64(F.lit(seed + 2), "ticket"), "ticket"
                )
            )
            .cast("long"),
        )
        # At most MAX_BUCKETS rows of `shards` numbers each.
        .join(F.broadcast(matrix.select("bucket", "until")), "bucket")
        .select("row", to_shard, ticket.alias("ticket"))
        .withColumn("part", part_of(F.col("ticket")))
    )
    joined = placed.withColumn(
        "rank",
        F.row_number().over(Window.partitionBy("shard", "part").orderBy("ticket")),
    )
    if shards * parts <= MAX_BUCKETS:
        offsets = F.broadcast(offsets)
    return joined.join(offsets, ["shard", "part"]).select(
        "row.*", "shard", (F.col("offset") + F.col("rank") - 1).alias("slot")
    )

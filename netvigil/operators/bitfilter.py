"""A filter of fixed size that tells at the scan which keys cannot be in a long list.

Its bits are set by one aggregation over the list and reach the scans of large tables as a
scalar subquery, inside generated code. Some keys pass that are not in the list, none is
lost, so that a join against the list follows; a fuller filter only lets more pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 23  # 2**23 bits, a million bytes, however long the list is


def key_filter(keys: DataFrame, column: str, bits: int = BITS) -> Callable[[Column], Column]:
    """A condition on a key that holds for every key in ``keys[column]``; null never passes."""
    spark = keys.sparkSession

    def place(key: Column) -> Column:
        return F.xxhash64(key).bitwiseAND(2**bits - 1)

    words = (
        keys.where(F.col(column).isNotNull())
        .select(place(F.col(column)).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("set"))
    )
    # One array of 2**bits / 64 numbers: the bound of what is gathered here.
    every = spark.range(2 ** (bits - 6)).select(
        F.col("id").alias("word"), F.lit(0).cast("bigint").alias("set")
    )
    gathered = (
        words.unionByName(every)
        .groupBy("word")
        .agg(F.bit_or("set").alias("set"))
        .agg(F.array_sort(F.collect_list(F.struct("word", "set"))).alias("words"))
        .select(F.col("words.set"))
    )
    table = gathered.scalar()

    def may_contain(key: Column) -> Column:
        at = place(key)
        word = F.get(table, F.shiftright(at, 6).cast("int"))
        return key.isNotNull() & (F.getbit(word, at.bitwiseAND(63).cast("int")) == 1)

    return may_contain

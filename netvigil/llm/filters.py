"""A fixed-size filter of 64-bit keys, made by Spark and broadcast.

It tells some keys wrongly as members and never the other way, so that what passes it has
to be joined with the keys; a filter that many keys have filled only lets more pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 25  # 2**25 bits: 4 MB


class Filter:
    """The keys (column ``key``, bigint) as bits."""

    def __init__(self, keys: DataFrame):
        words = 1 << (FILTER_BITS - 6)
        bits = F.explode(
            F.array(
                *[
                    F.shiftrightunsigned(F.col("key"), shift).bitwiseAND(2**FILTER_BITS - 1)
                    for shift in (0, 32)
                ]
            )
        )
        rows = (
            keys.select(bits.alias("bit"))
            .groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits"))
        )
        self.words = np.zeros(words, np.int64)
        # At most 2**FILTER_BITS / 64 rows: 8 MB in one job, however many partitions there are.
        found = rows.toArrow()
        self.words[found.column("word").to_numpy()] = found.column("bits").to_numpy()

    def __call__(self, key: np.ndarray) -> np.ndarray:
        words = self.words.view(np.uint64)
        found = np.ones(len(key), bool)
        for shift in (0, 32):
            bit = (key >> np.uint64(shift)) & np.uint64(2**FILTER_BITS - 1)
            word = words[(bit >> np.uint64(6)).astype(np.int64)]
            found &= (word >> (bit & np.uint64(63))) & np.uint64(1) > 0
        return found

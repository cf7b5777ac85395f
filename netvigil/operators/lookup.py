"""Point lookup and global search."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.functions.columns import PACKET_DEFAULTS


def lookup_or_first(
    df: DataFrame, key: int | None, key_column: str = "packet_id", order: tuple[str, ...] = ("ts", "packet_id")
) -> DataFrame:
    """The row with the given key; else the first row in ``order``; else one sentinel row.

    Which row to show is settled by one aggregate over the key and order columns;
    the whole row is then read by its key, a filter the scan uses to skip row
    groups. ``key_column`` must be unique but for rows without a key, which the order
    columns tell apart.
    """
    columns = dict.fromkeys((*order, key_column))
    rank = F.struct(
        F.coalesce(F.col(key_column) != key, F.lit(True)).alias("other"),
        *[
            part
            for c in columns
            for part in (F.col(c).isNull().alias(f"no_{c}"), F.col(c).alias(f"of_{c}"))
        ],
    )
    chosen = df.agg(F.min(rank).alias("row"))
    row = df
    for c in columns:
        row = row.where(F.col(c).eqNullSafe(chosen.select(f"row.of_{c}").scalar()))
    row = row.withColumn("prio", F.lit(0)).where(chosen.select(F.col("row").isNotNull()).scalar())

    sentinel = df.sparkSession.range(1).select(
        *[
            F.lit(PACKET_DEFAULTS.get(f.name, "-") if f.dataType.simpleString() == "string" else None)
            .cast(f.dataType)
            .alias(f.name)
            for f in df.schema
        ],
        F.lit(1).alias("prio"),
    )
    return row.unionByName(sentinel).orderBy("prio").limit(1).drop("prio")


def search(
    tables: dict[str, tuple[DataFrame, list[str], list[str]]], term: str, context: int = 20
) -> DataFrame:
    """Case-insensitive literal search: (source, key, column, snippet), one row per matching field.

    ``tables`` maps a source name to (table, key columns, text columns). The
    whole text is searched; the snippet shows the first match with ``context``
    characters on either side. Each table is scanned once, however many of its
    columns are searched.
    """
    pattern = rf"(?iu)\Q{term}\E" if r"\E" not in term else "(?iu)" + re.escape(term)
    found = []
    for source, (df, keys, columns) in tables.items():
        key = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
        # What stands before and after the first match; one part if there is none.
        fields = F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.split(c, pattern, 2).alias("parts"), F.col(c).alias("text"))
                for c in columns
            ]
        )
        hits = F.filter(fields, lambda x: F.size(x.parts) == 2)
        before, after = F.col("parts")[0], F.col("parts")[1]
        start = F.greatest(F.length(before) - context + 1, F.lit(1))
        end = F.length("text") - F.length(after) + context
        found.append(
            df.select(key.alias("key"), F.inline(hits)).select(
                F.lit(source).alias("source"),
                "key",
                "column",
                F.substring(F.col("text"), start, end - start + 1).alias("snippet"),
            )
        )
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result

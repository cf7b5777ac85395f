"""Lookups that add columns to telemetry, or match it against indicators.

A lookup is reduced to one row per key, stored once and measured; it is broadcast only if
it is small, see sizing.py for the other way. A ``Lookup`` made before, by ``geo_lookup``
and its like, can be given wherever a lookup table is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.functions.text import url_host, url_parts, url_prefix
from netvigil.operators.bitfilter import key_filter
from netvigil.operators.sizing import BROADCAST_BYTES, Lookup, store_lookup, store_measured

MAX_SCAN_BYTES = 256 * 1024 * 1024  # fixed value: larger content is refused
UNKNOWN_PLACE = "-"  # fixed value: shown where an address has no country


def geo_lookup(geo: DataFrame | Lookup) -> Lookup:
    """One row per address: of several the least by country, then region, counts."""
    if isinstance(geo, Lookup):
        return geo
    places = [c for c in ("country", "region") if c in geo.columns]
    once = geo.groupBy("ip").agg(F.min(F.struct(*places)).alias("place")).select("ip", "place.*")
    return store_lookup(once, "geo")


def geo_enrich(
    df: DataFrame, geo: DataFrame | Lookup, limit_bytes: int | None = BROADCAST_BYTES
) -> DataFrame:
    """Add country (and region, if the table has one) by address; ``-`` if unknown.

    No telemetry row is multiplied, however often the table has an address.
    """
    lookup = geo_lookup(geo)
    places = [c for c in ("country", "region") if c in lookup.table.columns]
    return df.join(lookup.hinted(limit_bytes), "ip", "left").na.fill(UNKNOWN_PLACE, places)


def flat_ranges(ranges: DataFrame) -> DataFrame:
    """Disjoint pieces of address ranges, the narrowest range winning: (p16, lo, hi, country).

    Ranges may overlap and nest; of equally wide ones the least by country counts. Ranges
    that end before they start, or without country, are left out. Each is cut at the
    borders of its /16 blocks. A block's pieces come by from the widest to the narrowest
    and are painted over each other on the block's 65,536 addresses; what is seen in the
    end are its disjoint pieces. A task holds one block's addresses at a time, however
    many ranges there are, and a range makes at most 65,536 pieces.
    """
    pieces = (
        ranges.where("start <= end AND country IS NOT NULL")
        .select(
            F.explode(F.sequence(F.shiftright("start", 16), F.shiftright("end", 16))).alias("p16"),
            "start",
            "end",
            "country",
        )
        .select(
            "p16",
            F.greatest(F.col("start") - F.shiftleft("p16", 16), F.lit(0)).cast("int").alias("from"),
            F.least(F.col("end") - F.shiftleft("p16", 16), F.lit(0xFFFF)).cast("int").alias("to"),
            (F.col("end") - F.col("start")).alias("width"),
            "country",
        )
        # Of the ranges that give a block the same piece, only one can be seen.
        .groupBy("p16", "from", "to")
        .agg(F.min(F.struct("width", "country")).alias("best"))
        .select("p16", "from", "to", "best.width", "best.country")
        .repartition("p16")
        .sortWithinPartitions("p16", F.desc("width"), F.desc("country"))
    )

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x10000, np.int32)  # number of the piece on top, from 1; 0: none
        names: list[str] = []
        block = None

        def shown() -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(seen, prepend=-1))
            last = np.append(cut[1:], len(seen)) - 1
            top = seen[cut]
            kept = top > 0
            base = block << 16
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(kept.sum(), block), pa.int64()),
                    pa.array(base + cut[kept], pa.int64()),
                    pa.array(base + last[kept], pa.int64()),
                    pa.array([names[i - 1] for i in top[kept]], pa.string()),
                ],
                ["p16", "lo", "hi", "country"],
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("p16", "from", "to", "country")]
            for p16, low, high, country in zip(*columns, strict=True):
                if p16 != block:
                    if block is not None:
                        yield shown()
                    block, names = p16, []
                    seen[:] = 0
                if not names or names[-1] != country:
                    names.append(country)
                seen[low : high + 1] = len(names)
        if block is not None:
            yield shown()

    return pieces.mapInArrow(paint, "p16 bigint, lo bigint, hi bigint, country string")


def range_lookup(ranges: DataFrame | tuple[Lookup, Lookup]) -> tuple[Lookup, Lookup]:
    """Whole /16 blocks and, by /24, the pieces of the others: one stored table, measured as
    the two that are read from it."""
    if isinstance(ranges, tuple):
        return ranges
    is_whole = F.col("hi") - F.col("lo") == 0xFFFF
    name = F.octet_length("country")
    copies = F.shiftright("hi", 8) - F.shiftright("lo", 8) + 1
    flat, sizes = store_measured(
        flat_ranges(ranges),
        "ranges",
        whole=F.sum(F.when(is_whole, 16 + name)),
        ends=F.sum(F.when(~is_whole, copies * (32 + name))),
    )
    whole = flat.where(is_whole).select("p16", F.col("country").alias("whole_country"))
    ends = flat.where(~is_whole).select(
        F.explode(F.sequence(F.shiftright("lo", 8), F.shiftright("hi", 8))).alias("p24"),
        "lo",
        "hi",
        F.col("country").alias("end_country"),
    )
    return Lookup(whole, sizes["whole"]), Lookup(ends, sizes["ends"])


def geo_enrich_ranges(
    df: DataFrame,
    ranges: DataFrame | tuple[Lookup, Lookup],
    limit_bytes: int | None = BROADCAST_BYTES,
) -> DataFrame:
    """Add country by address range: ``start <= ip_long <= end``; ``-`` if unknown.

    Of overlapping and nested ranges the narrowest counts; no row is multiplied. Whole
    blocks match by equality; other pieces are cut again at /24 borders and match by
    equality plus a check of the bounds. So both joins are equi joins and a row meets at
    most 256 candidates however the addresses cluster.
    """
    whole, ends = range_lookup(ranges)
    keyed = df.withColumns(
        {"p16": F.shiftright("ip_long", 16), "p24": F.shiftright("ip_long", 8)}
    ).alias("t")
    end = ends.hinted(limit_bytes).alias("e")
    in_end = (F.col("t.p24") == F.col("e.p24")) & F.col("t.ip_long").between(
        F.col("e.lo"), F.col("e.hi")
    )
    return (
        keyed.join(end, in_end, "left")
        .drop(F.col("e.p24"), F.col("t.p24"), F.col("e.lo"), F.col("e.hi"))
        .join(whole.hinted(limit_bytes), "p16", "left")
        .withColumn("country", F.coalesce("end_country", "whole_country", F.lit(UNKNOWN_PLACE)))
        .drop("p16", "end_country", "whole_country")
    )


def reputation_lookup(reputation: DataFrame | Lookup) -> Lookup:
    """One row per address: the highest of several scores."""
    if isinstance(reputation, Lookup):
        return reputation
    return store_lookup(reputation.groupBy("ip").agg(F.max("score").alias("score")), "reputation")


def reputation_enrich(
    df: DataFrame, reputation: DataFrame | Lookup, limit_bytes: int | None = BROADCAST_BYTES
) -> DataFrame:
    """Add the abuse score by address, the highest of several; null if the address has none."""
    return df.join(reputation_lookup(reputation).hinted(limit_bytes), "ip", "left")


def _known(indicators: DataFrame, kind: str) -> Lookup:
    wanted = (F.col("kind") == kind) & (F.col("value") != "")
    return store_lookup(indicators.where(wanted).select(F.lower("value").alias(kind)).distinct(), kind)


def match_hashes(
    df: DataFrame,
    indicators: DataFrame,
    key: str = "doc_id",
    content: str = "content",
    limit_bytes: int | None = BROADCAST_BYTES,
    max_bytes: int = MAX_SCAN_BYTES,
) -> DataFrame:
    """Keys of content whose SHA-256 is a known-bad hash: (key, sha256).

    Content is reduced to its hash before the join, so it is never shuffled. Content of
    more than ``max_bytes`` is not scanned; ``unscanned`` with the same limit lists it.
    """
    # Coalesce makes the key not nullable. Otherwise the join adds a null check
    # of the hash at the scan, and all content is hashed twice.
    hashes = df.where(F.octet_length(content) <= max_bytes).select(
        key, F.coalesce(F.sha2(content, 256), F.lit("")).alias("sha256")
    )
    known = _known(indicators, "sha256").hinted(limit_bytes)
    return hashes.join(known, "sha256", "left_semi").select(key, "sha256")


def oversize(
    df: DataFrame, key: str = "doc_id", content: str = "content", max_bytes: int = MAX_SCAN_BYTES
) -> DataFrame:
    """Content the hash match refuses: (key, n_bytes)."""
    n_bytes = F.octet_length(content)
    return df.where(n_bytes > max_bytes).select(key, n_bytes.cast("bigint").alias("n_bytes"))


def unscanned(
    df: DataFrame, key: str = "doc_id", content: str = "content", max_bytes: int = MAX_SCAN_BYTES
) -> DataFrame:
    """All content the hash match did not look at: (key, n_bytes, reason), ``oversize`` or
    ``missing``; with the rows it hashed, this is every row once."""
    n_bytes = F.octet_length(content)
    return df.where(n_bytes.isNull() | (n_bytes > max_bytes)).select(
        key,
        n_bytes.cast("bigint").alias("n_bytes"),
        F.when(n_bytes.isNull(), "missing").otherwise("oversize").alias("reason"),
    )


def match_hosts(
    df: DataFrame,
    indicators: DataFrame,
    key: str = "page_id",
    url: str = "url",
    limit_bytes: int | None = BROADCAST_BYTES,
) -> DataFrame:
    """Keys of URLs whose host is known bad: (key, host)."""
    hosts = df.select(key, F.coalesce(url_host(F.col(url)), F.lit("")).alias("host"))
    return hosts.join(_known(indicators, "host").hinted(limit_bytes), "host", "left_semi").select(
        key, "host"
    )


def match_urls(
    df: DataFrame,
    indicators: DataFrame,
    key: str = "page_id",
    url: str = "url",
    limit_bytes: int | None = BROADCAST_BYTES,
) -> DataFrame:
    """Keys of URLs under a known-bad one: (key, matched), the longest known prefix.

    An indicator of kind ``url`` is a host, or a host with the beginning of a path, or a
    whole URL with its query; it covers what it is a prefix of, part by part, after both
    sides were brought to one form (``url_parts``). Each row is returned at most once,
    repeated rows as often as they are there; null and URLs without host match nothing.

    Hosts without indicators are dropped at the scan by a filter of fixed size. Distinct
    URLs of the others are cut at their borders, no deeper than the deepest indicator, and
    meet the indicators by equality; what they found is a lookup for all rows.
    """
    parts = url_parts(F.col("value"))
    known, totals = store_measured(
        indicators.where((F.col("kind") == "url") & parts.isNotNull())
        .select(
            F.element_at(parts, 1).alias("host"),
            F.size(parts).alias("depth"),
            F.array_join(parts, "/").alias("matched"),
        )
        .distinct(),
        "urls",
        deepest=F.max("depth"),
        n_bytes=F.sum(F.octet_length("matched") + 8),
    )
    may_match = key_filter(known, "host")
    cut = (
        df.select(url)
        .withColumn("parts", url_parts(F.col(url)))
        .where(may_match(F.element_at("parts", 1)))
        .distinct()
        .select(
            url,
            "parts",
            F.explode(
                F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(max(totals["deepest"], 1))))
            ).alias("depth"),
        )
        .select(url, "depth", url_prefix(F.col("parts"), F.col("depth")).alias("matched"))
    )
    keys = Lookup(known.select("matched", "depth"), totals["n_bytes"]).hinted(limit_bytes)
    longest = (
        cut.join(keys, ["matched", "depth"])
        .groupBy(url)
        .agg(F.max_by("matched", "depth").alias("matched"))
    )
    found = store_lookup(longest, "url-matches").hinted(limit_bytes)
    return df.select(key, url).join(found, url).select(key, "matched")

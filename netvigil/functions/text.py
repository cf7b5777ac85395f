"""Parsing and formatting of the text forms used in captures and on screen.

Malformed input gives null; nothing here raises under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIZE = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]+)\s*$"
_IPV4 = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"
_TIME_OF_DAY = r"^[0-9]{2}:[0-9]{2}:[0-9]{2}$"


def parse_size(text: Column) -> Column:
    """Bytes of a size such as ``1.2 KB`` (1 KB = 1024 bytes, rounded); decimal, so exact."""
    number = F.regexp_extract(text, _SIZE, 1).try_cast("decimal(24,6)")
    unit = F.upper(F.regexp_extract(text, _SIZE, 2))
    # A constant map looks the unit up once; nested conditions would extract it for each.
    factors = F.create_map(
        *[
            part
            for power, name in enumerate(("B", "KB", "MB", "GB", "TB"))
            for part in (F.lit(name), F.lit(1024**power).cast("decimal(13,0)"))
        ]
    )
    return F.round(number * F.try_element_at(factors, unit)).try_cast("bigint")


def format_size(size_bytes: Column) -> Column:
    """Size text that ``parse_size`` reads: whole bytes below 1 KB, else KB with one decimal."""
    kilobytes = F.round(size_bytes / F.lit(1024.0), 1)
    return F.when(size_bytes < 1024, F.concat(size_bytes.cast("string"), F.lit(" B"))).otherwise(
        F.concat(kilobytes.cast("string"), F.lit(" KB"))
    )


def format_count(n: Column) -> Column:
    """Compact count: ``2.4M``. The step up happens where rounding would show 1000.0."""
    text = n.cast("string")
    for scale, suffix, least in ((1e3, "K", 1_000), (1e6, "M", 999_950), (1e9, "B", 999_950_000)):
        text = F.when(
            n >= least, F.format_string(f"%.1f{suffix}", F.round(n / F.lit(scale), 1))
        ).otherwise(text)
    return text


def format_delta(change: Column, pct: bool = False) -> Column:
    """Signed change: ``+5``, ``-8``; with ``pct`` one decimal and a sign, ``+12.5%``."""
    if pct:
        return F.when(
            change.isNotNull(),
            F.format_string("%+.1f%%", F.round(change.cast("double"), 1) + F.lit(0.0)),
        )
    return F.when(change.isNotNull(), F.format_string("%+d", change.cast("bigint")))


def age_text(ts: Column, as_of: Column) -> Column:
    """Age in whole minutes: ``2m ago``."""
    return F.concat(F.timestamp_diff("MINUTE", ts, as_of).cast("string"), F.lit("m ago"))


def parse_ts(text: Column, date: str | None = None) -> Column:
    """Timestamp of ``yyyy-MM-dd HH:mm:ss``, or of ``HH:mm:ss`` on the capture ``date``."""
    full = text
    if date is not None:
        full = F.when(
            text.rlike(_TIME_OF_DAY), F.concat(F.lit(f"{date} "), text)
        ).otherwise(text)
    return F.try_to_timestamp(full, F.lit("yyyy-MM-dd HH:mm:ss"))


def ip_to_long(ip: Column) -> Column:
    """Number of a dotted IPv4 address; null if an octet is missing or above 255."""
    octets = [F.regexp_extract(ip, _IPV4, i).try_cast("bigint") for i in range(1, 5)]
    valid = octets[0] <= 255
    for octet in octets[1:]:
        valid = valid & (octet <= 255)
    value = octets[0]
    for octet in octets[1:]:
        value = value * 256 + octet
    return F.when(valid, value)


def long_to_ip(value: Column) -> Column:
    """Dotted IPv4 text of an address number."""
    octets = [F.shiftright(value, shift).bitwiseAND(F.lit(255)) for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *[o.cast("string") for o in octets])


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, without user or port; null if it cannot be parsed."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def url_parts(url: Column) -> Column:
    """A URL as it is compared, in parts: host, segments of the path, ``?`` with the query.

    The host is lower-cased and loses user, the ports 80 and 443 and a closing dot. Empty
    segments and ``.`` go, ``..`` takes the segment before it along; case and percent
    signs of the path stay. A fragment never counts, an empty query neither. The scheme
    may be missing. Null if there is no host.
    """
    bare = F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://|#(?s:.*)$", "")
    cut = F.regexp_instr(bare, F.lit("[?]"))
    before = F.when(cut > 0, F.substring(bare, F.lit(1), cut - 1)).otherwise(bare)
    query = F.when(cut > 0, F.substring(bare, cut, F.length(bare))).otherwise(F.lit("?"))
    pieces = F.split(before, "/")
    host = F.regexp_replace(F.lower(pieces[0]), "^.*@|:(?:80|443)?$", "")
    host = F.regexp_replace(host, "[.]$", "")
    plain = F.filter(
        F.slice(pieces, F.lit(2), F.size(pieces)), lambda part: (part != "") & (part != ".")
    )

    def step(done: Column, part: Column) -> Column:
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", shorter).otherwise(F.array_append(done, part))

    path = F.when(
        F.array_contains(plain, ".."), F.aggregate(plain, F.array().cast("array<string>"), step)
    ).otherwise(plain)
    last = F.when(query == "?", F.array().cast("array<string>")).otherwise(F.array(query))
    return F.when(host != "", F.concat(F.array(host), path, last))


def url_prefix(parts: Column, depth: Column) -> Column:
    """The first ``depth`` parts of a URL as one text."""
    return F.array_join(F.slice(parts, F.lit(1), depth), "/")

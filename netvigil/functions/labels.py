"""Enumerations and the labels derived from them."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# The enumerations, option lists and label texts users see.
STATUSES = ("normal", "suspicious", "malicious")
ACTIONS = ("allowed", "blocked")
PROTOCOL_CHOICES = ("all", "http/https", "ssh", "ftp", "dns")
STATUS_CHOICES = ("all", "normal", "suspicious", "malicious")
FAMILY_MEMBERS = {
    "HTTP/HTTPS": ("HTTP", "HTTPS"),
    "SSH": ("SSH",),
    "FTP": ("FTP",),
    "DNS": ("DNS",),
}
OTHER_FAMILY = "Other"
# End of fixed values.


def classify(status: Column) -> Column:
    """Classification label; an unknown status keeps its name, in upper case."""
    return F.upper(status)


def severity_rank(value: Column) -> Column:
    """Order of a packet status or firewall action; unknown values rank -1."""
    return (
        F.when(value.isin("normal", "allowed"), F.lit(0))
        .when(value.isin("suspicious", "blocked"), F.lit(1))
        .when(value == "malicious", F.lit(2))
        .otherwise(F.lit(-1))
    )


def protocol_family(protocol: Column) -> Column:
    """Protocol group shown in the share chart; case does not matter."""
    families = F.create_map(
        *[
            F.lit(part)
            for label, members in FAMILY_MEMBERS.items()
            for member in members
            for part in (member, label)
        ]
    )
    return F.coalesce(F.try_element_at(families, F.upper(protocol)), F.lit(OTHER_FAMILY))


def family_spellings(family: str) -> list[str]:
    """Every upper/lower-case spelling of a family's protocols.

    An ``IN`` list over the bare column reaches the Parquet reader, which
    ``upper(protocol)`` would not.
    """
    return [
        "".join(letters)
        for member in FAMILY_MEMBERS[family]
        for letters in product(*({c.lower(), c.upper()} for c in member))
    ]


def risk_label(attempts: Column, critical_min: int = 250, high_min: int = 100) -> Column:
    """Risk band of an attempt count (thresholds are a design decision)."""
    return (
        F.when(attempts >= critical_min, "CRITICAL")
        .when(attempts >= high_min, "HIGH")
        .otherwise("LOW")
    )


def status_weight(status: Column) -> Column:
    """Weight of a packet in the threat score."""
    return (
        F.when(status == "malicious", F.lit(1.0))
        .when(status == "suspicious", F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


def threat_band(score: Column, critical_min: float = 70.0, high_min: float = 40.0) -> Column:
    """Band of a 0-100 threat score."""
    return (
        F.when(score >= critical_min, "CRITICAL").when(score >= high_min, "HIGH").otherwise("LOW")
    )


def alert_severity(status: Column) -> Column:
    """Alert severity of a packet that is not normal."""
    return F.when(status == "malicious", "critical").otherwise("high")

"""Column defaults and column choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What stands in for a missing field, and the columns shown.
PACKET_DEFAULTS = {"ip": "-", "port": "-", "protocol": "-", "size": "-", "status": "normal", "time": "-"}
FIREWALL_DEFAULTS = {"ip": "-", "port": "-", "action": "allowed", "rule": "-", "time": "-"}
FIREWALL_VIEW = ("ip", "port", "action", "rule", "ts")
PACKET_VIEW = ("ip", "port", "protocol", "size_bytes", "status", "ts")
# End of fixed values.


def fill_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Put the default where a value is null or its column is missing.

    An empty string is a value and stays. A default is only put into a text
    column: a typed column (a parsed port or time) keeps its null.
    """
    types = dict(df.dtypes)
    present = {c: v for c, v in defaults.items() if types.get(c) == "string"}
    filled = df.na.fill(present) if present else df
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in types}
    return filled.withColumns(missing) if missing else filled


def activity_view(df: DataFrame, columns: tuple[str, ...] = FIREWALL_VIEW) -> DataFrame:
    """The columns a table shows: the firewall log hides its severity."""
    return df.select(*columns)

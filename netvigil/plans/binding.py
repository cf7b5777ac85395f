"""Telemetry tables derived from the driver's test tables.

The cut-offs and mappings below exist only to exercise the operators. Address
number 167772160 is 10.0.0.0; user n of ``events`` and customer n share an
address, so the customer table places and rates the addresses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.functions.text import url_host
from netvigil.streaming.operators import alert_rows

# Given schemas save the job that would infer them from the files.
_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "documents": "doc_id bigint, text string, lang string, source string",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# An index into a constant array evaluates the expression once; CASE would once per branch.
_KIND = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 6"
_PROTOCOL = f"array('HTTPS', 'HTTP', 'SSH', 'FTP', 'DNS', 'MySQL')[{_KIND}]"
_PORT = f"array(443, 80, 22, 21, 53, 3306)[{_KIND}]"
_STATUS = (
    "CASE WHEN value < 90 THEN 'normal' WHEN value < 150 THEN 'suspicious' ELSE 'malicious' END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _ip(number: str) -> str:
    octets = ", ".join(
        f"string(shiftright(167772160L + {number}, {shift}) & 255)" for shift in (24, 16, 8, 0)
    )
    return f"concat_ws('.', {octets}) AS ip"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files; times get a zone, which watermarks ask for."""
    # A stream takes a plain path for a folder; a pattern may also name a file.
    path = f"{sf_dir}/events.parque[t]"
    return as_stream_rows(spark.readStream.schema(_SCHEMAS["events"]).parquet(path))


def packets(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events") if events is None else events
    return events.selectExpr(
        "event_id AS packet_id",
        "ts",
        "event_type",
        _ip("user_id"),
        "167772160L + user_id AS ip_long",
        f"{_PORT} AS port",
        f"{_PROTOCOL} AS protocol",
        "CAST(round(value * 100) AS BIGINT) AS size_bytes",
        f"{_STATUS} AS status",
    )


def firewall(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One log row per packet; packets of ``error`` events were blocked."""
    return packets(spark, sf_dir, events).selectExpr(
        "packet_id AS log_id",
        "ts",
        "event_type",
        "ip",
        "port",
        "protocol",
        "CASE WHEN event_type = 'error' THEN 'blocked' ELSE 'allowed' END AS action",
        "concat(upper(protocol), CASE WHEN event_type = 'error' THEN '-BLOCK' ELSE '-ALLOW' END)"
        " AS rule",
        "CASE WHEN event_type = 'error' THEN 'high' ELSE 'low' END AS severity",
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_rows(packets(spark, sf_dir))


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.expr("c_nationkey = n_nationkey"))
        .join(region, F.expr("n_regionkey = r_regionkey"))
        .selectExpr(_ip("c_custkey"), "n_name AS country", "r_name AS region")
    )


def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation i owns 60 addresses in a row."""
    return table(spark, sf_dir, "nation").selectExpr(
        "167772160L + n_nationkey * 60 AS start",
        "167772160L + n_nationkey * 60 + 59 AS end",
        "n_name AS country",
    )


def nested_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region owns 500 addresses, each of its nations 30 in the middle of them, and the
    nation whose number divides by 5 the lower half of these under its lower-cased name."""
    owners = table(spark, sf_dir, "region").selectExpr(
        "167772160L + r_regionkey * 500 AS start", "167772160L + r_regionkey * 500 + 449 AS end",
        "r_name AS country",
    )
    nation = table(spark, sf_dir, "nation").withColumn(
        "at", F.expr("167772160L + n_regionkey * 500 + (n_nationkey % 13) * 30")
    )
    parts = nation.selectExpr("at AS start", "at + 29 AS end", "n_name AS country")
    halves = nation.where("n_nationkey % 5 = 0").selectExpr(
        "at AS start", "at + 14 AS end", "lower(n_name) AS country"
    )
    return owners.unionByName(parts).unionByName(halves)


def geo_of_debtors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of customers in debt, each under its nation's name and under a later one."""
    debtors = geo(spark, sf_dir).join(reputation(spark, sf_dir).select("ip"), "ip", "left_semi")
    return debtors.unionByName(debtors.withColumn("country", F.lit("later")))


def reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt have bad addresses: the score is the debt, in tens."""
    return (
        table(spark, sf_dir, "customer")
        .where("c_acctbal < 0")
        .selectExpr(_ip("c_custkey"), "round(-c_acctbal / 10) AS score")
    )


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-bad hashes: texts labelled toxic. Known-bad hosts: hosts with a page that says free."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    bad_texts = (
        table(spark, sf_dir, "documents")
        .join(toxic, "doc_id", "left_semi")
        .select(F.lit("sha256").alias("kind"), F.sha2("text", 256).alias("value"))
    )
    bad_hosts = (
        table(spark, sf_dir, "pages")
        .where("contains(html, 'free')")
        .select(F.lit("host").alias("kind"), url_host(F.col("url")).alias("value"))
    )
    return bad_texts.unionByName(bad_hosts).distinct()


def url_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-bad URLs: of pages that say "free" the first segment of the path, of every second
    page the whole URL, written otherwise; and every host of adult pages."""
    pages = table(spark, sf_dir, "pages").withColumn("host", url_host(F.col("url")))
    folder = F.regexp_extract("url", "^([a-z]+://[^/?#]+/[^/?#]*)", 1)
    shouted = F.concat(F.lit("HTTP://user@"), F.upper("host"), F.lit(":80/./"))
    whole = F.concat(shouted, F.regexp_replace("url", "^[a-z]+://[^/]+/", "/"))
    free, adult = F.contains("html", F.lit("free")), F.contains("host", F.lit("adult"))
    values = (
        pages.where(free).select(folder.alias("value"))
        .unionByName(pages.where(F.col("page_id") % 2 == 0).select(whole.alias("value")))
        .unionByName(pages.where(adult).select(F.col("host").alias("value")))
    )
    return values.distinct().select(F.lit("url").alias("kind"), "value")


def as_stream_rows(df: DataFrame) -> DataFrame:
    """``ts`` as TIMESTAMP: streams refuse a time without zone."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))

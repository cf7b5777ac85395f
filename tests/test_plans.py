"""The physical plans: what is pushed down, shuffled, reused and broadcast."""

import re

import pytest
from fixtures import traffic
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from netvigil.operators import aggregates, correlate, enrich, filters, lookup, trends
from netvigil.session import work_path
from netvigil.sources.export import export, with_date
from netvigil.sources.readers import ingest_logs, read_packets

QUERIES = entry_module.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def stored(spark):
    """Packets laid out by date, three days of them."""
    rows = [
        (f"10.0.0.{i % 50}", ("HTTPS", "SSH", "DNS")[i % 3], ("normal", "malicious")[i % 2], i * 86)
        for i in range(3000)
    ]
    path = work_path(spark, "plans")
    export(with_date(traffic(spark, rows)), path, partition_by="date")
    return read_packets(spark, path)


@pytest.fixture(scope="module")
def geo(spark):
    return spark.range(50).select(
        F.concat(F.lit("10.0.0."), "id").alias("ip"),
        F.lit("RU").alias("country"),
        F.lit("EAST").alias("region"),
    )


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_and_no_nested_loops(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Python" not in text and "InPandas" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "CartesianProduct" not in text


def test_filters_reach_the_scan(stored):
    text = plan(filters.filter_packets(stored, "ssh", "malicious").select("ip"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "EqualTo(status,malicious)" in pushed
    assert "In(protocol" in pushed
    assert "ReadSchema: struct<ip:string,protocol:string,status:string>" in text


def test_time_filter_prunes_dates(spark, stored):
    recent = filters.last_window(stored, "2026-04-13 10:00:00").select("ip")
    text = plan(recent)
    partition_filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", text).group(1)
    # A day more on either side: the folders may have been named in another zone.
    assert "2026-04-12" in partition_filters and "2026-04-14" in partition_filters
    assert "GreaterThan(ts" in text

    newest = filters.last_window(stored).select("ip")
    newest.collect()
    partition_filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(newest)).group(1)
    assert "date" in partition_filters and "subquery" in partition_filters.lower()
    assert newest.count() == filters.last_window(stored.drop("date")).count()


def test_top_malicious_joins_after_the_top_k(stored, geo):
    text = final_plan(aggregates.top_malicious(stored, geo))
    assert "TakeOrderedAndProject" in text
    assert "partial_count" in text
    assert "ReusedExchange" in text
    assert "SortMergeJoin" not in text
    # One scan of the packets.
    assert text.count("FileScan parquet") == 1


def test_top_blocked_scans_once(spark, stored):
    log = stored.select("ip", F.col("protocol").alias("rule"), F.lit("blocked").alias("action"))
    text = final_plan(aggregates.top_blocked(log))
    assert "TakeOrderedAndProject" in text
    assert text.count("FileScan parquet") == 1


@pytest.mark.parametrize("trend", [trends.traffic_5m, trends.hourly_delta])
def test_gap_filling_scans_once_and_has_no_window(stored, trend):
    text = final_plan(trend(stored))
    assert text.count("FileScan parquet") == 1
    assert "Window [" not in text
    assert "Join" not in text


def test_correlation_reuses_the_partitioning_of_its_distincts(spark, stored):
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        log = stored.select("ip", "protocol", F.lit("blocked").alias("action"))
        text = final_plan(correlate.never_blocked(stored, log))
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftAnti" in text
    # One shuffle per side, after the map-side distinct.
    assert text.count("Exchange hashpartitioning") == 2


def test_range_lookup_is_an_equi_join_either_way(spark, stored):
    ranges = spark.createDataFrame(
        [(167772160, 167772199, "RU"), (167837696, 167968767, "CN")], "start bigint, end bigint, country string"
    )
    from netvigil.functions.text import ip_to_long

    p = stored.withColumn("ip_long", ip_to_long(F.col("ip")))
    small = plan(enrich.geo_enrich_ranges(p, ranges))
    assert small.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = plan(enrich.geo_enrich_ranges(p, ranges, limit_bytes=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in large
    assert "BroadcastNestedLoopJoin" not in large


def test_lookup_reads_the_order_columns_then_one_row(stored):
    row = lookup.lookup_or_first(stored.drop("date"), 12)
    row.collect()
    text = plan(row)  # whole: the subquery's plan stands inside
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
    wide = [s for s in schemas if "status" in s]
    narrow = [s for s in schemas if "status" not in s]
    assert wide and narrow
    assert all("ip:" not in s for s in narrow)


def test_hash_match_never_shuffles_content(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("content"))
    ind = docs.select(F.lit("sha256").alias("kind"), F.sha2("content", 256).alias("value"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(enrich.match_hashes(docs, ind, limit_bytes=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text
    for line in text.splitlines():
        if "Exchange" in line:
            assert "content" not in line


def test_content_is_hashed_once(spark, sf_dir):
    from netvigil.plans import binding

    docs = binding.table(spark, sf_dir, "documents")
    ind = spark.createDataFrame([("sha256", "x")], "kind string, value string")
    assert plan(enrich.match_hashes(docs, ind, "doc_id", "text")).count("sha2(") == 1
    pages = binding.table(spark, sf_dir, "pages")
    assert plan(enrich.match_hosts(pages, ind)).count("ParseUrlEvaluator") == 1


def test_log_lines_are_parsed_once(spark):
    path = work_path(spark, "once")
    export(spark.createDataFrame([("{}",)], "value string"), path, "text")
    for part in ingest_logs(spark, path):
        text = "\n".join(line for line in plan(part).splitlines() if "FileScan" not in line)
        assert text.count("from_json(") == 1
        assert text.count("gettimestamp(") <= 1

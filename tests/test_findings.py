"""Cases in which rows were once lost, doubled or counted wrongly."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from netvigil.operators import aggregates, enrich, filters, lookup, trends
from netvigil.sources.readers import ingest_logs

GOOD = ['{"ip":"1.1.1.1","port":"22"}', '{"ip":"a","extra":{"x":[1]}}']
BAD = [
    '{"ip":"a"}{"ip":"b"}', '{"ip":"1.1.1.1","port":"22"} trailing junk', "{}", '{"foo":1}',
    '{"ip":"a"},{"ip":"b"}', '[{"ip":"a"}]', '{"ip":"a"}}', '{"ip":"a"}]', "null", '"text"',
    '{"ip":"a"},"netvigil_line_end":"1"}{"x":"y"',
]


def test_no_log_line_vanishes(spark, tmp_path):
    (tmp_path / "log.txt").write_text("\n".join([*GOOD, *BAD, "", "  "]))
    good, bad = ingest_logs(spark, str(tmp_path))
    assert sorted(r.line for r in bad.collect()) == sorted(BAD)
    assert sorted(r.ip for r in good.collect()) == ["1.1.1.1", "a"]


def test_quarantine_tells_files_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part-0.txt").write_text("junk")
    _, bad = ingest_logs(spark, f"{tmp_path}/*")
    assert len({r.source_file for r in bad.collect()}) == 2


def test_window_outside_utc(spark):
    rows = [(datetime(2026, 4, 12, 0, 30), "2026-04-12"), (datetime(2026, 4, 12, 0, 50), "2026-04-12")]
    df = spark.createDataFrame(rows, "ts timestamp, date string").withColumn(
        "date", F.to_date("date")
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        newest = df.agg(F.max("ts")).first()[0]
        shown = F.lit(newest)
        assert filters.last_window(df, shown).count() == filters.last_window(
            df.drop("date"), shown
        ).count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_cards_stop_at_the_time_asked_for(spark):
    rows = [("a", "suspicious", datetime(2026, 4, 12, h, 30)) for h in range(5)]
    df = spark.createDataFrame(rows, "ip string, status string, ts timestamp")
    cards = aggregates.kpi_cards(df, "2026-04-12 02:00:00")
    assert {r.label: r.value for r in cards.collect()}["Packets Analyzed"] == "2"


def test_segments_follow_counts(spark):
    df = spark.createDataFrame([("A", 500_000), ("B", 500_001)], "family string, n long")
    assert [r.family for r in trends.cumulative_share(df).orderBy("start").collect()] == ["B", "A"]
    thirds = spark.createDataFrame([(f, 1) for f in "ABC"], "family string, n long")
    assert max(r.end for r in trends.cumulative_share(thirds).collect()) == 1.0


@pytest.mark.parametrize("key", [7, None])
def test_first_row_without_key(spark, key):
    rows = [(None, datetime(2026, 1, 1), "first"), (3, datetime(2026, 1, 2), "second")]
    df = spark.createDataFrame(rows, "packet_id long, ts timestamp, ip string")
    assert [r.ip for r in lookup.lookup_or_first(df, key).collect()] == ["first"]
    assert [r.ip for r in lookup.lookup_or_first(df, 3).collect()] == ["second"]


def test_snippet_holds_the_term(spark):
    df = spark.createDataFrame([(1, "\u0130" * 6 + " abc License xyz"), (2, "none")], "id int, text string")
    found = lookup.search({"t": (df, ["id"], ["text"])}, "license", 4).collect()
    assert [(r.key, r.snippet) for r in found] == [("1", "abc License xyz")]
    twice = spark.createDataFrame([(1, "a.c a.c"), (2, "abc")], "id int, text string")
    found = lookup.search({"t": (twice, ["id"], ["text"])}, "A.C", 2).collect()
    assert [(r.key, r.snippet) for r in found] == [("1", "a.c a")]


def test_lookups_do_not_multiply_rows(spark):
    df = spark.createDataFrame([("a",), ("b",)], "ip string")
    geo = spark.createDataFrame(
        [("a", "X", "2"), ("a", "W", "1")], "ip string, country string, region string"
    )
    placed = enrich.geo_enrich(df, geo).collect()
    assert sorted((r.ip, r.country, r.region) for r in placed) == [("a", "W", "1"), ("b", "-", "-")]
    scores = spark.createDataFrame([("a", 3), ("a", 9)], "ip string, score int")
    rated = enrich.reputation_enrich(df, scores).collect()
    assert sorted((r.ip, r.score) for r in rated) == [("a", 9), ("b", None)]

"""Search through postings equals the scan; uploads count once, whatever happens to them."""

import random

import pytest
from pyspark.sql import functions as F

from netvigil.operators.lookup import search
from netvigil.operators.postings import RUN_BYTES, SearchIndex, _folded, _postings_of, row_key, trigrams
from netvigil.sources.ledger import LogLedger


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = ["alpha", "BETA", "gamma", "Straße", "é", "İstanbul", "a.b", "x\\Ey", ""]
    data = [(i, " ".join(rng.choices(words, k=rng.randrange(6))), rng.choice(words)) for i in range(300)]
    data += [(300, None, None), (301, "needle in hay", None), (302, None, "NEEDLES")]
    return spark.createDataFrame(data, "id int, body string, title string").repartition(4)


def test_indexed_search_equals_the_scan(spark, texts, tmp_path):
    index = SearchIndex(spark, f"{tmp_path}/index")
    tables = {"notes": (texts, ["id"], ["body", "title"])}
    index.refresh("notes", *tables["notes"])
    for term in ("needle", "NEEDLE", "alpha beta", "straße", "a.b", "\\Ey", "absent", "é", "mma al"):
        assert rows(index.search(tables, term)) == rows(search(tables, term)), term
    # Too many candidates to broadcast: joined by shuffle.
    assert rows(index.search(tables, "gamma", most=0)) == rows(search(tables, "gamma"))
    assert {r["key"] for r in index.search(tables, "needle").collect()} == {"301", "302"}
    read = index.candidates("notes", "needle").count()
    assert read == 2  # of 303 rows


def test_index_parts_are_replaced(spark, texts, tmp_path):
    index = SearchIndex(spark, f"{tmp_path}/index")
    for part in (0, 1, 1):
        index.refresh("notes", texts.where(F.col("id") % 2 == part), ["id"], ["body", "title"], str(part))
    tables = {"notes": (texts, ["id"], ["body", "title"])}
    assert rows(index.search(tables, "beta")) == rows(search(tables, "beta"))
    index.refresh("notes", texts.where("id = 301"), ["id"], ["body", "title"], "1")
    assert {r["key"] for r in index.search(tables, "needle").collect()} == {"301", "302"}


def test_postings_of_runs_equal_the_trigrams_of_each_text(spark, texts):
    many = spark.range(5000).select(F.col("id").cast("int"), F.lit("same Words").alias("text"))
    long = spark.range(1).select(F.lit(-1).alias("id"), F.repeat(F.lit("aBc\u0130 "), 400).alias("text"))
    body = texts.select("id", F.concat_ws("\n", "body", "title").alias("text")).where("id < 303")
    df = body.withColumn("id", F.col("id") + 10000).unionByName(many).unionByName(long).coalesce(1)
    key, text = row_key(["id"]).alias("key"), F.col("text")
    want = df.select(key, F.explode(trigrams(text)).alias("gram"))
    rows = df.select(key, _folded(text).cast("binary").alias("text"))
    for run_bytes in (7, 1000, RUN_BYTES):
        postings = rows.mapInArrow(_postings_of(run_bytes), "gram string, keys array<bigint>")
        got = postings.select(F.explode("keys").alias("key"), "gram")
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}, run_bytes
    # A pair of trigram and text does not travel on its own.
    assert postings.count() * 20 < got.count()


def test_index_holds_few_rows_for_a_frequent_trigram(spark, tmp_path):
    index = SearchIndex(spark, f"{tmp_path}/index")
    same = spark.range(1000).select("id", F.lit("common").alias("body")).coalesce(1)
    index.refresh("notes", same, ["id"], ["body"])
    assert index._postings("notes").where("gram = 'com'").count() == 1
    assert index.candidates("notes", "common").count() == 1000


LINE = '{"ip":"10.0.0.%d","port":"22","action":"blocked","rule":"R","time":"2024-01-01 00:00:00","severity":"high"}\n'


def test_uploads_count_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    ledger = LogLedger(spark, f"{tmp_path}/root")

    def good():
        return sorted(int(r["ip"].split(".")[-1]) for r in ledger.records()[0].collect())

    (inbox / "a.json").write_text(LINE % 1 + LINE % 1 + "broken\n")
    assert ledger.ingest(str(inbox)) == 1 and good() == [1, 1]
    assert ledger.ingest(str(inbox)) == 0 and good() == [1, 1]
    # Another file that was half written, an empty one, and the first under a second name.
    (inbox / "b.json").write_text(LINE % 2 + (LINE % 3)[:20])
    (inbox / "c.json").write_text("")
    (inbox / "copy.json").write_text(LINE % 1 + LINE % 1 + "broken\n")
    assert ledger.ingest(str(inbox)) == 2 and good() == [1, 1, 2]
    assert sorted(r["line"] for r in ledger.records()[1].collect()) == ["broken", (LINE % 3)[:20]]
    (inbox / "b.json").write_text(LINE % 2 + LINE % 3)
    assert ledger.ingest(str(inbox)) == 1 and good() == [1, 1, 2, 3]
    assert [r["line"] for r in ledger.records()[1].collect()] == ["broken"]
    assert ledger.ingest(str(inbox)) == 0


def test_run_that_dies_leaves_nothing_to_see(spark, tmp_path, monkeypatch):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a name %20.json").write_text(LINE % 1)
    ledger = LogLedger(spark, f"{tmp_path}/root")

    def dies(where, batch):  # after the lines are written, before the files are entered
        raise RuntimeError("killed")

    monkeypatch.setattr(ledger, "_enter", dies)
    with pytest.raises(RuntimeError):
        ledger.ingest(str(inbox))
    again = LogLedger(spark, f"{tmp_path}/root")
    assert again.records()[0].count() == 0
    assert again.ingest(str(inbox)) == 1 and again.records()[0].count() == 1

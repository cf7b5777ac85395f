"""Components: links that come later, and graphs that take several rounds."""

import random

import numpy as np
from pyspark.sql import functions as F

from netvigil.llm.components import components, joined_components
from netvigil.llm.filters import Filter


def expected(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_links_that_come_later_give_the_components_of_all(spark):
    rng = random.Random(5)
    first = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)]
    first = [(a, b) for a, b in first if a != b]
    later = [(40, 150), (500, 7), (600, 601), (601, 599), (-3, 600)]

    def rows(df):
        got = [tuple(r) for r in df.select("node", "component").collect()]
        assert len(got) == len(dict(got))
        return dict(got)

    frame = lambda links: spark.createDataFrame(links, "a bigint, b bigint")
    of = components(frame(first))
    assert rows(of) == expected(first)
    assert rows(joined_components(of, frame(later))) == expected(first + later)
    none = components(frame(first[:0]))
    assert rows(none) == {}
    assert rows(joined_components(none, frame(later))) == expected(later)


def test_filter_is_made_by_few_jobs_whatever_the_partitions(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("key"))
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("filter", "filter")
    try:
        made = Filter(keys)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("filter")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 10
    hashes = np.array([r["key"] for r in keys.collect()], np.int64).view(np.uint64)
    assert made(hashes).all()
    assert not made(np.arange(1, 100, dtype=np.uint64)).any()

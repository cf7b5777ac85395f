"""Line dedup against levelled sorted runs of line keys.

Documents come in batches of ascending ``doc_id``. The keys seen so far lie in runs:
tables of (k1, k2, first) sorted by key hash, each key once over all runs, where ``first``
is the smallest document that holds it. A batch joins its keys against the runs; the keys
found there are old, the others are new and become a run of level 0. When a level holds
``fanout`` runs, they are merged into one run of the next level, so that a key is
rewritten once per level and a batch meets few runs.

A line goes if a smaller document holds its key; in the smallest one every line stays.
Keys are 128-bit hashes. The runs live in the shared folder; a batch is only added after
its run is written, so a lost job can be repeated.

Null text is one empty line. Documents without ``doc_id`` are one document, the last.
Rows that share a ``doc_id`` are parts of one document. An empty table gives no rows.
Other columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.llm.common import LOWER, UPPER, text_hash, text_or_empty
from netvigil.session import work_path

BLANK = " \t\n\x0b\f\r"
LAST = 2**63 - 1
ADDED = ("clean_text", "n_lines", "n_dropped")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2")]


def _owner() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("owner")


def batch_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2, owner, body, at): the key, document, text and place of every line that counts."""
    lines = docs.select(
        _owner(),
        text_hash().alias("body"),
        F.posexplode(F.split(text_or_empty(), "\n")).alias("at", "line"),
    )
    keys = lines.select("owner", "body", "at", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= min_chars).select(
        *_hashes(F.col("key")), "owner", "body", "at"
    )


@dataclass
class LineRuns:
    """The runs of all batches so far, level by level."""

    spark: SparkSession
    fanout: int = 4
    min_chars: int = 10
    levels: list[list[str]] = field(default_factory=list)

    def keys(self) -> DataFrame | None:
        paths = [path for level in self.levels for path in level]
        return self.spark.read.parquet(*paths) if paths else None

    def _write(self, keys: DataFrame) -> str:
        path = work_path(self.spark, "line-run")
        keys.sortWithinPartitions("k1", "k2").write.parquet(path)
        return path

    def add(self, docs: DataFrame) -> DataFrame:
        """Take in the next batch; returns (owner, body, at) of the lines it has to drop."""
        path = work_path(self.spark, "line-batch")
        batch_keys(docs, self.min_chars).write.parquet(path)
        batch = self.spark.read.parquet(path)
        first = batch.groupBy("k1", "k2").agg(F.min("owner").alias("first"))
        seen = self.keys()
        if seen is not None:
            old = seen.select("k1", "k2", F.col("first").alias("old"))
            first = first.join(old, ["k1", "k2"], "left")
        else:
            first = first.withColumn("old", F.lit(None).cast("long"))
        met = work_path(self.spark, "line-met")
        first.write.parquet(met)
        met_keys = self.spark.read.parquet(met)
        new = self._write(met_keys.where("old IS NULL").select("k1", "k2", "first"))
        self._push(new)
        known = met_keys.select("k1", "k2", F.coalesce("old", "first").alias("first"))
        return batch.join(known, ["k1", "k2"]).where("first < owner").select("owner", "body", "at")

    def _push(self, path: str) -> None:
        """Add a run to level 0, merging levels that have become full."""
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(path)
            if len(self.levels[level]) < self.fanout:
                return
            runs = self.spark.read.parquet(*self.levels[level])
            path = self._write(runs.repartition("k1", "k2"))
            self.levels[level] = []
            level += 1


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Ids at which batches of about equal size begin, but for the first."""
    cuts = [i / batches for i in range(1, batches)]
    if not cuts:
        return []
    found = docs.agg(F.percentile_approx(_owner(), cuts).alias("at")).first()["at"]
    return sorted(set(found or []))


def dedup_lines(
    docs: DataFrame, batches: int = 4, fanout: int = 3, min_chars: int = 10
) -> DataFrame:
    """``docs`` with ``clean_text``, ``n_lines`` and ``n_dropped``."""
    spark = docs.sparkSession
    columns = docs.columns
    runs = LineRuns(spark, fanout, min_chars)
    bounds = batch_bounds(docs, batches)
    owner = _owner()
    drops = None
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        batch = docs
        if low is not None:
            batch = batch.where(owner >= low)
        if high is not None:
            batch = batch.where(owner < high)
        found = runs.add(batch)
        drops = found if drops is None else drops.unionByName(found)
    # A text has no more dropped places than lines. Rows with one id and one text agree in them.
    places = drops.groupBy("owner", "body").agg(F.collect_set("at").alias("drop_at"))
    rows = docs.select(
        owner, text_hash().alias("body"), F.struct(*[F.col(c) for c in columns]).alias("row")
    )
    lines = F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop_at"))
    kept = F.when(F.col("drop_at").isNull(), F.col("lines")).otherwise(
        F.transform(stay, lambda i: F.get("lines", i))
    )
    return (
        rows.join(places, ["owner", "body"], "left")
        .withColumn("lines", lines)
        .withColumn("kept", kept)
        .select(
            *[F.col("row")[c].alias(c) for c in columns if c not in ADDED],
            F.array_join("kept", "\n").alias("clean_text"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        )
    )

"""Search at size: trigram postings name the few rows that can hold a term.

The index has a row per trigram and run of indexed text: the 64-bit hashes of the keys whose
text holds the trigram. A search takes the rarest trigrams of the term, intersects their postings
to candidate keys, reads only those rows, and looks for the term in their text, so its
results are those of ``lookup.search``. For a term without three ASCII characters in a row
there is no trigram to look up, and the tables are scanned.

Postings are kept per source and part of the table (for example a date), so that a part
that is added or replaced costs only itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.operators.lookup import search
from netvigil.operators.sizing import BROADCAST_BYTES

RUN_BYTES = 1 << 22  # of text that share rows of postings, a long text has several
USED = 4  # trigrams of a term that are looked up, the rarest ones
_POSTINGS = "gram string, keys array<bigint>, source string, part string"


def _folded(text: Column) -> Column:
    """Text in which letters that a case-insensitive search takes for a-z are a-z."""
    return F.lower(F.translate(text, "\u0131\u0130\u017f\u212a", "iisk"))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of ASCII characters in folded text. Others have cases that differ
    in length or number and are left to the comparison of the text."""
    chars = F.array(F.split(_folded(text), ""))

    def of(c: Column) -> Column:
        starts = F.when(F.size(c) > 2, F.sequence(F.lit(0), F.size(c) - 3))
        return F.transform(starts, lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)))

    # Over an array of one: the text is split once per row.
    grams = F.array_distinct(F.flatten(F.transform(chars, of)))
    return F.coalesce(F.filter(grams, lambda g: F.octet_length(g) == 3), F.array().cast("array<string>"))


def _postings_of(run_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, folded UTF-8 text) to (gram, keys): trigrams as ``trigrams`` has them, each key once
    per run of text."""
    row_bits = 11  # beside 21 of three ASCII characters, so that 32 bits are sorted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            text = batch.column("text").cast(pa.large_binary())
            _, borders, raw = text.buffers()
            edges = np.frombuffer(borders, np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(raw or b"", np.uint8)
            low, end = int(edges[0]), int(edges[-1])
            while low < end:
                first = int(np.searchsorted(edges, low, "right")) - 1
                stop = min(first + (1 << row_bits), len(text))
                high = min(low + run_bytes, int(edges[stop]))
                # Trigrams that begin in the run may end behind it, but not behind their text.
                here = data[low : min(high + 2, end)].astype(np.uint32)
                n = len(here) - 2
                if n > 0:
                    one, two, three = here[:n], here[1 : n + 1], here[2 : n + 2]
                    whole = (one | two | three) < 128
                    cuts = edges[first + 1 : stop + 1] - low
                    for back in (1, 2):
                        at = cuts - back
                        whole[at[(at >= 0) & (at < n)]] = False
                    inner = np.clip(edges[first : stop + 1] - low, 0, n)
                    row = np.repeat(np.arange(stop - first, dtype=np.uint32), np.diff(inner))
                    code = one << 14 | two << 7 | three
                    pairs = np.sort((code << row_bits | row)[whole])
                    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)]]
                    gram = pairs >> row_bits
                    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])[: len(gram)])
                    gram = gram[starts]
                    chars = np.stack([gram >> 14, gram >> 7 & 127, gram & 127], axis=1).astype(np.uint8)
                    ends = np.arange(len(gram) + 1, dtype=np.int32) * 3
                    lists = np.append(starts, len(pairs)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.StringArray.from_buffers(
                                len(gram), pa.py_buffer(ends.tobytes()), pa.py_buffer(chars.tobytes())
                            ),
                            pa.ListArray.from_arrays(
                                pa.array(lists), pa.array(keys[first + (pairs & ((1 << row_bits) - 1))])
                            ),
                        ],
                        ["gram", "keys"],
                    )
                low = high

    return run


def row_key(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


@dataclass(frozen=True)
class SearchIndex:
    """Postings of one or more tables at ``path``, in folders by source and part."""

    spark: SparkSession
    path: str

    def refresh(
        self, source: str, df: DataFrame, keys: list[str], columns: list[str], part: str = "all"
    ) -> None:
        """Index ``df`` as a part of ``source``; an earlier state of the part is replaced."""
        texts = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
        rows = df.select(row_key(keys).alias("key"), _folded(texts).cast("binary").alias("text"))
        (
            rows.mapInArrow(_postings_of(RUN_BYTES), "gram string, keys array<bigint>")
            .repartition("gram")
            .sortWithinPartitions("gram")
            .write.mode("overwrite")
            .parquet(f"{self.path}/source={source}/part={part}")
        )

    def _postings(self, source: str) -> DataFrame:
        self.spark.catalog.refreshByPath(self.path)
        rows = self.spark.read.schema(_POSTINGS).parquet(self.path)
        return rows.where(F.col("source") == source)

    def _grams_of(self, term: str) -> list[str]:
        return self.spark.range(1).select(trigrams(F.lit(term)).alias("grams")).first()["grams"]

    def candidates(self, source: str, term: str) -> DataFrame | None:
        """(key): hashes of the keys of rows that hold all looked-up trigrams of the term; None
        if it has none."""
        wanted = self._grams_of(term)
        if not wanted:
            return None
        rows = self._postings(source).where(F.col("gram").isin(wanted))
        sizes = rows.groupBy("gram").agg(F.sum(F.size("keys")).alias("n")).collect()
        if len(sizes) < len(wanted):  # a trigram that no row holds
            return self.spark.createDataFrame([], "key bigint")
        rarest = [r["gram"] for r in sorted(sizes, key=lambda r: (r["n"], r["gram"]))[:USED]]
        return (
            rows.where(F.col("gram").isin(rarest))
            .select("gram", F.explode("keys").alias("key"))
            .groupBy("key")
            .agg(F.count_distinct("gram").alias("found"))
            .where(F.col("found") == len(rarest))
            .select("key")
        )

    def search(
        self,
        tables: dict[str, tuple[DataFrame, list[str], list[str]]],
        term: str,
        context: int = 20,
        most: int = BROADCAST_BYTES // 8,
    ) -> DataFrame:
        """As ``lookup.search`` over indexed tables; at most ``most`` candidates are broadcast."""
        narrowed = {}
        for source, (df, keys, columns) in tables.items():
            found = self.candidates(source, term)
            if found is None:
                return search(tables, term, context)
            # The candidates are few rows of postings, counted before they are broadcast.
            listed = F.broadcast(found) if found.count() <= most else found
            rows = df.withColumn("_key", row_key(keys))
            narrowed[source] = (
                rows.join(listed.withColumnRenamed("key", "_key"), "_key", "left_semi"),
                keys,
                columns,
            )
        return search(narrowed, term, context)

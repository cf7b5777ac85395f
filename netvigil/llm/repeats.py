"""Removal of repeated byte strings by prefix-free parsing.

A string of ``WIDTH`` bytes is repeated if it also starts anywhere else. Texts are parsed
into phrases by a rolling hash over ``TRIGGER`` bytes: the trigger of a position is the
trigger string of least hash among those inside its ``WIDTH`` bytes, and a phrase is the
run of positions with the same trigger. As the choice looks at these bytes only, equal
strings have equal triggers at equal distances wherever they stand.

The *parse* of the corpus is its sequence of phrases, each read with the bytes that follow
(its context, up to ``WIDTH`` - 1); the *dictionary* has each distinct one once. Corpus
order is needed only as far as neighbours share ``WIDTH`` bytes, so it is resolved in three
steps, each of which leaves little for the next:

1. a trigger that occurs once in the corpus has no repeated string around it;
2. a phrase whose dictionary entry occurs twice is repeated at all its positions, and
   neither its bytes nor its positions are looked at;
3. other phrases are compared, per trigger, with the other dictionary entries of that
   trigger. Entries are aligned at the trigger, so that equal strings begin at equal
   distances before it, and the distances are cut into blocks. Strings of one block share
   some bytes (their *core*), and a piece of an entry has all bytes of its strings (its
   *whole*): a core met in one piece only has no repeated string, a whole met twice is
   repeated throughout, and only pieces of other cores are cut into the next smaller
   blocks (``BLOCKS``). Blocks of one distance have core and whole alike, which settles
   the rest. So a phrase met a million times is one entry, and an entry has a row per
   place only where its repeats begin and end.

All comparisons are counts by hash, whatever the number of a trigger's entries.
A filter of fixed size, made of the repeated triggers, keeps most unique phrases from
being shuffled; what it lets pass in error is dropped by the join after it.

Null text is empty. Matches never cross documents. Rows repeated in full are copies of
each other like any documents. An empty table gives no rows. Other columns are carried
along by ``removed`` unless they bear the names of the added ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.bytesets import Rolling, mix, signed, text_bytes
from netvigil.llm.filters import Filter
from netvigil.llm.common import ship, stored, text_hash

WIDTH = 200
TRIGGER = 32
BLOCKS = (64, 8, 1)  # distances before the trigger that are compared at once
CHUNK = 1 << 18
_PLACE = np.uint64(22)  # bits of a place in a chunk


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Phrases:
    """The phrases of some texts laid out one after another in ``data``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int):
        """``starts`` and ``ends`` are the texts' places in ``data``."""
        self.rolling = Rolling(data)
        self.width = width
        if len(data) < width:
            self.start = self.end = self.text = self.ahead = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        grams = mix(self.rolling.windows(TRIGGER))
        place = np.arange(len(grams), dtype=np.uint64)
        least = _sliding_least((grams >> _PLACE << _PLACE) | place, width - TRIGGER + 1)
        trigger = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
        n = len(trigger)  # places where width bytes begin
        good = np.zeros(n + 1, np.int8)  # those inside a text
        long = ends - starts >= width
        np.add.at(good, starts[long], 1)
        np.add.at(good, ends[long] - width + 1, -1)
        good = np.cumsum(good[:n]) > 0
        new = np.ones(n, bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (good[1:] != good[:-1])
        # Texts that touch may go on with good places: a text begins a phrase.
        new[starts[long]] = True
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], n)
        inside = good[begin]
        self.start, self.end = begin[inside], end[inside]
        self.text = np.searchsorted(starts, self.start, side="right") - 1
        self.ahead = trigger[self.start] - self.start  # how far the trigger lies ahead
        self.key = mix(grams[trigger[self.start]], 7)

    def entries(self) -> np.ndarray:
        """Hashes of the phrases with their contexts."""
        return mix(self.rolling.of(self.start, self.end + self.width - 1), 8)


def _chunks(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(data, starts, ends, row, offset): pieces of texts of about CHUNK bytes together.

    A longer text is cut into pieces that overlap, so that each of its strings lies in one.
    """
    pieces: list[tuple[bytes, int, int]] = []
    total = 0

    def pack():
        sizes = np.array([len(p) for p, _, _ in pieces], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(p for p, _, _ in pieces), np.uint8)
        rows = np.array([r for _, r, _ in pieces], np.int64)
        offsets = np.array([o for _, _, o in pieces], np.int64)
        return data, ends - sizes, ends, rows, offsets

    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - width + 1), CHUNK):
            piece = text[at : at + CHUNK + width - 1]
            if len(piece) < width:
                continue
            if total and total + len(piece) > 2 * CHUNK:
                yield pack()
                pieces, total = [], 0
            pieces.append((piece, row, at))
            total += len(piece)
    if pieces:
        yield pack()


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, text): ``doc`` stands for the id and text of a row."""
    return docs.select(F.xxhash64("doc_id", text_hash()).alias("doc"), "text")


def _repeated_triggers(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, starts, ends, _, _ in _chunks(text_bytes(batch.column("text")), width):
                key, n = np.unique(Phrases(data, starts, ends, width).key, return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(key), pa.array(n)], ["key", "n"])

    keys = docs.select("text").mapInArrow(run, "key bigint, n bigint")
    return stored(
        keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"),
        "repeats-triggers",
    )


def _parse(docs: DataFrame, triggers: DataFrame, width: int) -> DataFrame:
    """Stored (key, entry, doc, start, end): the phrases whose trigger is repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(Filter(triggers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            for data, starts, ends, row, offset in _chunks(
                text_bytes(batch.column("text")), width
            ):
                p = Phrases(data, starts, ends, width)
                keep = shared.value(p.key)
                text = p.text[keep]
                shift = offset[text] - starts[text]
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(p.key[keep]),
                        signed(p.entries()[keep]),
                        pa.array(doc[row[text]]),
                        pa.array(p.start[keep] + shift),
                        pa.array(p.end[keep] + shift),
                    ],
                    ["key", "entry", "doc", "start", "end"],
                )

    kinds = "key bigint, entry bigint, doc bigint, start bigint, end bigint"
    phrases = _keyed(docs).mapInArrow(run, kinds)
    return stored(phrases.join(triggers, "key", "left_semi"), "repeats-parse")


def _contexts(docs: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(key, entry, ahead, bytes): dictionary entries of the given triggers, as bytes, and some
    others that their filter lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(Filter(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, starts, ends, _, _ in _chunks(text_bytes(batch.column("text")), width):
                p = Phrases(data, starts, ends, width)
                keep = np.flatnonzero(shared.value(p.key))
                entry = p.entries()[keep]
                entry, first = np.unique(entry, return_index=True)
                keep = keep[first]
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(p.key[keep]),
                        signed(entry),
                        pa.array(p.ahead[keep]),
                        pa.array(
                            [raw[p.start[i] : p.end[i] + width - 1] for i in keep], pa.binary()
                        ),
                    ],
                    ["key", "entry", "ahead", "bytes"],
                )

    kinds = "key bigint, entry bigint, ahead bigint, bytes binary"
    found = docs.select("text").mapInArrow(run, kinds)
    return found.dropDuplicates(["key", "entry"])


def _with_ids(entries: DataFrame, label: str) -> DataFrame:
    """Stored with a number per row, which stays as the rows are stored."""
    return stored(entries.withColumn("id", F.monotonically_increasing_id()), label)


def _pieces(entries: DataFrame, block: int, width: int) -> DataFrame:
    """Stored pieces of (id, key, bytes, ahead, times, doc, start), cut at multiples of ``block``.

    A piece has the places whose distance to the trigger lies in one block, its ``cell``;
    ``core`` stands for its key, its cell and the bytes that any string of the cell has,
    ``whole`` for all its bytes and distances.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("bytes").to_pylist()
            sizes = np.array([len(x) for x in raw], np.int64)
            rolling = Rolling(np.frombuffer(b"".join(raw), np.uint8))
            places = sizes - width + 1
            row = np.repeat(np.arange(len(raw)), places)
            place = np.arange(len(row)) - (np.cumsum(places) - places)[row]
            ahead = batch.column("ahead").to_numpy()
            cell = (ahead[row] - place) // block
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(row)))
            row, place, cell = row[first], place[first], cell[first]
            begin = (np.cumsum(sizes) - sizes)[row]
            trigger = begin + ahead[row]
            common = rolling.of(trigger - cell * block, trigger - (cell + 1) * block + 1 + width)
            key = batch.column("key").to_numpy().view(np.uint64)[row]
            core = mix(mix(common, 9) ^ mix(key ^ mix(cell.view(np.uint64), 10), 11), 12)
            string = rolling.of(begin + place, begin + place + count + width - 1)
            shift = (ahead[row] - place).view(np.uint64)
            whole = mix(string ^ mix(shift ^ mix(count.view(np.uint64), 13), 14), 15)
            start = batch.column("start").to_numpy()[row] + place
            yield pa.RecordBatch.from_arrays(
                [
                    signed(core),
                    signed(whole),
                    pa.array(cell),
                    *[batch.column(c).take(pa.array(row)) for c in ("id", "times", "doc")],
                    pa.array(start),
                    pa.array(start + count),
                ],
                ["core", "whole", "cell", "id", "times", *SPAN],
            )

    names = ("core", "whole", "cell", "id", "times", *SPAN)
    rows = entries.select("id", "key", "bytes", "ahead", "times", "doc", "start")
    return stored(
        rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in names)), f"repeats-pieces-{block}"
    )


SPAN = ("doc", "start", "end")


def _cut(entries: DataFrame, cells: DataFrame, block: int, width: int) -> DataFrame:
    """The given (id, cell, core, times) of ``entries`` as entries of their own."""
    low = F.greatest(F.lit(0), F.col("ahead") - (F.col("cell") + 1) * block + 1)
    high = F.least(
        F.octet_length("bytes") - (width - 1), F.col("ahead") - F.col("cell") * block + 1
    )
    return (
        entries.drop("key", "times")
        .join(cells, "id")
        .withColumns({"low": low.cast("int"), "high": high.cast("int")})
        .select(
            F.col("core").alias("key"),
            F.expr(f"substring(bytes, low + 1, high - low + {width - 1})").alias("bytes"),
            (F.col("ahead") - F.col("low")).alias("ahead"),
            "times",
            "doc",
            (F.col("start") + F.col("low")).alias("start"),
        )
    )


def _compared(entries: DataFrame, width: int) -> DataFrame:
    """The spans of entries met once (``times`` = 1) that are repeated within other entries.

    Bytes stay in the entries; what is counted and joined by hash has numbers only.
    """
    spans = []
    for block in [b for b in BLOCKS if 3 * b <= width]:
        entries = _with_ids(entries, f"repeats-entries-{block}")
        pieces = _pieces(entries, block, width)
        wholes = stored(
            pieces.groupBy("core", "whole").agg(
                F.sum("times").alias("times"), F.min("id").alias("id"), F.min("cell").alias("cell")
            ),
            f"repeats-wholes-{block}",
        )
        repeated = wholes.where("times > 1").select("core", "whole")
        spans.append(
            pieces.where("times = 1").join(repeated, ["core", "whole"], "left_semi").select(*SPAN)
        )
        if block == 1:
            break
        cores = stored(
            wholes.groupBy("core")
            .agg(F.count("*").alias("wholes"), F.min("times").alias("least"))
            .where("wholes > 1 AND least = 1")
            .select("core"),
            f"repeats-cores-{block}",
        )
        cells = wholes.join(cores, "core", "left_semi").select("id", "cell", "core", "times")
        entries = _cut(entries, cells, block, width)
    return reduce(DataFrame.unionByName, spans)


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, start, end): places where repeated strings of ``width`` bytes start."""
    if width < TRIGGER + 8:
        raise ValueError("strings must be longer than a trigger")
    ship(docs.sparkSession)
    parse = _parse(docs, _repeated_triggers(docs, width), width)
    dictionary = stored(
        parse.groupBy("key", "entry").agg(
            F.count("*").alias("n"), F.min(F.struct("doc", "start")).alias("at")
        ),
        "repeats-dictionary",
    )
    often = parse.join(
        dictionary.where("n > 1").select("key", "entry"), ["key", "entry"], "left_semi"
    ).select("doc", "start", "end")
    # Left to compare: triggers with several entries, one of which occurs once.
    open_keys = stored(
        dictionary.groupBy("key")
        .agg(F.count("*").alias("entries"), F.min("n").alias("least"))
        .where("entries > 1 AND least = 1")
        .select("key"),
        "repeats-open",
    )
    opened = dictionary.join(open_keys, "key", "left_semi").select(
        "key", "entry", F.col("n").alias("times"), "at.doc", "at.start"
    )
    entries = _contexts(docs, open_keys, width).join(opened, ["key", "entry"])
    compared = _compared(entries.drop("entry"), width)
    return often.unionByName(compared)


ADDED = ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")


def removed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept (the bytes left) and kept_sha256."""
    columns = [c for c in docs.columns if c not in ADDED]
    spans = stored(repeated_spans(docs, width), "repeats-spans")
    # A document has no more spans than bytes; rows repeated in full share theirs.
    by_doc = (
        spans.groupBy("doc")
        .agg(F.collect_set(F.struct("start", "end")).alias("spans"))
        .select("doc", "spans.start", "spans.end")
        .toDF("doc", "starts", "ends")
    )
    rows = docs.select(
        F.xxhash64("doc_id", text_hash()).alias("doc"),
        "text",
        F.struct(*[F.col(c) for c in columns]).alias("row"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            begins, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
            for text, begin, end in zip(
                text_bytes(batch.column("text")), begins, ends, strict=True
            ):
                edge = np.zeros(len(text) + 1, np.int64)
                if begin:
                    np.add.at(edge, np.array(begin), 1)
                    np.add.at(edge, np.array(end) + width - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append(
                    (len(text), int(gone.sum()), runs, kept, hashlib.sha256(kept).hexdigest())
                )
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            added = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *added], ["row", *ADDED])

    joined = rows.join(by_doc, "doc", "left").select("row", "text", "starts", "ends")
    kind = rows.schema["row"].dataType.simpleString()
    return joined.mapInArrow(
        run,
        f"row {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary,"
        " kept_sha256 string",
    ).select("row.*", *ADDED)

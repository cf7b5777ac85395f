"""Benchmark decontamination by a prefix-filtered join of item windows.

A window is ``WINDOW`` consecutive words of an item (all words of a shorter item). It is a
set of shingles of three words; as it must be contained whole, its rarest shingle is a
sufficient prefix. Rarity is the shingle's count in all documents. A document position
that holds a window's prefix shingle is a candidate; the bounds of the document (length
and position) are applied, and then the window's words are compared one by one.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text (a single longer item
is a block of its own), and only one block's index is broadcast at a time, so a benchmark
of any size works, one pass over the documents per block and count.

Null texts have no words. Repeated items count once; an item without id is named by the
empty string. Repeated documents are judged separately. With an empty benchmark nothing
is hit; an empty document table gives no rows. Other columns are carried along by
``drop_contaminated`` and ignored by ``hits``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netvigil.llm.bytesets import groups, text_bytes
from netvigil.llm.common import ship, text_hash

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 2 << 20
CHUNK = 1 << 20

# Fixed by the contract: words are digits, a-z and all beyond ASCII; A-Z is lowered.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def _expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) for the places starts[row] .. starts[row] + counts[row] - 1."""
    row = np.repeat(np.arange(len(starts)), counts)
    first = np.cumsum(counts) - counts
    return row, np.arange(len(row)) - first[row] + starts[row]


@dataclass
class Windows:
    """The distinct windows of one length in a block of items."""

    words: np.ndarray  # a row of word numbers per window
    item_start: np.ndarray  # window -> its items in ``items``
    items: np.ndarray
    shingles: np.ndarray  # sorted codes of all shingles
    of_window: np.ndarray  # a row of places in ``shingles`` per window
    # the index by prefix, once the counts are known
    prefix_start: np.ndarray | None = None
    prefix_window: np.ndarray | None = None
    prefix_offset: np.ndarray | None = None

    def arrange(self, counts: np.ndarray) -> None:
        """Choose each window's rarest shingle and index the windows by it."""
        found = counts[self.of_window]
        offset = found.argmin(axis=1)
        rows = np.arange(len(offset))
        alive = found[rows, offset] > 0  # a shingle that no document holds rules its windows out
        prefix = self.of_window[rows, offset][alive]
        order = np.argsort(prefix, kind="stable")
        self.prefix_window = rows[alive][order]
        self.prefix_offset = offset[alive][order]
        self.prefix_start = np.searchsorted(prefix[order], np.arange(len(self.shingles) + 1))


class Index:
    """The windows of a block of items, by length."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        texts = [(number[name], split_words(text)) for name, text in items]
        self.vocabulary: dict[bytes, int] = {}
        for _, ws in texts:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, ws in texts:
            ids = [self.vocabulary[w] for w in ws]
            size = min(WINDOW, len(ids))
            if size:
                for i in range(len(ids) - size + 1):
                    found.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.by_size = {size: self._windows(windows) for size, windows in found.items()}

    def _windows(self, windows: dict[tuple[int, ...], set[int]]) -> Windows:
        words = np.array(list(windows), np.int64)
        owners = [sorted(x) for x in windows.values()]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in owners])])
        codes = self.codes(words, min(SHINGLE, words.shape[1]))
        shingles, place = np.unique(codes, return_inverse=True)
        return Windows(
            words, starts, np.concatenate(owners), shingles, place.reshape(codes.shape)
        )

    def codes(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Codes of k consecutive words along the last axis; -1 if one is no benchmark word."""
        n = ids.shape[-1] - k + 1
        if n <= 0:
            return np.zeros((*ids.shape[:-1], 0), np.int64)
        base = len(self.vocabulary) + 1
        code = np.zeros((*ids.shape[:-1], n), np.int64)
        good = np.ones((*ids.shape[:-1], n), bool)
        for i in range(k):
            part = ids[..., i : i + n]
            code = code * base + part
            good &= part >= 0
        # Codes may wrap in a huge vocabulary: candidates are compared word by word anyway.
        return np.where(good, code & (2**62 - 1), -1)

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, -1 between texts and for other words; and the borders."""
        get = self.vocabulary.get
        lists = [split_words(text) for text in texts]
        flat: list[int] = []
        for ws in lists:
            flat.extend([get(w, -1) for w in ws])
            flat.append(-1)
        borders = np.concatenate([[0], np.cumsum([len(ws) + 1 for ws in lists])])
        return np.array(flat, np.int64), borders.astype(np.int64)

    def shingle_places(self, ids: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(position, place in windows.shingles) of every benchmark shingle in ``ids``."""
        codes = self.codes(ids, min(SHINGLE, windows.words.shape[1]))
        at = np.flatnonzero(codes >= 0)
        place = np.searchsorted(windows.shingles, codes[at])
        place[place == len(windows.shingles)] = 0
        same = windows.shingles[place] == codes[at] if len(windows.shingles) else at < 0
        return at[same], place[same]

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """The texts' borders among their words, which words are hit, and each text's items.

        A text's words are the places from its border to the next, but for the last one.
        """
        ids, borders = self.numbers(texts)
        change = np.zeros(len(ids) + 1, np.int64)
        pairs = []
        for size, windows in self.by_size.items():
            at, place = self.shingle_places(ids, windows)
            first = windows.prefix_start[place]
            row, entry = _expand(first, windows.prefix_start[place + 1] - first)
            start = at[row] - windows.prefix_offset[entry]
            window = windows.prefix_window[entry]
            text = np.searchsorted(borders, at[row], side="right") - 1
            inside = (start >= borders[text]) & (start + size < borders[text + 1])
            start, window, text = start[inside], window[inside], text[inside]
            for i in range(size):
                same = ids[start + i] == windows.words[window, i]
                start, window, text = start[same], window[same], text[same]
            np.add.at(change, start, 1)
            np.add.at(change, start + size, -1)
            of_pair = np.unique(text * len(windows.words) + window)
            text, window = np.divmod(of_pair, len(windows.words))
            first = windows.item_start[window]
            row, entry = _expand(first, windows.item_start[window + 1] - first)
            pairs.append(text[row] * len(self.names) + windows.items[entry])
        names: list[list[str]] = [[] for _ in texts]
        for pair in np.unique(np.concatenate(pairs)) if pairs else ():
            names[pair // len(self.names)].append(self.names[pair % len(self.names)])
        return borders, np.cumsum(change[:-1]) > 0, names


def _index(docs: DataFrame, items: list[tuple[str, bytes]]):
    """A broadcast index of a block of items, arranged by the rarity of shingles in ``docs``."""
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    index = Index(items)
    shared = context.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {
            size: np.zeros(len(w.shingles), np.int64) for size, w in shared.value.by_size.items()
        }
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for low, high in groups([len(t) for t in texts], CHUNK):
                ids, _ = shared.value.numbers(texts[low:high])
                for size, windows in shared.value.by_size.items():
                    _, place = shared.value.shingle_places(ids, windows)
                    sums[size] += np.bincount(place, minlength=len(windows.shingles))
        for size, n in sums.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), size)), pa.array(used), pa.array(n[used])],
                ["size", "place", "n"],
            )

    counts = (
        docs.select("text")
        .mapInArrow(count, "size bigint, place bigint, n bigint")
        .groupBy("size", "place")
        .agg(F.sum("n").alias("n"))
    )
    totals = {size: np.zeros(len(w.shingles), np.int64) for size, w in index.by_size.items()}
    for size, place, n in counts.collect():  # at most one row per shingle of the block
        totals[size][place] = n
    for size, windows in index.by_size.items():
        windows.arrange(totals[size])
    return context.broadcast(index)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    items = benchmark.where("text IS NOT NULL").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text"
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block)
        yield [(name, text.encode()) for name, text in rows.collect()]


def _block_hits(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, body, n_words, starts, ends, items): disjoint stretches of words hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            n_words, starts, ends, items = [], [], [], []
            for low, high in groups([len(t) for t in texts], CHUNK):
                borders, hit, names = shared.value.search(texts[low:high])
                n_words.extend((np.diff(borders) - 1).tolist())
                items.extend(names)
                edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
                begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                cut = np.searchsorted(begin, borders)
                for i in range(high - low):
                    span = slice(cut[i], cut[i + 1])
                    starts.append(begin[span] - borders[i])
                    ends.append(end[span] - borders[i])
            places = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("body"),
                    pa.array(n_words, pa.int64()),
                    pa.array(starts, places),
                    pa.array(ends, places),
                    pa.array(items, pa.list_(pa.string())),
                ],
                ["doc_id", "body", "n_words", "starts", "ends", "items"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", text_hash().alias("body")).mapInArrow(
        run,
        f"doc_id {kind}, body bigint, n_words bigint, starts array<bigint>, ends array<bigint>,"
        " items array<string>",
    )


def _n_hit(spans: Column) -> Column:
    """Words in the union of (start, end) stretches that are sorted."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans,
        zero,
        lambda s, x: F.struct(
            F.greatest(s.end, x.ends).alias("end"),
            (s.n + F.greatest(F.lit(0), x.ends - F.greatest(s.end, x.starts))).alias("n"),
        ),
        lambda s: s.n,
    )


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (names of the items found, sorted)."""
    found = [_block_hits(docs, _index(docs, block)) for block in _blocks(benchmark)]
    spans = F.arrays_zip("starts", "ends")
    if len(found) == 1:
        return found[0].select("doc_id", "n_words", _n_hit(spans).alias("n_hit"), "items")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    # Rows repeated in full meet in a group and are told apart again by their number.
    return (
        rows.groupBy("doc_id", "body", "n_words")
        .agg(
            (F.count("*") / len(found)).cast("int").alias("copies"),
            F.sort_array(F.flatten(F.collect_list(spans))).alias("spans"),
            F.array_distinct(F.sort_array(F.flatten(F.collect_list("items")))).alias("items"),
        )
        .select("doc_id", "n_words", _n_hit(F.col("spans")).alias("n_hit"), "items", "copies")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .drop("copies", "copy")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns."""
    clean = docs
    for block in _blocks(benchmark):
        shared = _index(docs, block)

        def run(batches, shared=shared):
            for batch in batches:
                texts = text_bytes(batch.column("text"))
                keep = []
                for low, high in groups([len(t) for t in texts], CHUNK):
                    borders, hit, _ = shared.value.search(texts[low:high])
                    n = np.concatenate([[0], np.cumsum(hit)])[borders]
                    keep.extend((np.diff(n) == 0).tolist())
                yield batch.filter(pa.array(keep, pa.bool_()))

        clean = clean.mapInArrow(run, docs.schema)
    return clean

"""Exact n-gram Jaccard join by set relations: skipping list blocks and answers.

Documents with the same shingle set form a class; classes are joined. Shingles are
ordered by rarity, so that only a set's first tenth or so (at 0.9) can be the first shingle it
shares with a similar set: its prefix. Prefix shingles are the keys of index lists, whose
entries carry the set's size and the shingle's position in it.

*List skipping.* Lists are split into blocks of entries of like size and position, which are
keys of the join; an entry is not sent to blocks that its size or position rules out.

*Answer skipping.* In each list the entry nearest its front is the pivot. All others are
compared with it, and what is similar takes over the pivot's answers: it lies in its
component. Only entries that share a list with another component are compared again, with
new pivots, and at last the smaller components of a list with all of its entries, so that
no link between two components is missed. Inside a component no pair is listed.

*Comparing.* A pair's parity bitmaps, a bit per shingle, bound its difference from below and
rule out nearly all pairs that only share a common shingle; the sets themselves are fetched
and intersected for what is left. The last lists compare bitmaps, folded to ``SKETCH`` bits, before
they list a pair, and leave out a pair whose entries have met before, as told by the ``BEFORE``
shingles that stand before each: a group of near copies that don't link has a pair of any two in
each list they share.

Rarity comes from counts of all documents' shingles in a fixed number of cells, about a
quarter of a million; they only order shingles, so collisions cost time and not results.
Shingles and classes are 64-bit hashes.

Null text and texts without words have an empty set and link with nothing. Repeated rows
share a class. A null ``doc_id`` counts as no member when the smallest is chosen, and links
of a class without any id are not followed. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from netvigil.llm.bytesets import Rolling, groups, mix, signed, text_bytes
from netvigil.llm.common import ship, stored, summed, text_hash, tidy
from netvigil.llm.components import components, joined_components
from netvigil.llm.filters import Filter

SHINGLE = 3
PERCENT = 90
CELLS = 1 << 18
CHUNK = 1 << 19
PIVOT_ROUNDS = 2
BLOCK_CELLS = 1 << 12
POSITION_BLOCKS = 4
SKETCH = 1 << 10  # bits of a bitmap at least, and as many as entries of lists carry
BEFORE = 4

_LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_IN_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct shingle hashes, one text after another, sorted; and the borders."""
    data = _LOWERED[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    inside = np.concatenate([[False], _IN_WORD[data], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    words = mix(Rolling(data).of(starts, ends))
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    first = np.searchsorted(starts, edges)  # a text's words
    n = np.diff(first)
    text = np.repeat(np.arange(len(texts)), n)
    # A shingle begins at every word that has size - 1 words after it, or at a short text's first.
    last = first[1:][text]
    begins = np.flatnonzero(
        (np.arange(len(words)) + size <= last)
        | ((np.arange(len(words)) == first[:-1][text]) & (n[text] < size))
    )
    code = np.zeros(len(begins), np.uint64)
    for i in range(size):
        at = begins + i
        there = at < last[begins]
        word = np.where(there, words[np.minimum(at, max(0, len(words) - 1))], 0)
        code = mix(code + word.astype(np.uint64), i + 1)
    owner = text[begins]
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    code, owner = code[fresh], owner[fresh]
    return code, np.searchsorted(owner, np.arange(len(texts) + 1))


def class_ids(code: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(code, 101))])
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(code, 102))])
    one, two = sums[borders[1:]] - sums[borders[:-1]], other[borders[1:]] - other[borders[:-1]]
    return mix(mix(one) + two, 103) ^ np.diff(borders).astype(np.uint64)


def bitmaps(code: np.ndarray, borders: np.ndarray) -> list[bytes]:
    """A bit per shingle or so, set by parity: two sets differ in at least as many shingles as
    their bitmaps in bits. Widths are powers of two from ``SKETCH``; halves fold together by exclusive or."""
    n = np.diff(borders)
    width = np.left_shift(1, np.ceil(np.log2(np.maximum(n, SKETCH))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(width)])
    owner = np.repeat(np.arange(len(n)), n)
    bit = (mix(code, 104) & (width[owner] - 1).astype(np.uint64)).astype(np.int64)
    counts = np.bincount(begin[owner] + bit, minlength=begin[-1])
    raw = np.packbits((counts & 1).astype(np.uint8)).tobytes()
    return [raw[begin[i] // 8 : begin[i + 1] // 8] for i in range(len(n))]


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of how many shingles are in one set only."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        folded = int.from_bytes(x[:half], "big") ^ int.from_bytes(x[half:], "big")
        x = folded.to_bytes(half, "big")
    return (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_count()


def sketch(bits: bytes) -> list[int]:
    """A bitmap folded to ``SKETCH`` bits, as 64-bit numbers."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.int64).reshape(-1, SKETCH // 64)).tolist()


def _members(docs: DataFrame, size: int) -> DataFrame:
    """Stored rows of two kinds: (doc_id, text_hash, class, n, bits) per document, and (block, counts):
    how many sets hold shingles of each rarity cell, as told by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        names = ["doc_id", "text_hash", "class", "n", "bits", "block", "counts"]
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for low, high in groups([len(t) for t in texts], CHUNK):
                code, borders = shingle_sets(texts[low:high], size)
                cells += np.bincount((code >> np.uint64(46)).astype(np.int64), minlength=CELLS)
                rows = high - low
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, rows),
                        batch.column("text_hash").slice(low, rows),
                        signed(class_ids(code, borders)),
                        pa.array(np.diff(borders), pa.int64()),
                        pa.array(bitmaps(code, borders), pa.binary()),
                        pa.nulls(rows, pa.int32()),
                        pa.nulls(rows, pa.binary()),
                    ],
                    names,
                )
        blocks = cells.reshape(-1, BLOCK_CELLS)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(used), doc_type),
                pa.nulls(len(used), pa.int64()),
                pa.nulls(len(used), pa.int64()),
                pa.nulls(len(used), pa.int64()),
                pa.nulls(len(used), pa.binary()),
                pa.array(used, pa.int32()),
                pa.array([blocks[i].tobytes() for i in used], pa.binary()),
            ],
            names,
        )

    kind = dict(docs.dtypes)["doc_id"]
    doc_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return stored(
        docs.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(
            run, f"doc_id {kind}, text_hash bigint, class bigint, n bigint, bits binary, block int, counts binary"
        ),
        "jaccard-members",
    )


def _rarity(members: DataFrame) -> np.ndarray:
    """Log-sized counts of all cells: CELLS bytes, whatever the input."""

    cells = np.zeros((CELLS // BLOCK_CELLS, BLOCK_CELLS), np.uint8)
    counts = members.where("block IS NOT NULL").select(
        F.col("block").cast("long").alias("key"), F.col("counts").alias("numbers")
    )
    for block, raw in summed(counts, "<i8").collect():  # CELLS / BLOCK_CELLS rows
        cells[block] = np.ceil(4 * np.log2(np.frombuffer(raw, np.int64) + 1.0))
    return cells.reshape(-1)


def _by_rarity(code: np.ndarray, borders: np.ndarray, levels: np.ndarray):
    """Each set's shingles from rare to frequent: (shingle, set, position)."""
    owner = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    order = np.lexsort((code, levels[(code >> np.uint64(46)).astype(np.int64)], owner))
    return code[order], owner, np.arange(len(code)) - borders[:-1][owner]


def _lists(docs: DataFrame, levels: np.ndarray, size: int, percent: int) -> DataFrame:
    """Index lists: (token, class, n, pos), a row per prefix shingle of each class."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for low, high in groups([len(t) for t in texts], CHUNK):
                code, borders = shingle_sets(texts[low:high], size)
                ids = class_ids(code, borders)
                # A class that several texts of the chunk share is listed once.
                once = np.zeros(len(ids), bool)
                once[np.unique(ids, return_index=True)[1]] = True
                token, owner, pos = _by_rarity(code, borders, shared.value)
                n = np.diff(borders)[owner]
                prefix = (pos <= n - -(-percent * n // 100)) & once[owner]
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(token[prefix]),
                        signed(ids[owner[prefix]]),
                        pa.array(n[prefix], pa.int32()),
                        pa.array(pos[prefix], pa.int32()),
                    ],
                    ["token", "class", "n", "pos"],
                )

    rows = docs.select("text").mapInArrow(run, "token bigint, class bigint, n int, pos int")
    rows = rows.groupBy("token", "class").agg(F.max("n").alias("n"), F.max("pos").alias("pos"))
    shared_tokens = (
        rows.groupBy("token").agg(F.count("*").alias("entries")).where("entries > 1")
    )
    return stored(rows.join(shared_tokens.select("token"), "token"), "jaccard-lists")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Size and position bounds of two entries whose first common shingle is the list's."""
    na, nb, pa_, pb = (F.col(x) for x in (f"{a}n", f"{b}n", f"{a}pos", f"{b}pos"))
    best = F.least(na - pa_, nb - pb)
    return (
        (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
        & ((100 + percent) * best >= percent * (na + nb))
    )


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps do not rule out that they are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            bits = zip(
                batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True
            )
            apart = np.array([least_difference(x, y) for x, y in bits], np.int64)
            near = (100 + percent) * apart <= (100 - percent) * total
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def side(name: str) -> DataFrame:
        return classes.select(
            F.col("class").alias(name),
            F.col("n").alias(f"n_{name}"),
            F.col("bits").alias(f"bits_{name}"),
        )

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """Stored (class, shingles) of the needed classes (column ``key``)."""
    shared = docs.sparkSession.sparkContext.broadcast(Filter(needed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for low, high in groups([len(t) for t in texts], CHUNK):
                code, borders = shingle_sets(texts[low:high], size)
                ids, first = np.unique(class_ids(code, borders), return_index=True)
                wanted = shared.value(ids)
                ids, first = ids[wanted], first[wanted]
                sets = [code[borders[i] : borders[i + 1]].tobytes() for i in first]
                yield pa.RecordBatch.from_arrays(
                    [signed(ids), pa.array(sets, pa.binary())], ["key", "shingles"]
                )

    found = docs.select("text").mapInArrow(run, "key bigint, shingles binary")
    return stored(
        found.join(needed, "key", "left_semi")
        .dropDuplicates(["key"])
        .withColumnRenamed("key", "class"),
        "jaccard-sets",
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(
                batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True
            ):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                merged = np.concatenate([x, y])
                merged.sort()
                common = int((merged[1:] == merged[:-1]).sum())
                keep.append((100 + percent) * common >= percent * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of_a = sets.select(F.col("class").alias("a"), F.col("shingles").alias("of_a"))
    of_b = sets.select(F.col("class").alias("b"), F.col("shingles").alias("of_b"))
    return pairs.join(of_b, "b").join(of_a, "a").mapInArrow(run, "a bigint, b bigint")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _labelled(lists: DataFrame, of: DataFrame) -> DataFrame:
    """Lists that hold more than one component ``of`` so far, with each entry's component."""
    rows = lists.join(of, lists["class"] == of.node, "left").select(
        "token", "class", "n", "pos", F.coalesce("component", "class").alias("label")
    )
    mixed = (
        rows.groupBy("token")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low <> high")
        .select("token")
    )
    return stored(rows.join(mixed, "token"), "jaccard-mixed")


def _pivot_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Each component's best entry of a list with the list's first entry: one pair per entry
    at most."""
    first = rows.groupBy("token").agg(
        F.min(F.struct(F.col("pos") / F.col("n"), "class", "n", "pos", "label")).alias("p")
    )
    pivots = first.select(
        "token",
        F.col("p.class").alias("p_class"),
        F.col("p.n").alias("p_n"),
        F.col("p.pos").alias("p_pos"),
        F.col("p.label").alias("p_label"),
    )
    return (
        rows.join(pivots, "token")
        .where((F.col("label") != F.col("p_label")) & _may_link("", "p_", percent))
        .select(*_pair(F.col("class"), F.col("p_class")))
        .distinct()
    )


def _sketches(classes: DataFrame) -> DataFrame:
    """(class, sketch) of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(bits) for bits in batch.column("bits").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), pa.array(found, pa.list_(pa.int64()))], ["class", "sketch"]
            )

    return classes.select("class", "bits").mapInArrow(run, "class bigint, sketch array<bigint>")


def _sketches_may_link(a: str, b: str, percent: int) -> Column:
    """As ``_near``, by two entries' sketches."""
    x, y, na, nb = (F.col(c) for c in (f"{a}sketch", f"{b}sketch", f"{a}n", f"{b}n"))
    apart = sum(F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(SKETCH // 64))
    return (100 + percent) * apart <= (100 - percent) * (na + nb)


def _meeting(rows: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """Entries (prefix m_) that may link with others of another component in their block, as
    far as a row per block tells."""
    t = percent / 100
    spare = F.col("n") / (1 + t) - F.col("pos")  # t / (1 + t) of a partner's size at least
    block = ["token", "band", "place"]
    held = others.groupBy(block).agg(
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.min("n").alias("least"),
        F.max(spare).alias("spare"),
    )
    share, n, pos = t / (1 + t), F.col("m_n"), F.col("m_pos")
    return (
        rows.join(held, block)
        .where((F.col("low") != F.col("m_label")) | (F.col("high") != F.col("m_label")))
        .where((n - pos + 1e-6 >= share * (n + F.col("least"))) & (F.col("spare") + 1e-6 >= share * n))
        .select(rows.columns)
    )


def _last_pairs(rows: DataFrame, percent: int, classes: DataFrame | None = None) -> DataFrame:
    """What ``_listed`` gives, each pair once."""
    return _listed(rows, percent, classes).distinct()


def _listed(rows: DataFrame, percent: int, classes: DataFrame | None = None) -> DataFrame:
    """Entries outside a list's largest component with the entries of other components.

    A list is cut into blocks of entries of like size (a band reaches as far as sizes of
    similar sets may differ) and of like position in their sets. An entry is sent to the
    blocks in which its own bounds leave a partner, and to no others: for sizes from lo to hi
    in a block, a partner may stand no deeper than (1 - t * n / hi) / (1 + t) of its set,
    and the entry itself no deeper than (n - t * lo) / (1 + t).

    Entries that meet none of another component in any block are left out; the others carry their
    sketches (of ``classes``, if given) and the lists before, so that the join lists few pairs that are
    not similar, and few twice.
    """
    t = percent / 100
    sizes = rows.groupBy("token", "label").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("size", "label")).alias("top")).select(
        "token", F.col("top.label").alias("top")
    )
    rows = rows.join(largest, "token")
    n, pos = F.col("n").cast("double"), F.col("pos")
    ratio = 1 / min(t, 0.999)  # of the sizes a band holds
    band = F.floor(F.log(n) / math.log(ratio)).cast("int")
    deepest = 1 - t if t < 1 else 1.0  # of a prefix, as a share of the set
    place = F.floor(POSITION_BLOCKS * pos / (n * deepest)).cast("int")

    def blocks(near: Column) -> Column:
        # A hair wider than the bounds, as logarithms round.
        low, high = (F.pow(F.lit(ratio), near + i) * (1 + (2 * i - 1) * 1e-9) for i in (0, 1))
        partner = (1 - t * n / high) / (1 + t) + 1e-9
        last = F.floor(POSITION_BLOCKS * partner / deepest).cast("int")
        own = pos <= (n - t * low) / (1 + t) + 1e-9
        inside = own & (last >= 0)
        every = F.sequence(F.lit(0), F.when(inside, last).otherwise(0))
        return F.when(
            inside, F.transform(every, lambda b: F.struct(near.alias("band"), b.alias("place")))
        ).otherwise(F.array().cast("array<struct<band:int,place:int>>"))

    to = F.flatten(F.array(blocks(band - 1), blocks(band), blocks(band + 1)))
    entry = ("class", "n", "pos", "label")
    block = ["token", "band", "place"]
    minor = rows.where("label <> top").select(
        "token", F.inline(to), *[F.col(c).alias(f"m_{c}") for c in entry]
    )
    every = rows.select("token", band.alias("band"), place.alias("place"), *entry)
    minor = stored(_meeting(minor, every, percent), "jaccard-minor")
    every = _meeting(
        every.withColumnsRenamed({c: f"m_{c}" for c in entry}),
        minor.withColumnsRenamed({f"m_{c}": c for c in entry}),
        percent,
    ).withColumnsRenamed({f"m_{c}": c for c in entry})
    every = stored(every, "jaccard-every")
    minor = minor.withColumnsRenamed({f"m_{c}": c for c in entry})
    wanted = (F.col("label") != F.col("m_label")) & _may_link("", "m_", percent)
    if classes is not None:
        used = every.select("class").unionByName(minor.select("class")).distinct()
        sketches = stored(_sketches(classes.join(used, "class", "left_semi")), "jaccard-sketches")
        every, minor = every.join(sketches, "class"), minor.join(sketches, "class")
        wanted &= _sketches_may_link("", "m_", percent)
    # The first list that two entries share is never left out.
    earlier = Window.partitionBy("class", "band", "place").orderBy("pos").rowsBetween(-BEFORE, -1)
    every, minor = (x.withColumn("before", F.collect_list("token").over(earlier)) for x in (every, minor))
    minor = minor.withColumnsRenamed({c: f"m_{c}" for c in minor.columns if c not in block})
    return (
        every.join(minor, block)
        .where(wanted & ~F.arrays_overlap("before", "m_before"))
        .select(*_pair(F.col("class"), F.col("m_class")))
    )


def _grouped_classes(
    docs: DataFrame, size: int, percent: int
) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, text_hash, class, n; classes: class, doc_id, group)."""
    ship(docs.sparkSession)
    members = _members(docs, size)
    rows = members.where("block IS NULL")
    classes = stored(
        rows.where("n > 0")
        .groupBy("class")
        .agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("bits").alias("bits")),
        "jaccard-classes",
    )
    lists = _lists(docs, _rarity(members), size, percent)

    of = None  # components so far
    mixed, joined = lists.withColumn("label", F.col("class")), True
    for last in [False] * PIVOT_ROUNDS + [True]:
        if not (joined or last):
            continue  # the same pivots again
        if of is not None and joined:
            mixed = _labelled(lists, of)
        pairs = _last_pairs(mixed, percent, classes) if last else _pivot_pairs(mixed, percent)
        pairs = stored(_near(stored(pairs, "jaccard-pairs"), classes, percent), "jaccard-near")
        needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        if of is not None and pairs.isEmpty():
            joined = False
            continue
        sets = _sets(docs, stored(needed, "jaccard-needed"), size)
        found = stored(_verified(pairs, sets, percent), "jaccard-links")
        joined = not found.isEmpty()
        if of is None:
            of = components(found, "jaccard-components")
        elif joined:
            of = joined_components(of, found, "jaccard-components")

    grouped = (
        classes.join(of, classes["class"] == of.node, "left")
        .select("class", "doc_id", F.coalesce("component", "class").alias("group"))
    )
    return rows, grouped


def jaccard_components(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable)."""
    with tidy(docs.sparkSession):
        rows, grouped = _grouped_classes(docs, size, percent)
    smallest = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    answer = stored(
        grouped.join(smallest, "group").select("class", "component_id"), "jaccard-answer"
    )
    return rows.join(answer, "class", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_per_group(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` of each group of linked ones; columns stay.

    The row with the smallest id stays, one without id only if the group has no other; of
    rows that share the id the text with the least hash, and of rows repeated in full one.
    Rows without words stay.
    """
    with tidy(docs.sparkSession):
        rows, grouped = _grouped_classes(docs, size, percent)
    members = stored(
        rows.where("n > 0").join(grouped.select("class", "group"), "class").select(
            "group", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash").alias("who")
        ),
        "jaccard-groups",
    )
    first = members.groupBy("group").agg(F.min("who").alias("first"), F.count("*").alias("rows"))
    # Groups of one row need no decision.
    members = members.join(first.where("rows > 1"), "group")
    others = members.where("who <> first").select("who.*").distinct()
    again = members.where("who = first").groupBy("who").count().where("count > 1").select("who.*")
    decided = stored(
        others.withColumn("stays", F.lit(False)).unionByName(again.withColumn("stays", F.lit(True))),
        "jaccard-decided",
    )
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), text_hash().alias("hash"))

    def named(found: DataFrame) -> Column:
        return keyed.id.eqNullSafe(found.doc_id) & (keyed.hash == found.text_hash)

    rest = keyed.join(decided, named(decided), "left_anti").select("row.*")
    repeated = decided.where("stays")
    if repeated.isEmpty():
        return rest
    once = keyed.join(repeated, named(repeated), "left_semi").dropDuplicates(["id", "hash"])
    return rest.unionByName(once.select("row.*"))

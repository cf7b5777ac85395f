"""The trie of conversation prefixes, from sorted sequences of turns.

Each turn is a 128-bit hash of role and text with the number of words of the text, so texts
are never shuffled. Conversations are sorted as sequences of turns, which puts the members
of every prefix next to each other. Within a block of sorted sequences, the lengths of
common prefixes of neighbours stand in a sparse table of range minima. Every candidate
(sequence, depth) searches its extent to the left and to the right by halving steps over
that table, each independently of all others; a candidate that is the first of its extent
is a node. What a node sums over its members comes from running sums and further sparse
tables over the extent.

Spark partitions the sequences by ranges of (sequence, conv_id), so that a first turn or a
conversation which a third of all share is spread over tasks, and equal sequences become
one row per task with their number. A node that reaches the edge of a block is a partial
one there: the partial nodes of one prefix are added up by its hash. For that a block has
to know how much its first sequence shares with the sequence before, one number a task.
The digest of a node's conv_ids is taken while they stream by in order; only the ids of a
task's first and last sequence are handed on, as pieces of text.

Turns are ordered by ``turn``, null first, ties by hash. A null role or text is empty. Rows
without conv_id are one conversation with no id: it counts, is smallest only where it is
alone, and stands for an empty text at the end of a digest. Repeated rows are turns of
their own. An empty table has no nodes, not even a root. Other columns are ignored. The
hashes of one conversation, 24 bytes a turn, and a block of sequences are held in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netvigil.llm.common import WORD, ship, stored
from netvigil.operators.sizing import broadcast_if_small

NO_ID = 2**63 - 1  # stands for a missing conv_id, after all others
BLOCK = 65_536  # sequences of a block
BLOCK_TURNS = 1 << 20  # turns of a block, but for its last sequence
PIECE = 1 << 18  # bytes of conv_ids in one row
EMPTY = hashlib.sha256(b"").hexdigest()
_PATH = "array<struct<k1:bigint,k2:bigint,words:bigint>>"


def turn_lists(rows: DataFrame) -> DataFrame:
    """(conv_id, path): the turns of each conversation in order, hashed; conv_id is not null."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn"),
        F.xxhash64(role, F.lit("\n"), text).alias("k1"),
        F.xxhash64(F.lit(1), role, F.lit("\n"), text).alias("k2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return (
        rows.select(F.coalesce(F.col("conv_id"), F.lit(NO_ID)).cast("long").alias("conv_id"), turn.alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("t"))
        .select("conv_id", F.transform("t", lambda t: F.struct(t.k1, t.k2, t.words)).alias("path"))
    )


def node_key(above: bytes, k1: int, k2: int) -> bytes:
    """The 128-bit hash of a prefix, from the one that is a turn shorter."""
    raw = above + int(k1).to_bytes(8, "little", signed=True) + int(k2).to_bytes(8, "little", signed=True)
    return hashlib.blake2b(raw, digest_size=16).digest()


def path_keys(k1: np.ndarray, k2: np.ndarray) -> list[bytes]:
    """The hashes of all prefixes of a sequence, the empty one first."""
    keys = [b"root"]
    for a, b in zip(k1, k2, strict=True):
        keys.append(node_key(keys[-1], a, b))
    return keys


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The turns of several sequences, one below the other, and where each sequence ends."""
    turns = column.flatten()
    ends = np.cumsum(np.asarray(column.value_lengths(), np.int64))
    fields = [np.asarray(turns.field(i), np.int64) for i in range(3)]
    return np.stack(fields, axis=1), ends


def common_prefixes(turns: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many turns each sequence has in common with the one before; 0 for the first."""
    size = np.diff(ends, prepend=0)
    least = np.zeros(len(ends), np.int64)
    least[1:] = np.minimum(size[1:], size[:-1])
    row = np.repeat(np.arange(len(ends)), least)
    place = np.arange(len(row)) - np.repeat(np.cumsum(least) - least, least)
    start = ends - size
    here, above = start[row] + place, start[row - 1] + place
    differ = (turns[here, :2] != turns[above, :2]).any(axis=1)
    shared = least.copy()
    np.minimum.at(shared, row[differ], place[differ])
    return shared


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all stretches whose length is a power of two."""
    table = [values]
    while 2 << len(table) - 1 <= len(values):
        half = 1 << len(table) - 1
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def extents(
    table: list[np.ndarray], row: np.ndarray, depth: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The first and last sequence that share ``depth`` turns with ``row``.

    ``table`` is that of the common prefixes with the sequence before; a step of 2**k is
    taken where the minimum of the 2**k prefixes ahead is still deep enough.
    """
    n = len(table[0])
    left, right = row.copy(), row.copy()
    for k in reversed(range(len(table))):
        step, level = 1 << k, table[k]
        fits = left >= step
        fits &= level[np.where(fits, left - step + 1, 0)] >= depth
        left = np.where(fits, left - step, left)
        fits = right + step < n
        fits &= level[np.where(fits, right + 1, 0)] >= depth
        right = np.where(fits, right + step, right)
    return left, right


def least_within(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The minimum of each stretch: two overlapping powers of two."""
    level = np.frexp(last - first + 1)[1] - 1
    out = np.empty(len(first), np.int64)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][first[at]], table[k][last[at] - (1 << k) + 1])
    return out


class Block:
    """The nodes of consecutive sorted sequences.

    ``before`` and ``after`` say how many turns the first shares with the sequence before
    the block and the last with the one behind it; -1 where there is none.
    """

    def __init__(
        self,
        turns: np.ndarray,
        ends: np.ndarray,
        copies: np.ndarray,
        least_id: np.ndarray,
        before: int,
        after: int,
    ):
        m = len(ends)
        size = np.diff(ends, prepend=0)
        start = ends - size
        shared = common_prefixes(turns, ends)
        table = sparse_table(shared)
        row = np.repeat(np.arange(m), size + 1)
        depth = np.arange(len(row)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
        left, right = extents(table, row, depth)
        node = left == row
        row, right, depth = row[node], right[node], depth[node]
        self.row, self.depth, self.right = row, depth, right
        self.least_id = least_within(sparse_table(least_id), row, right)

        def within(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(values)])
            return sums[right + 1] - sums[row]

        self.n = within(copies)
        # Sums of words up to a turn, from the first one of the sequence on.
        words = np.concatenate([[0], np.cumsum(turns[:, 2])])

        def upto(rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
            return words[start[rows] + depths] - words[start[rows]]

        follows = np.append(shared[1:], after)
        self.leaves = within((follows < size).astype(np.int64))
        # A sequence owns its nodes deeper than what it shares with the one before.
        owned_from = shared.copy()
        owned_from[0] = max(before, 0)
        every = np.arange(m)
        total = upto(every, size)
        own = total - upto(every, owned_from)
        above = np.maximum(depth - 1, 0)
        skipped = upto(row, np.maximum(above, owned_from[row])) - upto(row, owned_from[row])
        self.saved = within(copies * total) - self.n * upto(row, above) - (within(own) - skipped)
        # A child begins where a later sequence of the extent shares just this depth, and at
        # the extent's first sequence if that goes on and owns the node below.
        order = np.sort(shared[1:] * m + every[1:])
        self.children = np.searchsorted(order, depth * m + right, side="right") - np.searchsorted(
            order, depth * m + row, side="right"
        )
        self.children += (size[row] > depth) & ((row > 0) | (depth >= before))
        self.ends_here = size[row] == depth
        self.at_edge = (row == 0) | (right == m - 1)
        parent_left, parent_right = extents(table, row, above)
        self.parent_id = least_within(sparse_table(least_id), parent_left, parent_right)
        self.parent_at_edge = (parent_left == 0) | (parent_right == m - 1)
        self.parent_first = parent_left == 0


class _Group:
    """Equal sequences as they come by, with their conv_ids in ascending order."""

    def __init__(self, path: pa.ListArray):
        self.path, self.copies, self.least = path, 0, None
        self.hash = hashlib.sha256()
        self.ids: list[str] = []
        self.length = 0

    def add(self, conv_id: int) -> str | None:
        """Take in an id; returns a piece of ids when enough of them have gathered."""
        text = "" if conv_id == NO_ID else str(conv_id)
        self.least = conv_id if self.least is None else self.least
        self.hash.update(("," if self.copies else "").encode() + text.encode())
        self.copies += 1
        self.ids.append(text)
        self.length += len(text) + 1
        return self.flush() if self.length >= PIECE else None

    def flush(self) -> str:
        piece, self.ids, self.length = ",".join(self.ids), [], 0
        return piece


_SORTED = (
    f"part int, at bigint, path {_PATH}, copies bigint, least_id bigint, ends string,"
    " key binary, ids string"
)
_PATH_TYPE = pa.list_(
    pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("words", pa.int64())])
)
_SORTED_TYPE = pa.schema(
    [
        ("part", pa.int32()), ("at", pa.int64()), ("path", _PATH_TYPE), ("copies", pa.int64()),
        ("least_id", pa.int64()), ("ends", pa.string()), ("key", pa.binary()), ("ids", pa.string()),
    ]
)


def _key_of(path: pa.Array) -> bytes:
    turns, _ = _flat(path)
    return path_keys(turns[:, 0], turns[:, 1])[-1]


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct sequence of a sorted partition: (part, at, path, copies, least_id,
    ends). ``ends`` is null for the first and last sequence, which may go on in the next
    partition; the ids of such a sequence come as rows (part, at, key, ids) without a path."""
    part = TaskContext.get().partitionId()
    at = 0
    group: _Group | None = None
    is_first = True

    def closed(last: bool) -> list[dict]:
        open_ = is_first or last
        row = {
            "part": part, "at": at, "path": group.path[0].as_py(), "copies": group.copies,
            "least_id": group.least, "ends": None if open_ else group.hash.hexdigest(),
        }
        rows = [row]
        if open_ and group.ids:
            rows.append({"part": part, "at": at + 1, "key": _key_of(group.path), "ids": group.flush()})
        return rows

    for batch in batches:
        paths, ids = batch.column("path"), batch.column("conv_id").to_pylist()
        turns, ends = _flat(paths)
        size = np.diff(ends, prepend=0)
        shared = common_prefixes(turns, ends)
        new = (shared < size) | (np.append(0, size[:-1]) != size)
        if group is not None and len(ids):
            new[0] = not group.path.equals(paths[:1])
        elif len(ids):
            new[0] = True
        out: list[dict] = []
        for i, conv_id in enumerate(ids):
            if new[i]:
                if group is not None:
                    out += closed(False)
                    at += 2
                    is_first = False
                group = _Group(pa.array(paths[i : i + 1].to_pylist(), paths.type))
            piece = group.add(conv_id)
            if piece is not None:
                out.append({"part": part, "at": at, "key": _key_of(group.path), "ids": piece})
                at += 1
        if out:
            yield pa.RecordBatch.from_pylist(out, _SORTED_TYPE)
    if group is not None:
        yield pa.RecordBatch.from_pylist(closed(True), _SORTED_TYPE)


_NODES = (
    "key binary, parent_key binary, depth bigint, least_id bigint, parent_id bigint, n bigint,"
    " children bigint, leaves bigint, saved bigint, ends string, at_edge boolean"
)
_NODES_TYPE = pa.schema(
    [
        ("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int64()),
        ("least_id", pa.int64()), ("parent_id", pa.int64()), ("n", pa.int64()),
        ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()),
        ("ends", pa.string()), ("at_edge", pa.bool_()),
    ]
)


def _block_nodes(rows: pa.Table, before: int, after: int) -> pa.RecordBatch:
    """The nodes of a block. Those at its edge have a key, those below one a parent_key."""
    turns, ends = _flat(rows.column("path").combine_chunks())
    block = Block(
        turns,
        ends,
        np.asarray(rows.column("copies"), np.int64),
        np.asarray(rows.column("least_id"), np.int64),
        before,
        after,
    )
    cuts = np.append(0, ends)
    first = path_keys(turns[: ends[0], 0], turns[: ends[0], 1])
    tail = turns[cuts[-2] :]
    last = path_keys(tail[:, 0], tail[:, 1])
    keys, parents = [], []
    for row, depth, at_edge, parent_at_edge, parent_first in zip(
        block.row.tolist(),
        block.depth.tolist(),
        block.at_edge.tolist(),
        block.parent_at_edge.tolist(),
        block.parent_first.tolist(),
        strict=True,
    ):
        keys.append((first if row == 0 else last)[depth] if at_edge else None)
        if depth == 0 or not (parent_at_edge or at_edge):
            parents.append(None)
        else:
            parents.append((first if parent_first else last)[depth - 1])
    digest = np.array(rows.column("ends").to_pylist(), object)[block.row]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.binary()),
            pa.array(parents, pa.binary()),
            pa.array(block.depth),
            pa.array(block.least_id),
            pa.array(block.parent_id, mask=(block.parent_at_edge | (block.depth == 0))),
            pa.array(block.n),
            pa.array(block.children),
            pa.array(block.leaves),
            pa.array(block.saved),
            pa.array(np.where(block.ends_here, digest, None), pa.string()),
            pa.array(block.at_edge),
        ],
        schema=_NODES_TYPE,
    )


def _shared_by_part(sequences: DataFrame) -> dict[int, tuple[int, int]]:
    """Per partition, what its first sequence shares with the one before the partition and its
    last with the one behind it: two numbers per partition."""
    edges = sequences.groupBy("part").agg(
        F.min_by("path", "at").alias("first"), F.max_by("path", "at").alias("last")
    )
    # One row per partition: the window sees no more rows than there are tasks.
    before = edges.select("part", "first", F.lag("last").over(Window.orderBy("part")).alias("before"))
    least = F.least(F.size("first"), F.size("before"))
    differ = F.zip_with(
        F.slice("first", 1, least), F.slice("before", 1, least), lambda a, b: a != b
    )
    at = F.array_position(differ, True)
    shared = F.when(F.col("before").isNull(), -1).otherwise(F.when(at > 0, at - 1).otherwise(least))
    found = sorted((r["part"], r["shared"]) for r in before.select("part", shared.alias("shared")).collect())
    after = [n for _, n in found[1:]] + [-1]
    return {part: (n, after[i]) for i, (part, n) in enumerate(found)}


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over (conv_id, path): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has one row per conversation, as from ``turn_lists``.
    """
    ship(conversations.sparkSession)
    in_order = (
        conversations.select("path", "conv_id")
        .repartitionByRange("path", "conv_id")
        .sortWithinPartitions("path", "conv_id")
        .mapInArrow(_collapse, _SORTED)
    )
    in_order = stored(in_order, "trie-sorted")
    sequences = in_order.where("path IS NOT NULL")
    edges = _shared_by_part(sequences)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last sequence waits for the one behind it, to know what they share.
        held: list[pa.Table] = []
        part, before, n, n_turns = None, -1, 0, 0

        def block(upto: pa.Table, after: int) -> pa.RecordBatch:
            return _block_nodes(upto, before, after)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            parts = np.asarray(table.column("part"))
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(parts)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                here = int(parts[low])
                if here != part:
                    if held:
                        yield block(pa.concat_tables(held), edges[part][1])
                    part, held, before = here, [], edges[here][0]
                    n = n_turns = 0
                piece = table.slice(low, high - low)
                sizes = np.asarray(piece.column("path").combine_chunks().value_lengths(), np.int64)
                at = 0
                while at < len(sizes):
                    # Up to where the block is full, at least one sequence.
                    room = np.cumsum(sizes[at:]) + n_turns
                    take = int(min(np.searchsorted(room, BLOCK_TURNS) + 1, BLOCK - n, len(room)))
                    if n and (n >= BLOCK or n_turns >= BLOCK_TURNS):
                        whole = pa.concat_tables(held)
                        pair = pa.concat_tables([whole.slice(n - 1), piece.slice(at, 1)])
                        after = int(common_prefixes(*_flat(pair.column("path").combine_chunks()))[1])
                        yield block(whole, after)
                        held, before, n, n_turns = [], after, 0, 0
                        continue
                    held.append(piece.slice(at, take))
                    n += take
                    n_turns += int(sizes[at : at + take].sum())
                    at += take
        if held:
            yield block(pa.concat_tables(held), edges[part][1])

    found = stored(
        sequences.select("part", "at", "path", "copies", "least_id", "ends")
        .repartition("part")
        .sortWithinPartitions("part", "at")
        .mapInArrow(nodes, _NODES),
        "trie-nodes",
    )
    inner = found.where("NOT at_edge").select(
        "depth", "least_id", "parent_key", "parent_id", "n", "children", "leaves", "saved", "ends"
    )
    digests = _open_digests(in_order.where("path IS NULL"))
    merged = stored(
        found.where("at_edge")
        .groupBy("key")
        .agg(
            F.min("parent_key").alias("parent_key"),
            F.min("depth").alias("depth"),
            F.min("least_id").alias("least_id"),
            *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
            F.max("ends").alias("whole"),
        )
        .join(digests, "key", "left")
        .withColumn("ends", F.coalesce("whole", "open")),
        "trie-merged",
    )
    parents = broadcast_if_small(
        merged.select(F.col("key").alias("parent_key"), F.col("least_id").alias("above"))
    )
    edge = merged.withColumn("parent_id", F.lit(None).cast("long")).select(inner.columns)
    # Most nodes lie below an inner one and have their parent's id already.
    known = inner.where("parent_key IS NULL").withColumn("above", F.lit(None).cast("long"))
    asked = inner.where("parent_key IS NOT NULL").unionByName(edge).join(parents, "parent_key", "left")
    return known.unionByName(asked).select(
        _shown(F.col("least_id")).alias("conv_id"),
        "depth",
        _shown(F.coalesce("parent_id", "above")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )


def _shown(conv_id: Column) -> Column:
    return F.nullif(conv_id, F.lit(NO_ID))


def _open_digests(pieces: DataFrame) -> DataFrame:
    """(key, open): the digest of ids that came in pieces, in order of partition and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"key": pa.array([key], pa.binary()), "open": [digest.hexdigest()]}
            )

        for batch in batches:
            for this, ids in zip(
                batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True
            ):
                if this != key:
                    if key is not None:
                        yield row()
                    key, digest = this, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if key is not None:
            yield row()

    # A digest is taken in sequence by its nature: its ids pass one task, 256 KB at a time.
    return (
        pieces.select("key", "part", "at", "ids")
        .repartition("key")
        .sortWithinPartitions("key", "part", "at")
        .mapInArrow(run, "key binary, open string")
    )


def with_shared_heads(conversations: DataFrame, every: int = 20, longest: int = 4) -> DataFrame:
    """Conversations that begin as the one at the next lower multiple of ``every`` does.

    Of ``longest`` or fewer turns, as many as the checksum of conv_id says, are taken from
    there, if it has them; the same number of own turns go.
    """
    n = F.when(
        F.col("conv_id") == NO_ID, 0
    ).otherwise(F.crc32(F.col("conv_id").cast("string")) % longest).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = conversations.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("path", 1, longest - 1).alias("head")
    )
    own = conversations.select("conv_id", "path", n.alias("n"), base.alias("base"))
    head = F.slice(F.coalesce("head", F.array().cast(_PATH)), F.lit(1), F.col("n"))
    rest = F.slice("path", F.col("n") + 1, F.size("path"))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("path"))

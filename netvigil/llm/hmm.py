"""A hidden Markov language model over words, trained and applied on Spark.

Every word of the training texts has its own emission probabilities, as has the end of a
text; unknown words share one. They come from expected counts E of word w in state s as
(E / q + 1) / (N + V + 1), where q is the state's share of all N tokens and V the number of
known words, so that mixed over states a word has its smoothed frequency (c + 1) / (N + V + 1).

Baum-Welch runs over all training texts: tasks compute expected counts with scaled
forward and backward recursions, and Spark sums them by parts of the vocabulary. The counts of
the ``FREQUENT`` most frequent words are broadcast; those of all others travel between their
parts and the blocks of texts that use them, without the words: a block lists its rare words in
order of the parts, and ``place`` gives their places there once. Their counts travel as whole
numbers with the shares of the states in them, which are rounded to 16-bit floating point; q is
of the rounded ones, so that emissions add up as before. Symbols are kept and sent compressed.
Rounds go on until the log-likelihood of the training texts gains less than ``TOLERANCE`` of
itself. Counts of two rounds are kept, and a round's shuffle files go when it ends. Recursions
of the training are of 32-bit numbers, those of the scores of 64 bits.
A text's score is the exact likelihood from the scaled
forward recursion over all its tokens.

Training cuts texts at ``CUT`` tokens, each piece beginning anew; nothing is left out and
scoring doesn't cut. Null text is empty and has one token, the end. A null ``doc_id`` hashes
as the empty string. Repeated rows count and are scored as often as they occur; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netvigil.llm.bytesets import groups, text_bytes
from netvigil.llm.common import ship, stored, tidy
from netvigil.session import work_path

# Words whose counts tasks hold; the counts of all others are joined.
FREQUENT = 65_536
END = FREQUENT
CLASSES = END + 1  # symbols that mean the same in all blocks
STATES = 8
TOLERANCE = 1e-4
MOST_ROUNDS = 60
CUT = 1 << 16
FLUSH_WORDS = 300_000
STEP_TOKENS = 1 << 19
BLOCK = 1 << 25  # bytes of text that share a list of rare words
PART_KINDS = 1 << 17
RANGE = 1 << 10  # frequent symbols whose counts are summed together
NUMBERS = -(1 << 30)
FOLDS = 7
HELD_OUT = 2


def held_out() -> Column:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(key) % FOLDS == HELD_OUT


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) of ``text``; partial counts are made per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                ["word", "c"],
            )

        seen: Counter = Counter()
        for batch in batches:
            for text in text_bytes(batch.column("text")):
                seen.update(text.lower().split())
                if len(seen) >= FLUSH_WORDS:
                    yield flush(seen)
                    seen = Counter()
        yield flush(seen)

    rows = texts.select("text").mapInArrow(run, "word binary, c bigint")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Fixed-size part of the training counts."""

    frequent: dict[bytes, int]  # word -> symbol
    counts: np.ndarray  # of the symbols
    total: int  # N
    kinds: int  # V

    def parts(self) -> int:
        """Parts that rare words are dealt to, so that one has a bounded number of them."""
        return max(8, self.kinds // PART_KINDS)

    def smoothed(self) -> float:
        """What a smoothed count is divided by."""
        return self.total + self.kinds + 1.0


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    top = counts.orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    by_symbol = np.zeros(CLASSES)
    by_symbol[: len(top)] = [c for _, c in top]
    by_symbol[END] = ends
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return Vocabulary(
        {bytes(word): i for i, (word, _) in enumerate(top)},
        by_symbol,
        total + ends,
        kinds + int(ends > 0),
    )


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of their bytes, of which the upper ones hold little."""
    planes = numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)


def encode(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """Stored (block, held_out, ids, sizes, symbols, part, words): texts and rare words of blocks.

    A row holds a block's training texts or its held-out ones: their ids, their numbers of tokens
    and all their ``symbols``, which are a frequent word's, END, or CLASSES and more for rare
    words. Other rows list these: a block's rare words of a part, by number and in order of
    parts. CRC-32 deals words to parts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words.frequent)
    parts = words.parts()
    kind = dict(docs.dtypes)["doc_id"]
    names = ["block", "held_out", "ids", "sizes", "symbols", "part", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for low, high in groups([len(t) for t in texts], BLOCK):
                rare: dict[bytes, int] = {}
                out = []
                for text in texts[low:high]:
                    tokens = text.lower().split()
                    symbols = np.full(len(tokens) + 1, END, np.int32)
                    symbols[:-1] = np.fromiter(
                        map(place.get, tokens, repeat(-1)), np.int32, len(tokens)
                    )
                    others = np.flatnonzero(symbols < 0)
                    symbols[others] = [
                        CLASSES + rare.setdefault(tokens[i], len(rare)) for i in others.tolist()
                    ]
                    out.append(symbols)
                # Rare words get their numbers anew, by part.
                part = np.fromiter(map(crc32, rare), np.int64, len(rare)) % parts
                order = np.argsort(part, kind="stable")
                number = np.arange(CLASSES + len(rare), dtype=np.int32)
                number[CLASSES + order] = number[CLASSES:].copy()
                listed = pa.array(rare, pa.binary()).take(pa.array(order))
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                block = batch.column("row")[low].as_py()
                ids = batch.column("doc_id").slice(low, high - low)
                rows = []
                for is_held in (False, True):
                    which = np.flatnonzero(held[low:high] == is_held)
                    if len(which):
                        sizes = np.array([len(out[i]) for i in which], np.int32)
                        symbols = number[np.concatenate([out[i] for i in which])]
                        rows.append(
                            (is_held, ids.take(pa.array(which)).to_pylist(), sizes.tobytes(), _packed(symbols), None, None)
                        )
                rows += [
                    (None, None, None, None, p, listed[x:y])
                    for p, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                    if x < y
                ]
                held_out, ids_of, sizes, symbols, part_of, lists = zip(*rows, strict=True)
                offsets = np.cumsum([0, *[0 if x is None else len(x) for x in lists]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(rows), pa.int64()),
                        pa.array(held_out, pa.bool_()),
                        pa.array(ids_of, pa.list_(batch.column("doc_id").type)),
                        pa.array(sizes, pa.binary()),
                        pa.array(symbols, pa.binary()),
                        pa.array(part_of, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), listed),
                    ],
                    names,
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        held_out().alias("held_out"),
        "text",
    ).mapInArrow(
        run,
        f"block bigint, held_out boolean, ids array<{kind}>, sizes binary, symbols binary,"
        " part int, words array<binary>",
    )
    return stored(rows, "hmm-encoded")


def place(encoded: DataFrame, counts: DataFrame, words: Vocabulary) -> DataFrame:
    """Stored (block, part, n, at, c): the rare words of a block and part, in the block's order.

    ``at`` holds their places among the training words of the part, -1 if unknown, and ``c``
    their training counts.
    """

    def run(lists: pa.Table, known: pa.Table) -> pa.Table:
        values = known.column("word").combine_chunks()
        seen = np.append(known.column("c").to_numpy(), 0)
        rows = []
        for found in lists.column("words").combine_chunks():
            at = pc.fill_null(pc.index_in(found.values, value_set=values), -1).to_numpy()
            rows.append((len(at), _packed(at), _packed(seen[at])))
        n, at, c = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.Table.from_arrays(
            [
                lists.column("block"),
                lists.column("part"),
                pa.array(n, pa.int32()),
                pa.array(at, pa.binary()),
                pa.array(c, pa.binary()),
            ],
            names=["block", "part", "n", "at", "c"],
        )

    part = (F.crc32("word") % words.parts()).cast("int")
    rows = (
        encoded.where("part IS NOT NULL")
        .select("block", "part", "words")
        .groupBy("part")
        .cogroup(counts.select(part.alias("of_part"), "word", "c").groupBy("of_part"))
        .applyInArrow(run, "block bigint, part int, n int, at binary, c binary")
    )
    return stored(rows, "hmm-places")


@dataclass
class Model:
    start: np.ndarray  # S
    move: np.ndarray  # S x S
    emit: np.ndarray  # symbols x S


def first_model(words: Vocabulary, states: int, seed: int) -> Model:
    """States that tend to stay and prefer different random words."""
    random = np.random.default_rng(seed)
    frequency = (words.counts + (words.counts > 0)) / words.smoothed()
    emit = frequency[:, None] * random.gamma(2.0, 0.5, (CLASSES, states))
    emit *= frequency.sum() / np.maximum(emit.sum(axis=0), 1e-300)
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1.0 / states), move, emit)


class Lanes:
    """Sequences, long ones first, that are stepped through together, one to a lane.

    Lanes end with their sequences, so that the open ones are always the first. Arrays hold
    all open lanes of a step, then those of the next. Numbers are of the kind of the emissions.
    """

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences])
        self.order = np.argsort(-sizes, kind="stable")
        # How many lanes are open at each step, and where the steps begin.
        self.open = len(sizes) - np.cumsum(np.bincount(sizes))[:-1]
        self.begin = np.concatenate([[0], np.cumsum(self.open)])
        self.symbols = np.empty(self.begin[-1], np.int64)
        for lane, i in enumerate(self.order):
            self.symbols[self.begin[: sizes[i]] + lane] = sequences[i]

    def emissions(self, model: Model) -> np.ndarray:
        """Of the symbols at all steps, by state."""
        return np.ascontiguousarray(model.emit.take(self.symbols, axis=0).T)

    def forward(self, model: Model, emit: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        """Scales of all steps; ``alpha`` gets the scaled forward probabilities by state, and
        may be ``emit``, which it then replaces."""
        move = np.ascontiguousarray(model.move.T)
        scales = np.empty(len(self.symbols), emit.dtype)
        before = None
        for begin, end in zip(self.begin[:-1].tolist(), self.begin[1:].tolist(), strict=True):
            come = model.start[:, None] if before is None else move @ before[:, : end - begin]
            here = np.multiply(emit[:, begin:end], come, out=alpha[:, begin:end])
            here /= here.sum(axis=0, out=scales[begin:end])
            before = here
        return scales

    def log_likelihoods(self, model: Model) -> np.ndarray:
        """log10 of each sequence's probability."""
        emit = self.emissions(model)
        scales = self.forward(model, emit, emit)
        lane = np.arange(len(scales)) - np.repeat(self.begin[:-1], self.open)
        logs = np.empty(len(self.order))
        logs[self.order] = np.bincount(lane, np.log10(scales), len(logs))
        return logs

    def expectations(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions."""
        return self.expectations_and_log(model)[:3]

    def expectations_and_log(self, model: Model):
        """Expected counts, and log10 of the probability of all sequences."""
        emit = self.emissions(model)
        alpha = np.empty_like(emit)
        scales = self.forward(model, emit, alpha)
        emit /= scales
        beta = np.ones_like(emit)
        for step in range(len(self.open) - 1, 0, -1):
            begin, at, end = self.begin[step - 1 : step + 2].tolist()
            after = emit[:, at:end]
            after *= beta[:, at:end]
            np.matmul(model.move, after, out=beta[:, begin : begin + end - at])
        first = self.open[0]
        # The same lane, a step before.
        before = np.arange(first, len(self.symbols)) - np.repeat(self.open[:-1], self.open[1:])
        moves = np.stack([emit[:, first:] @ row.take(before) for row in alpha]) * model.move
        # alpha becomes the probability of each state given the whole sequence
        alpha *= beta
        emitted = np.stack([np.bincount(self.symbols, row, len(model.emit)) for row in alpha])
        starts = alpha[:, :first].sum(axis=1)
        return starts, moves, emitted, float(np.log10(scales).sum(dtype=float))


def _packs(texts: list[np.ndarray], cut: int | None) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """The symbols of a block's texts, long ones first, in packs of about STEP_TOKENS tokens.

    Sequences of like length share a pack, so that many can be stepped through together.
    """
    found = []
    for i, symbols in enumerate(texts):
        step = cut or len(symbols)
        found.extend((i, symbols[at : at + step]) for at in range(0, len(symbols), step))
    found.sort(key=lambda x: -len(x[1]))
    rows, pieces, total = [], [], 0
    for i, piece in found:
        rows.append(i)
        pieces.append(piece)
        total += len(piece)
        if total >= STEP_TOKENS:
            yield rows, pieces
            rows, pieces, total = [], [], 0
    if rows:
        yield rows, pieces


def _texts(row: dict) -> list[np.ndarray]:
    sizes = np.frombuffer(row["sizes"], np.int32)
    symbols = _unpacked(row["symbols"], int(sizes.sum()), np.int32)
    return np.split(symbols, np.cumsum(sizes)[:-1])


def _blocks(encoded: DataFrame, places: DataFrame, held: bool) -> DataFrame:
    """The rows of texts, if ``held`` of held-out ones too, and the places of blocks."""
    texts = encoded.where("part IS NULL" if held else "part IS NULL AND NOT held_out")
    return texts.select("block", "held_out", "ids", "sizes", "symbols").unionByName(
        places, allowMissingColumns=True
    )


def _block_model(model: Model, share: np.ndarray, smoothed: float, rows: list[dict], sums: pa.Table):
    """The model with the block's rare words, and (part, at) of these, in order.

    Before the first round there are no ``sums``: rare words begin without a preference.
    """
    states = len(share)
    rows = sorted((r for r in rows if r["part"] is not None), key=lambda r: r["part"])
    of_part = dict(zip(sums.column("part").to_pylist(), sums.column("numbers").to_pylist(), strict=True))
    emit, found = [model.emit], []
    for r in rows:
        at, c = _unpacked(r["at"], r["n"], np.int32), _unpacked(r["c"], r["n"], np.int64)
        shares = np.full((r["n"], states), 1.0 / states)
        if r["part"] in of_part:
            shares[at >= 0] = np.frombuffer(of_part[r["part"]], np.float16).reshape(-1, states)
        emit.append((c[:, None] * shares / share + 1.0) / smoothed)
        found.append((r["part"], at))
    return Model(model.start, model.move, np.concatenate(emit)), found


def _shares(expected: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of the states in the counts of words, as 16-bit floating point numbers."""
    return (expected / np.maximum(c, 1)[:, None]).astype(np.float16)


_SUMS = "block bigint, part int, at binary, c binary, numbers binary"


def _sums(rows: DataFrame, states: int) -> DataFrame:
    """Numbers of all blocks added up by part; shares of its words' counts for each block.

    Blocks send (at, c, shares) of words, and (at, sums) of frequent symbols they use. Rows without a block hold 64-bit sums: of the part's
    words together, or what negative parts hold: the symbols from (-1 - part) * RANGE, and as
    NUMBERS the likelihood, starts and moves.
    """

    def add(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        part, total, seen, found = key[0].as_py(), np.zeros((0, states)), np.zeros(0, np.int64), []
        if NUMBERS < part < 0:
            total = np.zeros((RANGE, states))
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("block", "at", "c", "numbers")]
            for block, at, c, numbers in zip(*columns, strict=True):
                if part == NUMBERS:
                    numbers = np.frombuffer(numbers, np.float64).reshape(-1, states)
                    total = numbers if not len(total) else total + numbers
                    continue
                at = np.frombuffer(at, np.int32)
                if part < 0:
                    total[at] += np.frombuffer(numbers, np.float32).reshape(-1, states)
                    continue
                c = _unpacked(c, len(at), np.int32)
                if len(at) and at.max() >= len(total):
                    more = at.max() + 1 - len(total)
                    total = np.concatenate([total, np.zeros((more, states))])
                    seen = np.concatenate([seen, np.zeros(more, np.int64)])
                # a block has a word once
                total[at] += c[:, None] * np.frombuffer(numbers, np.float16).reshape(-1, states)
                seen[at] += c
                found.append((block, at))
        rows = [(None, total.tobytes())]
        if part >= 0:
            shares = _shares(total, seen)
            rows = [(None, (seen[:, None] * shares.astype(float)).sum(axis=0).tobytes())]
            rows += [(block, shares[at].tobytes()) for block, at in found]
        blocks, numbers = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(blocks, pa.int64()),
                pa.array([part] * len(rows), pa.int32()),
                pa.nulls(len(rows), pa.binary()),
                pa.nulls(len(rows), pa.binary()),
                pa.array(numbers, pa.binary()),
            ],
            ["block", "part", "at", "c", "numbers"],
        )

    return rows.groupBy("part").applyInArrow(add, _SUMS)


def train(
    encoded: DataFrame,
    words: Vocabulary,
    places: DataFrame,
    states: int,
    rounds: int | None,
    seed: int,
) -> tuple[Model, np.ndarray, DataFrame]:
    """The model of frequent words, the states' shares, and the expected counts of all words.

    ``rounds`` ends training before it has settled; without it, training that has not
    settled after ``MOST_ROUNDS`` ends there with a warning. Without any training token no
    round is run, and every emission is (0 + 1) / (0 + 0 + 1).
    """
    spark = encoded.sparkSession
    model, share = first_model(words, states, seed), np.full(states, 1.0 / states)
    expected = spark.createDataFrame([], _SUMS)
    paths = [work_path(spark, "hmm-expected") for _ in range(2)]  # this round's and the last one's
    smoothed = words.smoothed()
    if not words.total:
        model = Model(model.start, model.move, np.ones_like(model.emit))
    before, settled = None, not words.total
    for number in range(0 if settled else MOST_ROUNDS if rounds is None else rounds):
        shared = spark.sparkContext.broadcast((model, share))

        def run(docs: pa.Table, sums: pa.Table) -> pa.Table:
            blocks = docs.to_pylist()
            model, found = _block_model(*shared.value, smoothed, blocks, sums)
            model = Model(*[x.astype(np.float32) for x in (model.start, model.move, model.emit)])
            logs, starts, moves = np.zeros((1, states)), np.zeros(states), np.zeros((states, states))
            emitted = np.zeros((states, len(model.emit)))
            for row in blocks:
                for _, pieces in _packs(_texts(row), CUT) if row["part"] is None else ():
                    s, m, e, log = Lanes(pieces).expectations_and_log(model)
                    starts, moves, logs[0, 0] = starts + s, moves + m, logs[0, 0] + log
                    emitted += e
                    del e
            emitted = emitted.T
            rows = [(NUMBERS, None, None, np.concatenate([logs, [starts], moves]).tobytes())]
            for i, x in enumerate(range(0, CLASSES, RANGE)):
                numbers = emitted[x : min(CLASSES, x + RANGE)].astype(np.float32)
                used = np.flatnonzero(numbers.any(axis=1)).astype(np.int32)
                rows.append((-1 - i, used.tobytes(), None, numbers[used].tobytes()))
            begin = CLASSES
            for part, at in found:
                numbers = emitted[begin : begin + len(at)][at >= 0]
                c = np.rint(numbers.sum(axis=1)).astype(np.int32)
                rows.append((part, at[at >= 0].tobytes(), _packed(c), _shares(numbers, c).tobytes()))
                begin += len(at)
            part, at, c, numbers = zip(*rows, strict=True)
            return pa.Table.from_arrays(
                [
                    pa.array([blocks[0]["block"]] * len(rows), pa.int64()),
                    pa.array(part, pa.int32()),
                    pa.array(at, pa.binary()),
                    pa.array(c, pa.binary()),
                    pa.array(numbers, pa.binary()),
                ],
                names=["block", "part", "at", "c", "numbers"],
            )

        sums = _sums(
            _blocks(encoded, places, held=False)
            .groupBy("block")
            .cogroup(_of_blocks(expected))
            .applyInArrow(run, _SUMS),
            states,
        )
        path = paths[number % 2]
        with tidy(spark):
            sums.write.mode("overwrite").parquet(path)
        expected = spark.read.schema(_SUMS).parquet(path)
        shared.unpersist()
        whole, table = np.zeros(states), np.zeros((CLASSES, states))
        # as many rows as parts, and 4 MB of frequent words
        for part, numbers in expected.where("block IS NULL").select("part", "numbers").collect():
            numbers = np.frombuffer(numbers, np.float64).reshape(-1, states)
            if part == NUMBERS:
                log, starts, moves = numbers[0, 0], numbers[1] + 0.1, numbers[2:] + 0.1
            elif part < 0:
                begin = (-1 - part) * RANGE
                table[begin : begin + RANGE] = numbers[: CLASSES - begin]
            if part != NUMBERS:
                whole += numbers.sum(axis=0)
        share = np.maximum(whole, 1e-6) / words.total
        model = Model(
            starts / starts.sum(),
            moves / moves.sum(axis=1, keepdims=True),
            (table / share + 1.0) / smoothed,
        )
        settled = before is not None and log - before <= TOLERANCE * abs(before)
        if settled:
            break
        before = log
    if rounds is None and not settled:
        warnings.warn(f"training has not settled after {MOST_ROUNDS} rounds", stacklevel=2)
    return model, share, expected


def _of_blocks(expected: DataFrame):
    known = expected.where("block IS NOT NULL")
    return known.select(F.col("block").alias("of_block"), "part", "numbers").groupBy("of_block")


def score(
    docs: DataFrame, states: int = STATES, rounds: int | None = None, seed: int = 5
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship(spark)
    training = docs.where(~held_out())
    with tidy(spark):
        counts = stored(count_words(training), "hmm-counts")
        words = vocabulary(counts, training.count())
    encoded = encode(docs, words)
    with tidy(spark):
        places = place(encoded, counts, words)
    model, share, expected = train(encoded, words, places, states, rounds, seed)
    shared = spark.sparkContext.broadcast((model, share, words.counts))
    smoothed, words_total = words.smoothed(), int(words.total)
    kind = dict(docs.dtypes)["doc_id"]

    def run(docs: pa.Table, sums: pa.Table) -> pa.Table:
        model, share, seen = shared.value
        blocks = docs.to_pylist()
        model, _ = _block_model(model, share, smoothed, blocks, sums)
        listed = sorted((r for r in blocks if r["part"] is not None), key=lambda r: r["part"])
        seen = np.concatenate([seen, *[_unpacked(r["c"], r["n"], np.int64) for r in listed]])
        logs = np.log10(seen + 1.0) - math.log10(smoothed)
        ids, of_held, found = [], [], []
        for row in blocks:
            if row["part"] is None:
                ids += row["ids"]
                of_held += [row["held_out"]] * len(row["ids"])
                found += _texts(row)
        hidden = np.zeros(len(found))
        for rows, pieces in _packs(found, None):
            hidden[rows] = Lanes(pieces).log_likelihoods(model)
        return pa.Table.from_arrays(
            [
                pa.array(ids, docs.schema.field("ids").type.value_type),
                pa.array(of_held, pa.bool_()),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([int((seen[x] > 0).sum()) for x in found], pa.int64()),
                pa.array([words_total] * len(found), pa.int64()),
                pa.array([float(logs[x].sum()) for x in found], pa.float64()),
                pa.array(hidden),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return (
        _blocks(encoded, places, held=True)
        .groupBy("block")
        .cogroup(_of_blocks(expected))
        .applyInArrow(
            run,
            f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint,"
            " train_tokens bigint, base_score double, score double",
        )
    )

"""Periodic runs: stretches of words that repeat with a period, found by block convolution.

A run of period q holds, at the scale of its period, a whole aligned block of B words whose
copy q words later lies in the run as well. At every dyadic B each block is slid over the
window behind it, and the sum of squared differences of word codes is taken for all places
at once, as sums of squares less twice a correlation, by a number-theoretic transform. The
codes are folded to a range in which that sum stays below the modulus, so it is the exact
integer: it is zero where the folded words agree, and those places are compared word by
word. Blocks that agree at one distance one after another are the seed of a run; its ends
lie less than a block beyond them and are found by comparison.

A block takes part only if each of its words comes again within the window, and not if
block and window lie in a known run of at most half a block's period: all it could find is
that run at a multiple of its period. Neither rule loses a run.

Words are split at space and \\t to \\r and compared as bytes. A null or empty text has no
words, no runs and an empty collapsed text. A text is worked on whole, within one task;
several short ones are worked on together. Repeated rows are answered separately, an empty
table gives no rows, and other columns are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.bytesets import groups, mix, text_bytes
from netvigil.llm.common import ship

MODULUS = 7 * 2**26 + 1  # a prime: there are transforms of every length up to 2**26
GENERATOR = 3
MIN_WORDS = 12
CHUNK = 1 << 20  # numbers in one step
TEXT = 2 << 20  # bytes of text worked on together
FAR = np.iinfo(np.int64).max


@cache
def _roots(half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order 2 * half."""
    root = pow(GENERATOR, (MODULUS - 1) // (2 * half), MODULUS)
    if inverse:
        root = pow(root, MODULUS - 2, MODULUS)
    powers = np.ones(1, np.uint64)
    while len(powers) < half:
        step = np.uint64(pow(root, len(powers), MODULUS))
        powers = np.concatenate([powers, powers * step % np.uint64(MODULUS)])
    return powers


def _transform(a: np.ndarray) -> None:
    """Each row to its values at the roots of unity, in bit-reversed order, in place."""
    p = np.uint64(MODULUS)
    half = a.shape[1] // 2
    while half:
        pair = a.reshape(len(a), -1, 2, half)
        low, high = pair[:, :, 0].copy(), pair[:, :, 1]
        pair[:, :, 0] = (low + high) % p
        pair[:, :, 1] = (low + p - high) * _roots(half, False) % p
        half //= 2


def _invert(a: np.ndarray) -> None:
    """The reverse of ``_transform``."""
    p = np.uint64(MODULUS)
    half = 1
    while half < a.shape[1]:
        pair = a.reshape(len(a), -1, 2, half)
        low, high = pair[:, :, 0].copy(), pair[:, :, 1] * _roots(half, True) % p
        pair[:, :, 0] = (low + high) % p
        pair[:, :, 1] = (low + p - high) % p
        half *= 2
    a *= np.uint64(pow(a.shape[1], MODULUS - 2, MODULUS))
    a %= p


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Per row and place j: the sum of (window[j + i] - block[i])**2, if below the modulus.

    ``windows`` are a power of two wide; places run to the last one at which a block fits.
    """
    p = np.uint64(MODULUS)
    size, width = blocks.shape[1], windows.shape[1]
    turned = np.zeros_like(windows)
    turned[:, 0] = blocks[:, 0]
    turned[:, width - size + 1 :] = blocks[:, :0:-1]
    product = windows.copy()
    _transform(product)
    _transform(turned)
    product = product * turned % p
    _invert(product)
    squares = np.zeros((len(windows), width + 1), np.uint64)
    np.cumsum(windows * windows, axis=1, out=squares[:, 1:])
    both = squares[:, size:] - squares[:, : width - size + 1]
    both += (blocks * blocks).sum(axis=1, dtype=np.uint64)[:, None]
    return (both + np.uint64(2) * (p - product[:, : width - size + 1])) % p


def _gaps(ids: np.ndarray) -> np.ndarray:
    """How far on each word comes again."""
    order = np.argsort(ids, kind="stable")
    gap = np.full(len(ids), FAR)
    again = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return gap


def _agree(ids: np.ndarray, at: np.ndarray, distance: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Whether the words at ``at + step`` and ``distance`` later are equal: a row per place."""
    here = at[:, None] + step
    there = here + distance[:, None]
    inside = (here >= 0) & (there < len(ids))
    return inside & (ids[np.where(inside, here, 0)] == ids[np.where(inside, there, 0)])


def _stretch(
    ids: np.ndarray, at: np.ndarray, distance: np.ndarray, size: int, step: int
) -> np.ndarray:
    """How many words from ``at`` on, at most ``size``, equal the ones ``distance`` later."""
    steps = np.arange(size) * step
    found = np.empty(len(at), np.int64)
    rows = max(1, CHUNK // size)
    for i in range(0, len(at), rows):
        cut = slice(i, i + rows)
        equal = _agree(ids, at[cut], distance[cut], steps)
        found[cut] = np.where(equal.all(axis=1), size, np.argmin(equal, axis=1))
    return found


def _seeds(
    ids: np.ndarray, blocks: np.ndarray, size: int, low: int, high: int
) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance): blocks that occur again ``distance`` words later."""
    width = 4 * size
    codes = mix(ids.astype(np.uint64)) % np.uint64(math.isqrt((MODULUS - 1) // size))
    codes = np.concatenate([codes, np.zeros(low + width, np.uint64)])
    starts, distances = [], []
    rows = max(1, CHUNK // width)
    for i in range(0, len(blocks), rows):
        at = blocks[i : i + rows] * size
        block = codes[at[:, None] + np.arange(size)]
        window = codes[at[:, None] + low + np.arange(width)]
        row, place = np.nonzero(squared_differences(block, window)[:, : high - low + 1] == 0)
        starts.append(at[row])
        distances.append(low + place)
    return np.concatenate(starts), np.concatenate(distances)


def find_runs(ids: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """(start, length, period) of all runs of at least two periods and ``min_words`` words,
    by start and period, one row each."""
    if min_words < MIN_WORDS:
        raise ValueError(f"runs are found from {MIN_WORDS} words on")
    n = len(ids)
    gap = _gaps(ids)
    known = np.zeros((0, 3), np.int64)
    size = 2
    while True:
        low, high = (1, 7) if size == 2 else (2 * size, 4 * size - 1)
        if 2 * low > n:
            break
        n_blocks = n // size
        at = np.arange(n_blocks) * size
        # Where the run of a short period that holds a block ends; there is at most one.
        covered = np.zeros(n_blocks, np.int64)
        for start, length, _ in known[(2 * known[:, 2] <= size) & (known[:, 1] >= size)]:
            covered[-(-start // size) : (start + length) // size] = start + length
        near = gap[: n_blocks * size].reshape(n_blocks, size).max(axis=1) <= high
        blocks = np.flatnonzero(near & (covered < at + high + size))
        if len(blocks):
            start, distance = _seeds(ids, blocks, size, low, high)
            end = start + distance + size
            open_ = (end <= n) & (covered[start // size] < end)
            start, distance = start[open_], distance[open_]
            equal = _stretch(ids, start, distance, size, 1) == size
            start, distance = start[equal], distance[equal]
            if len(start):
                order = np.lexsort((start, distance))
                start, distance = start[order], distance[order]
                breaks = (distance[1:] != distance[:-1]) | (start[1:] - start[:-1] != size)
                first = start[np.concatenate([[True], breaks])]
                last = start[np.concatenate([breaks, [True]])]
                period = distance[np.concatenate([[True], breaks])]
                begin = first - _stretch(ids, first - 1, period, size, -1)
                end = last + size + _stretch(ids, last + size, period, size, 1)
                length = end - begin + period
                found = np.stack([begin, length, period], axis=1)
                found = found[length >= np.maximum(min_words, 2 * period)]
                known = np.concatenate([known, found])
                # One stretch of words has all multiples of its period: the least counts.
                known = known[np.lexsort((known[:, 2], known[:, 1], known[:, 0]))]
                same = (known[1:, :2] == known[:-1, :2]).all(axis=1)
                known = known[np.concatenate([[True], ~same])] if len(known) else known
        size *= 2
    return known[np.lexsort((known[:, 2], known[:, 0]))]


def _word_ids(texts: list[list[bytes]]) -> np.ndarray:
    """Numbers for words; those of different texts differ, so that no run crosses texts."""
    ids: list[int] = []
    base = 0
    for words in texts:
        seen: dict[bytes, int] = {}
        ids += [seen.setdefault(word, base + len(seen)) for word in words]
        base += len(seen)
    return np.array(ids, np.int64)


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but for those that repeat an earlier period of a run."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join([words[i] for i in kept])


ADDED = ("n_words", "runs", "collapsed")
_KINDS = (
    "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
)


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of ``docs`` but ``text``, with n_words, runs (start, length, period, by start
    and period) and collapsed: the words left when each run keeps its first period only."""
    ship(docs.sparkSession)
    carried = [c for c in docs.columns if c not in ("text", *ADDED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for low, high in groups([len(t) for t in texts], TEXT):
                words = [text.split() for text in texts[low:high]]
                ends = np.cumsum([len(w) for w in words])
                found = find_runs(_word_ids(words), min_words)
                owner = np.searchsorted(ends, found[:, 0], side="right")
                found[:, 0] -= (ends - [len(w) for w in words])[owner]
                cuts = np.searchsorted(owner, np.arange(len(words) + 1))
                runs = pa.StructArray.from_arrays(
                    [pa.array(found[:, i]) for i in range(3)], ["start", "length", "period"]
                )
                short = [
                    collapse(w, found[cuts[i] : cuts[i + 1]]).decode() for i, w in enumerate(words)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row")[low:high],
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs),
                        pa.array(short, pa.string()),
                    ],
                    ["row", *ADDED],
                )

    rows = docs.select("text", F.struct(*[F.col(c) for c in carried]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, {_KINDS}").select("row.*", *ADDED)

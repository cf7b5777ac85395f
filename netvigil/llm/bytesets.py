"""Texts of an Arrow batch as one byte array, and rolling hashes over it.

Hashes are polynomials modulo 2**64 over bytes that a fixed random table has mapped to
64-bit values; a hash of any stretch follows from running sums, so that one pass over the
bytes serves all stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_TABLE = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + np.uint64((salt * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Running sums over ``data``; ``of(start, end)`` hashes stretches."""

    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        cls = Rolling
        if len(cls._powers) < n:
            cls._powers = np.full(n, _BASE, np.uint64)
            cls._inverses = np.full(n, _INVERSE, np.uint64)
            cls._powers[0] = cls._inverses[0] = 1
            np.cumprod(cls._powers, out=cls._powers)
            np.cumprod(cls._inverses, out=cls._inverses)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_TABLE[data] * cls._powers[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * Rolling._inverses[start]

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all stretches of ``width`` bytes."""
        n = max(0, len(self.sums) - width)
        return (self.sums[width:] - self.sums[:n]) * Rolling._inverses[:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts that hold about ``most`` bytes together."""
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield at, i
            at, total = i, 0
        total += size + 1
    if at < len(sizes):
        yield at, len(sizes)


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's bigint."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))

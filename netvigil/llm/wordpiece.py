"""Greedy word-piece lengths by a linear longest-match automaton.

The pieces form a trie over bytes. A node's failure link leads to where matching goes on
when no longer piece fits, and the number of pieces popped on the way is stored with it,
so a word is counted in one pass over its bytes and no piece is built. The automaton is
built once on the driver, from a vocabulary of bounded size, and broadcast.

A word that cannot be split counts as one token and one unknown word. Null text has no
words; repeated rows are counted separately; an empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from netvigil.llm.bytesets import text_bytes
from netvigil.llm.common import ship

CACHED_WORDS = 400_000
MAX_PIECES = 1_000_000


class Automaton:
    """``start``: pieces that may begin a word; ``rest``: pieces that go on (default: the same)."""

    def __init__(self, start: Iterable[bytes], rest: Iterable[bytes] | None = None):
        self.moves: dict[int, int] = {}
        self.fail: list[int] = [-1]
        self.popped: list[int] = [0]
        self.parent: list[tuple[int, int]] = [(-1, 0)]
        pieces: set[int] = set()
        for piece in start:
            self._insert(0, piece, pieces)
        self.rest = 0
        if rest is not None:
            self.rest = self._node(-1, 0)
            for piece in rest:
                self._insert(self.rest, piece, pieces)
        if len(pieces) > MAX_PIECES:
            raise ValueError("too large a vocabulary to broadcast")
        self._link(pieces)

    def _node(self, parent: int, byte: int) -> int:
        self.fail.append(-1)
        self.popped.append(0)
        self.parent.append((parent, byte))
        return len(self.fail) - 1

    def _insert(self, root: int, piece: bytes, pieces: set[int]) -> None:
        node = root
        for byte in piece:
            to = self.moves.get(node << 8 | byte)
            if to is None:
                to = self.moves[node << 8 | byte] = self._node(node, byte)
            node = to
        if node != root:
            pieces.add(node)

    def _link(self, pieces: set[int]) -> None:
        """Failure links, shorter nodes first."""
        children: dict[int, list[int]] = {}
        for node, (parent, _) in enumerate(self.parent):
            if parent >= 0:
                children.setdefault(parent, []).append(node)
        queue = deque([0] if self.rest == 0 else [0, self.rest])
        while queue:
            node = queue.popleft()
            queue.extend(children.get(node, ()))
            parent, byte = self.parent[node]
            if parent < 0:
                continue
            if node in pieces:
                self.fail[node], self.popped[node] = self.rest, 1
                continue
            at, count = self.fail[parent], self.popped[parent]
            while at >= 0 and (at << 8 | byte) not in self.moves:
                count += self.popped[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.popped[node] = self.moves[at << 8 | byte], count

    def length(self, word: bytes) -> int:
        """Pieces of the greedy longest match, or -1 if the word cannot be split."""
        moves, fail, popped = self.moves, self.fail, self.popped
        node = count = 0
        for byte in word:
            to = moves.get(node << 8 | byte)
            while to is None:
                count += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
                to = moves.get(node << 8 | byte)
            node = to
        while node not in (0, self.rest):
            count += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return count


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a rank file: a base64 piece and its rank per line."""
    lines = Path(path).read_bytes().splitlines()
    return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def count_tokens(docs: DataFrame, automaton: Automaton, prefix: bytes = b"") -> DataFrame:
    """Per row: doc_id, n_words, n_tokens, n_unknown. ``prefix`` stands before every word, as
    vocabularies do that mark the beginning of a word by a space."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = shared.value.length
        known: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for text in text_bytes(batch.column("text")):
                words = text.split()
                tokens = unknown = 0
                for word in words:
                    n = known.get(word)
                    if n is None:
                        if len(known) >= CACHED_WORDS:
                            known.clear()
                        n = known[word] = length(prefix + word)
                    if n < 0:
                        unknown += 1
                        n = 1
                    tokens += n
                rows.append((len(words), tokens, unknown))
            numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *numbers], ["doc_id", "n_words", "n_tokens", "n_unknown"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint"
    )

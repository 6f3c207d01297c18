"""Word-piece counts by one linear pass of an automaton.

The vocabulary is a trie. A node where a word may stop matching has a failure link to the node at which the
match goes on, and the number of pieces that are finished on the way. Following a word byte by byte and
adding these numbers gives the length of its greedy longest-match tokenisation; no piece is ever built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.llm.tables import mapped

CACHED_WORDS = 400_000


class Automaton:
    """``start`` pieces begin a word, ``inner`` ones go on. Each as bytes, without marks."""

    def __init__(self, start: Iterable[bytes], inner: Iterable[bytes]):
        self.edges: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, start), (1, inner)):
            for piece in pieces:
                node = root
                for byte in piece:
                    below = self.edges[node].get(byte)
                    if below is None:
                        below = len(self.edges)
                        self.edges.append({})
                        self.edges[node][byte] = below
                        ends.append(False)
                    node = below
                ends[node] = ends[node] or bool(piece)
        self.fail = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        line = [0, 1]
        for node in line:
            for byte, below in self.edges[node].items():
                if ends[below]:
                    self.fail[below], self.popped[below] = 1, 1
                else:
                    at, done = self.fail[node], self.popped[node]
                    while at >= 0 and byte not in self.edges[at]:
                        done += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[below], self.popped[below] = self.edges[at][byte], done
                line.append(below)

    def length(self, word: bytes) -> int:
        """Pieces of a word; 1, an unknown word, if the pieces can't make it up, and 0 for no bytes."""
        node, total, edges, fail, popped = 0, 0, self.edges, self.fail, self.popped
        for byte in word:
            while (below := edges[node].get(byte)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = below
        while node > 1:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


def spaced_pieces(tokens: Iterable[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Start and inner pieces of a vocabulary that marks the start of a word by a space."""
    known = list(tokens)
    return [t[1:] for t in known if t[:1] == b" " and t != b" "], [t for t in known if b" " not in t]


def piece_counts(df: DataFrame, start: list[bytes], inner: list[bytes], text: str = "text", words: str = "n_words", pieces: str = "n_tokens") -> DataFrame:
    """``df`` with the number of words and word pieces of each text; words are parted by white space.

    Null, empty and blank texts have 0 of both; columns of these names are replaced. The vocabulary, a fixed
    file of a few MB, is broadcast."""
    sent = df.sparkSession.sparkContext.broadcast((start, inner))

    def make() -> Callable[[pa.Array], pa.Array]:
        length = Automaton(*sent.value).length
        known: dict[str, int] = {}

        def count(found: list[str]) -> int:
            total = 0
            for word in found:
                n = known.get(word)
                if n is None:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    n = known[word] = length(word.encode())
                total += n
            return total

        def one(batch: pa.Array) -> pa.Array:
            split = [(t or "").split() for t in batch.to_pylist()]
            return pa.StructArray.from_arrays([pa.array(list(map(len, split)), pa.int64()), pa.array(list(map(count, split)), pa.int64())], ["words", "pieces"])

        return one

    counted: Column = mapped(make, "struct<words:bigint,pieces:bigint>")(F.col(text))
    return df.withColumn("__counted", counted).withColumns({words: F.col("__counted.words"), pieces: F.col("__counted.pieces")}).drop("__counted")

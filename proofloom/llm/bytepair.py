"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has one valid encoding, and dropping its last token leaves the encoding of a
shorter prefix. So one number per prefix, its last token, holds the encodings of all prefixes. A token
``t`` that ends at ``i`` is the last one exactly when it starts the piece or when the last token before it
stays apart from it, that is, when merging the bytes of the two alone gives the two back.

Appending bytes extends the table; an edit keeps the table up to the edit.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm.tables import joined, kept_for, mapped

UNKNOWN = "�".encode()
NOT_CUT = re.compile(r" (?=\s|$|\Z)")
CACHED_PAIRS, CACHED_WORDS, CACHED_PIECES = 200_000, 150_000, 50_000
CACHED_BYTES = 64
SLICE = 1 << 16
CUT = re.compile(r" (?=\S)")
SHIFT = 24


class Vocabulary:
    """Ranks of byte strings; all 256 single bytes must be among them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        if missing := [b for b in range(256) if bytes((b,)) not in ranks]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.single = [ranks[bytes((b,))] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << SHIFT | right] = rank
        self.ending = ahocorasick.Automaton()
        self.reached: dict[bytes, int] = {}
        for token, rank in ranks.items():
            if self.merged(token) == [rank]:
                self.reached[token] = rank
                self.ending.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ending.make_automaton()
        self.longest = max(map(len, ranks))
        self.apart: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Merges the neighbours of lowest rank, the leftmost first; for a pair of tokens, so short data only."""
        parts = [self.single[b] for b in data]
        get, none = self.pairs.get, 1 << 60
        found = [get(a << SHIFT | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while found and (least := min(found)) != none:
            at = found.index(least)
            parts[at : at + 2] = [least]
            del found[at]
            if at < len(found):
                found[at] = get(least << SHIFT | parts[at + 1], none)
            if at:
                found[at - 1] = get(parts[at - 1] << SHIFT | least, none)
        return parts

    def stay_apart(self, left: int, right: int) -> bool:
        known = self.apart.get(left << SHIFT | right)
        if known is None:
            known = left << SHIFT | right not in self.pairs and self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self.apart) > CACHED_PAIRS:
                self.apart.clear()
            self.apart[left << SHIFT | right] = known
        return known


class AskedPrefixes:
    """The last tokens of those prefixes of a short piece that the end of the piece depends on."""

    def __init__(self, vocabulary: Vocabulary, data: bytes):
        self.vocabulary, self.data = vocabulary, data
        self.last: dict[int, tuple[int, int]] = {}

    def at(self, end: int) -> int:
        """Tries the tokens that end here, the longest first, against the last token before each."""
        data, last, token_of, known = self.data, self.last, self.vocabulary.reached, self.vocabulary.apart
        for start in range(max(0, end - self.vocabulary.longest), end):
            piece = data[start:end]
            if piece in token_of:
                token = token_of[piece]
                if start:
                    before = last[start][0] if start in last else self.at(start)
                    pair = before << SHIFT | token
                    if not (known[pair] if pair in known else self.vocabulary.stay_apart(before, token)):
                        continue
                last[end] = token, start
                return token
        raise ValueError("no token ends here")

    def ids(self) -> list[int]:
        end, out = len(self.data), []
        if end:
            self.at(end)
        while end:
            token, end = self.last[end]
            out.append(token)
        return out[::-1]


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Tries the tokens that end at each new byte, the longest first; one of them is the last one."""
        self.data += more
        last, known, apart = self.last, self.vocabulary.apart, self.vocabulary.stay_apart
        done = len(last)
        skip = max(0, done - 1 - self.vocabulary.longest)
        for at, (token, size) in self.vocabulary.ending.iter(self.data[skip:].decode("latin-1")):
            end = at + skip + 1
            if end < done:
                continue
            if end != size:
                before = last[end - size]
                try:
                    fits = known[before << SHIFT | token]
                except KeyError:
                    fits = apart(before, token)
                if not fits:
                    continue
            last.append(token)
            done += 1

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Puts ``new`` in place of the bytes from start to stop; what stands before keeps its table."""
        rest = new + self.data[stop:]
        self.data = self.data[:start]
        del self.last[start + 1 :]
        self.append(rest)

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        end, out = len(self.data) if end is None else end, []
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Recent:
    """What was met lately: when the newer half is full it becomes the older one, and what is asked for again moves on."""

    def __init__(self, size: int):
        self.size = size
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def put(self, key: str, value: bytes) -> None:
        if len(self.newer) >= self.size:
            self.older = self.newer.copy()
            self.newer.clear()
        self.newer[key] = value

    def again(self, key: str) -> bytes | None:
        value = self.older.get(key)
        if value is not None:
            self.put(key, value)
        return value


class TextEncoder:
    """Encodes whole texts, each match of the pattern by itself. As in the public library, a match that is
    a token as a whole takes its id; ranks without such odd tokens give the merged encoding either way.

    ``spaced`` says that the pattern always parts a text before a space that something else than white space
    follows. Texts are then cut there first, and the pattern is applied to new words only."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, spaced: bool = False):
        self.vocabulary = Vocabulary(ranks)
        self.split: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.spaced = spaced
        self.known = Recent(CACHED_PIECES)
        self.words = Recent(CACHED_WORDS)

    def piece(self, text: str) -> bytes:
        packed = self.known.again(text)
        if packed is not None:
            return packed
        # A word that also stands alone is kept among the words.
        packed = self.words.newer.get(text[1:]) if text[0] == " " and text[1:].isalpha() else None
        if packed is not None:
            return packed
        packed = self.coded(text)
        if len(text) <= CACHED_BYTES:
            self.known.put(text, packed)
        return packed

    def coded(self, text: str) -> bytes:
        data = text.encode()
        whole = self.vocabulary.ranks.get(data)
        if whole is None:
            ids = (AskedPrefixes if len(data) <= CACHED_BYTES else PrefixTable)(self.vocabulary, data).ids()
        else:
            ids = [whole]
        return struct.pack(f"<{len(ids)}i", *ids)

    def by_pattern(self, text: str) -> bytes:
        return self.pieces(self.split(text))

    def pieces(self, parts: Iterable[str]) -> bytes:
        known, piece = self.known.newer.get, self.piece
        return b"".join([known(p) or piece(p) for p in parts])

    def word(self, text: str) -> bytes:
        packed = self.words.again(text)
        if packed is None:
            parts = self.split(" " + text)
            # A word of one piece is kept once, as a word.
            packed = self.coded(parts[0]) if len(parts) == 1 else self.pieces(parts)
            if len(text) <= CACHED_BYTES:
                self.words.put(text, packed)
        return packed

    def packed(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers. A long text is taken in slices where it may be cut."""
        if not self.spaced:
            return self.by_pattern(text)
        if len(text) <= SLICE:
            return self.by_words(text)
        out, begin = [], 0
        while begin < len(text):
            cut = CUT.search(text, begin + SLICE)
            end = cut.start() if cut else len(text)
            out.append(self.by_words(text[begin:end]))
            begin = end
        return b"".join(out)

    def by_words(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        words, word = self.words.newer.get, self.word
        if NOT_CUT.search(text):  # some of the spaces are no cuts
            joined_up, rest = [first], rest[::-1]
            while rest:
                part = rest.pop()
                if part and not part[0].isspace():
                    joined_up.append(part)
                else:
                    joined_up[-1] += " " + part
            first, *rest = joined_up
        return self.by_pattern(first) + b"".join([words(w) or word(w) for w in rest])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def reencode(self, old: str, old_ids: list[int], new: str) -> list[int]:
        """Ids of ``new``, made from those of ``old``: pieces that both begin or end with keep their tokens."""
        was, now = list(self.split(old)), list(self.split(new))
        shared = min(len(was), len(now))
        head = next((k for k in range(shared) if was[k] != now[k]), shared)
        tail = next((k for k in range(shared - head) if was[-1 - k] != now[-1 - k]), shared - head)
        count = lambda pieces: sum(len(p.encode()) for p in pieces)
        begin, end = count(was[:head]), count(was[: len(was) - tail])
        sizes = np.cumsum([0, *(len(self.vocabulary.bytes_of[k]) for k in old_ids)])
        first, last = np.searchsorted(sizes, (begin, end))
        middle = b"".join(self.known.newer.get(p) or self.piece(p) for p in now[head : len(now) - tail])
        return [*old_ids[:first], *np.frombuffer(middle, "<i4").tolist(), *old_ids[last:]]


def _shared_encoder(key: tuple[int, str, bool], ranks: dict[bytes, int]) -> TextEncoder:
    """One encoder per Python worker, so that its pieces serve later tasks of this kind too."""
    return kept_for(key, lambda: TextEncoder(ranks, *key[1:]))


def vocabulary_mark(ranks: dict[bytes, int]) -> bytes:
    """A digest of all tokens and their ranks, by which a worker tells vocabularies apart."""
    mark = hashlib.sha256()
    for token, rank in sorted(ranks.items()):
        mark.update(b"%d %d " % (rank, len(token)) + token)
    return mark.digest()


def encoded(spark: SparkSession, text: Column, ranks: dict[bytes, int], pattern: str, spaced: bool = False) -> Column:
    """Token ids of whole texts as an array column. Null and empty texts give an empty array.

    The ranks are broadcast; a vocabulary is a fixed file of a few MB, whatever the corpus."""
    sent = spark.sparkContext.broadcast(ranks)
    key = (vocabulary_mark(ranks), pattern, spaced)

    def make() -> Callable[[pa.Array], pa.Array]:
        encoder = _shared_encoder(key, sent.value)
        return lambda batch: joined([encoder.packed(t) if t else b"" for t in batch.to_pylist()], pa.int32(), "<i4")

    return mapped(make, "array<int>", keeps=True)(text)


class Decoder:
    """Bytes of ids; an id outside the vocabulary stands for the replacement character."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.bytes_of = np.full(self.size + 1, UNKNOWN, object)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes_of[np.where((ids < 0) | (ids > self.size), self.size, ids)])

    def gives(self, ids: np.ndarray, data: bytes) -> bool:
        """Whether the ids decode to exactly these bytes; compared slice by slice."""
        at = 0
        for k in range(0, len(ids), SLICE):
            part = self.bytes(ids[k : k + SLICE])
            if not data.startswith(part, at):
                return False
            at += len(part)
        return at == len(data)


def decoded(spark: SparkSession, ids: Column, ranks: dict[bytes, int]) -> Column:
    """Bytes of id arrays. A null array gives no bytes; an id outside the vocabulary, or null, the replacement character."""
    sent = spark.sparkContext.broadcast(ranks)

    def make() -> Callable[[pa.Array], pa.Array]:
        decoder = Decoder(sent.value)

        def one(batch: pa.Array) -> pa.Array:
            ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(batch), 0).to_pylist()])
            values = batch.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            return pa.array([decoder.bytes(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())

        return one

    return mapped(make, "binary")(ids)


def both_ways(spark: SparkSession, text: Column, ranks: dict[bytes, int], pattern: str, spaced: bool = False) -> Column:
    """(ids, back): ids as ``encoded`` gives them and the bytes they decode to, by one Python worker."""
    sent = spark.sparkContext.broadcast(ranks)
    key = (vocabulary_mark(ranks), pattern, spaced)

    def make() -> Callable[[pa.Array], pa.Array]:
        encoder, decoder = _shared_encoder(key, sent.value), Decoder(sent.value)

        def one(batch: pa.Array) -> pa.Array:
            packed = [encoder.packed(t) if t else b"" for t in batch.to_pylist()]
            back = pa.array([decoder.bytes(np.frombuffer(p, "<i4")) for p in packed], pa.binary())
            return pa.StructArray.from_arrays([joined(packed, pa.int32(), "<i4"), back], ["ids", "back"])

        return one

    return mapped(make, "struct<ids:array<int>,back:binary>", keeps=True)(text)


def checked(spark: SparkSession, text: Column, ranks: dict[bytes, int], pattern: str, spaced: bool = False) -> Column:
    """(ids, same): ids as ``encoded`` gives them, and whether they decode to the text's own bytes.

    Both ways are gone in the Python worker, so the decoded bytes never travel."""
    sent = spark.sparkContext.broadcast(ranks)
    key = (vocabulary_mark(ranks), pattern, spaced)

    def make() -> Callable[[pa.Array], pa.Array]:
        encoder, decoder = _shared_encoder(key, sent.value), Decoder(sent.value)

        def one(batch: pa.Array) -> pa.Array:
            packed, same = [], []
            for text in batch:
                own = text.as_py() or ""
                packed.append(encoder.packed(own))
                same.append(decoder.gives(np.frombuffer(packed[-1], "<i4"), own.encode()))
            return pa.StructArray.from_arrays([joined(packed, pa.int32(), "<i4"), pa.array(same, pa.bool_())], ["ids", "same"])

        return one

    return mapped(make, "struct<ids:array<int>,same:boolean>", keeps=True)(text)


def encode_texts(
    df: DataFrame, ranks: dict[bytes, int], pattern: str, spaced: bool = False, text: str = "text", ids: str = "ids", back: str = "decoded"
) -> DataFrame:
    """``df`` with the ids of each text and the bytes that these ids stand for.

    Columns of ``df`` that have the names ``ids`` or ``back`` are replaced; all others stay. Repeated rows
    are encoded alike, an empty table stays empty."""
    found = df.withColumn("__coded", both_ways(df.sparkSession, F.col(text), ranks, pattern, spaced))
    return found.withColumns({ids: F.col("__coded.ids"), back: F.col("__coded.back")}).drop("__coded")


def encode_checked(
    df: DataFrame, ranks: dict[bytes, int], pattern: str, spaced: bool = False, text: str = "text", ids: str = "ids", same: str = "round_trip"
) -> DataFrame:
    """``df`` with the ids of each text and whether they stand for exactly its bytes.

    Null and empty texts have no ids and are the same. Columns of ``df`` named ``ids`` or ``same`` are replaced."""
    found = df.withColumn("__coded", checked(df.sparkSession, F.col(text), ranks, pattern, spaced))
    return found.withColumns({ids: F.col("__coded.ids"), same: F.col("__coded.same")}).drop("__coded")

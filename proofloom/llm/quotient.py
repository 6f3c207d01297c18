"""A counting quotient filter that is exact: whole remainders, and a permutation that can be undone.

Keys of ``bits`` bits are permuted by a bijection, so that they spread evenly and lose nothing. The top bits of the
permuted key are its quotient and name a slot, the rest is its remainder and is kept whole; keys of a slot form a
run. Runs are coded by one bit a key and one bit a slot, remainders by their own number of bits, counters by a byte
(more for counts from 255). Entries are sorted, so filters of shards merge in one sequence, and the part of a
filter that belongs to a prefix of the permuted keys is a filter of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from proofloom.llm.packing import pack, unpack

FACTORS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def permuted(keys: np.ndarray, bits: int, back: bool = False) -> np.ndarray:
    """A bijection of the numbers below 2^bits, or its inverse: odd factors and shifts by at least half the bits."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    x = keys.astype(np.uint64)
    if back:
        for f in reversed(FACTORS):
            x = x ^ (x >> half)
            x = x * np.uint64(pow(f, -1, 1 << 64)) & mask
        return x ^ (x >> half)
    x = x ^ (x >> half)
    for f in FACTORS:
        x = x * np.uint64(f) & mask
        x = x ^ (x >> half)
    return x


def narrow(values: np.ndarray, width: int) -> bytes:
    """Numbers in ``width`` bits each."""
    flat = np.empty((len(values), width), np.uint8)
    for k in range(width):
        flat[:, width - 1 - k] = (values >> np.uint64(k)).astype(np.uint8) & 1
    return np.packbits(flat).tobytes()


def widened(data: bytes, width: int, n: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out << np.uint64(1) | flat[:, k]
    return out


class QuotientFilter:
    """Counts of keys below 2^bits, held by their permuted values in ascending order."""

    def __init__(self, bits: int, held: np.ndarray, counts: np.ndarray) -> None:
        self.bits, self.held, self.counts = bits, held, counts

    @classmethod
    def of(cls, keys: np.ndarray, bits: int) -> tuple[QuotientFilter, np.ndarray]:
        """The filter of the keys, and the entry that counts each of them."""
        held, of, counts = np.unique(permuted(keys, bits), return_inverse=True, return_counts=True)
        return cls(bits, held, counts.astype(np.int64)), of

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """One filter with the sums; the sorted entries of each are runs that the sort merges."""
        held = np.concatenate([f.held for f in filters])
        order = np.argsort(held, kind="stable")
        held, counts = held[order], np.concatenate([f.counts for f in filters])[order]
        first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]][: len(held)])
        return cls(filters[0].bits, held[first], np.add.reduceat(counts, first) if len(first) else counts)

    def keys(self) -> np.ndarray:
        return permuted(self.held, self.bits, back=True)

    def count(self, key: int) -> int:
        """How often one key was counted."""
        value = permuted(np.array([key], np.uint64), self.bits)[0]
        k = int(np.searchsorted(self.held, value))
        return int(self.counts[k]) if k < len(self.held) and self.held[k] == value else 0

    def parts(self, prefix: int) -> Iterator[tuple[int, int, int]]:
        """(first ``prefix`` bits, start, stop) of the entries."""
        if len(self.held):
            top = (self.held >> np.uint64(self.bits - prefix)).astype(np.int64)
            cut = np.r_[0, np.flatnonzero(np.diff(top)) + 1, len(top)].tolist()
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                yield int(top[a]), a, b

    def packed(self, prefix: int, start: int, stop: int) -> bytes:
        """The entries of one part as a filter of its own."""
        n, left = stop - start, self.bits - prefix
        slots = min(left, max(0, n.bit_length() - 1))
        rest = left - slots
        inner = self.held[start:stop] & np.uint64((1 << left) - 1)
        run = np.zeros(n + (1 << slots), np.uint8)
        run[(inner >> np.uint64(rest)).astype(np.int64) + np.arange(n)] = 1
        count = self.counts[start:stop]
        large = count >= 255
        head = np.array([self.bits, prefix, n, slots, int(self.held[start]) >> left if n else 0], np.int64)
        return pack(head.tobytes(), np.packbits(run).tobytes(), narrow(inner & np.uint64((1 << rest) - 1), rest), np.where(large, 255, count).astype(np.uint8).tobytes(), count[large].tobytes())

    @classmethod
    def unpacked(cls, packed: bytes) -> QuotientFilter:
        head, run, rests, small, large = unpack(packed)
        bits, prefix, n, slots, top = np.frombuffer(head, np.int64).tolist()
        rest = bits - prefix - slots
        marks = np.unpackbits(np.frombuffer(run, np.uint8), count=n + (1 << slots))
        slot = (np.flatnonzero(marks) - np.arange(n)).astype(np.uint64)
        counts = np.frombuffer(small, np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(large, np.int64)
        return cls(bits, np.uint64(top << (bits - prefix)) | slot << np.uint64(rest) | widened(rests, rest, n), counts)

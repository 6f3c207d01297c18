"""Documents in packed chunks, whose sorted keys go to buckets and get answers back.

A chunk holds the rows of one Arrow batch, a few MB of text at most (or one longer text). What the chunks of a
corpus have in common is found in two moves: each chunk sends every distinct key once to the bucket that the key
names, sorted and coded by gaps, and the bucket sends back something for each key, in the same order. A key that
stands in a third of all rows is therefore one entry a chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

from proofloom.llm.neardup import mixed
from proofloom.llm.tables import release

CHUNK_BYTES = 4 << 20
BUCKET_KEYS = 2_000_000
LONG_WORD = 64
BASES = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED05], np.uint64)


def pack(*parts: bytes) -> bytes:
    """Byte strings in one compressed string."""
    sizes = np.array([len(parts), *map(len, parts)], np.int64)
    return zstandard.ZstdCompressor(1).compress(b"".join([sizes.tobytes(), *parts]))


def unpack(packed: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(raw, np.int64, n, 8))
    return [raw[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]


def gaps(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as gaps, equal places of the bytes together."""
    return np.diff(values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def from_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def chunks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches in pieces of about CHUNK_BYTES, with numbers that no two pieces of a job share."""
    release()
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            stop = batch.num_rows
            while stop - start > 1 and batch.slice(start, stop - start).nbytes > CHUNK_BYTES:
                stop = start + (stop - start) // 2
            yield task << 32 | n, batch.slice(start, stop - start)
            start, n = stop, n + 1


def frozen(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(1).compress(sink.getvalue())


def thawed(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_next_batch()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, nulls as empty, and where each begins."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def word_bounds(data: np.ndarray, begins: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of other bytes than ``space``, and the text of each; none crosses a text."""
    inside = np.r_[False, ~space[data], False]
    edge = np.zeros(len(data) + 1, bool)
    edge[begins] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(begins, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; words are taken together, one byte place after the other."""
    import xxhash

    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, left = starts[order], size[order]
    long = int(np.searchsorted(-left, -LONG_WORD, "left"))
    held = left.astype(np.uint64)
    for k in range(int(left[long]) if long < len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))
        held[long:n] = held[long:n] * BASES[0] + data[at[long:n] + k]
    held = mixed(held)
    for k in range(long):
        held[k] = xxhash.xxh3_64_intdigest(data[at[k] : at[k] + left[k]].tobytes())
    out = np.empty(len(held), np.uint64)
    out[order] = held
    return out


def rolled(values: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A hash of every ``n`` consecutive values."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    up = np.cumprod(np.r_[np.uint64(1), np.full(len(values) - 1, base, np.uint64)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(len(values) - n, pow(int(base), -1, 1 << 64), np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(values * up)]
    return mixed((sums[n:] - sums[:-n]) * down)


def coded(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash above its low 32 bits."""
    low = np.uint64(0xFFFFFFFF)
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32) | hashes & low


def bucket_cuts(codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, stop) of sorted codes."""
    if len(codes):
        bucket = (codes >> np.uint64(32)).astype(np.int64)
        cut = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(codes)].tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield int(bucket[a]), a, b


def leaders(*keys: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return new

"""Word passages that repeat across documents, found from fixed blocks.

Every document is cut into non-overlapping reference blocks of half a window; the index has a block's hash. Every
rolling window of a block's size probes it. A passage of ``size`` words that stands in two documents holds a whole
reference block of the first one, so the second one hits that block. Hits are extended to all the passages around
the block, to the left and to the right: these are keyed by two hashes of all their words, so that equal ones meet
at the document with the smallest id. Passages that follow one another there join to maximal exact repeats.

Blocks and probes travel as the distinct hashes of a chunk of documents (``packing``), so neither copies of a
document nor a passage that very many documents share make a large group: such a key is one entry a chunk. The
index, the probes and the passages are dealt over buckets whose number grows with the corpus; nothing is broadcast
and nothing goes through the driver. Block hashes that meet by chance only add passages to compare; passages are
taken as equal if 64 bits of one hash and 32 or more of another agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.llm.packing import (
    BASES,
    BUCKET_KEYS,
    bits,
    bucket_cuts,
    chunks_of,
    coded,
    from_bits,
    from_gaps,
    frozen,
    gaps,
    leaders,
    pack,
    rolled,
    text_bytes,
    thawed,
    unpack,
    word_bounds,
    word_hashes,
)
from proofloom.llm.tables import bounded_batches, stored

SIZE = 50
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
ASKED = "bucket int, chunk long, packed binary"
ANSWER = "chunk long, bucket int, packed binary"
OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,stop:int>>, kept string"


class Words(NamedTuple):
    """The words of a chunk: where they stand, the row of each, and the ids of the rows."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    ids: np.ndarray
    named: np.ndarray

    def windows(self, n: int) -> np.ndarray:
        """The first words of all windows of ``n`` words inside one row that has an id."""
        if len(self.row) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero((self.row[: len(self.row) - n + 1] == self.row[n - 1 :]) & self.named[self.row[: len(self.row) - n + 1]])


def read(body: bytes) -> Words:
    batch = thawed(body)
    data, begins = text_bytes(batch.column(1))
    starts, ends, row = word_bounds(data, begins, SPACE)
    ids = batch.column(0)
    return Words(data, starts, ends, row, word_hashes(data, starts, ends), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False))


class Probes(NamedTuple):
    """Rolling block-sized windows: first words, which distinct code each has, and per code whether a reference
    block has it and whether two documents do."""

    at: np.ndarray
    of: np.ndarray
    codes: np.ndarray
    block: np.ndarray
    shared: np.ndarray


def probes(words: Words, block: int, buckets: int) -> Probes:
    at = words.windows(block)
    code = coded(rolled(words.hashes, block, BASES[0])[at], buckets)
    first = np.searchsorted(words.row, words.row[at])
    whole = (at - first) % block == 0
    doc = words.ids[words.row[at]]
    order = np.argsort(code, kind="stable")
    head = np.flatnonzero(leaders(code[order]))
    of = np.empty(len(at), np.int64)
    of[order] = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(at)]))
    if not len(at):
        none = np.zeros(0, bool)
        return Probes(at, of, code, none, none)
    low, high = np.minimum.reduceat(doc[order], head), np.maximum.reduceat(doc[order], head)
    return Probes(at, of, code[order][head], np.logical_or.reduceat(whole[order], head), low != high)


def _freeze(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk, batch in chunks_of(batches):
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([frozen(batch)], pa.binary())], ["chunk", "body"])


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    kinds = {"bucket": pa.int32(), "chunk": pa.int64(), "packed": pa.binary()}
    return pa.table({name: pa.array([r[k] for r in rows], kinds[name]) for k, name in enumerate(names)})


def _probe(batches: Iterable[pa.RecordBatch], block: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """What a chunk asks of each bucket: its codes there, with the marks of blocks and of shared codes."""
    for batch in batches:
        for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            p = probes(read(body.as_py()), block, buckets)
            rows = [(k, chunk, pack(gaps(p.codes[a:b].astype(np.uint32)), bits(p.block[a:b]), bits(p.shared[a:b]))) for k, a, b in bucket_cuts(p.codes)]
            yield from _table(rows, ("bucket", "chunk", "packed")).to_batches()


def _hit(asked: pa.Table) -> pa.Table:
    """For each chunk of the bucket, which of its codes a reference block and another document have."""
    parts = [unpack(x.as_py()) for x in asked.column("packed")]
    codes = [from_gaps(p[0]) for p in parts]
    n = np.array([len(c) for c in codes])
    block = np.concatenate([from_bits(p[1], k) for p, k in zip(parts, n, strict=True)])
    shared = np.concatenate([from_bits(p[2], k) for p, k in zip(parts, n, strict=True)])
    code = np.concatenate(codes)
    order = np.argsort(code, kind="stable")
    head = np.flatnonzero(leaders(code[order]))
    times = np.diff(np.r_[head, len(code)])
    good = np.logical_or.reduceat(block[order], head) & ((times > 1) | np.logical_or.reduceat(shared[order], head))
    hit = np.empty(len(code), bool)
    hit[order] = np.repeat(good, times)
    return _answers(asked, hit, n)


def _answers(asked: pa.Table, flag: np.ndarray, n: np.ndarray) -> pa.Table:
    cut = np.r_[0, np.cumsum(n)].tolist()
    each = zip(asked.column("chunk").to_pylist(), asked.column("bucket").to_pylist(), cut[:-1], cut[1:], strict=True)
    return _table([(chunk, bucket, pack(bits(flag[a:b]))) for chunk, bucket, a, b in each if flag[a:b].any()], ("chunk", "bucket", "packed"))


def _flags(answers: pa.Table, codes: np.ndarray) -> np.ndarray:
    """The answers for sorted codes; a bucket that sends none means no."""
    said = dict(zip(answers.column("bucket").to_pylist(), answers.column("packed").to_pylist(), strict=True))
    flag = np.zeros(len(codes), bool)
    for bucket, a, b in bucket_cuts(codes):
        if bucket in said:
            flag[a:b] = from_bits(unpack(said[bucket])[0], b - a)
    return flag


class Passages(NamedTuple):
    """Windows around hits: first words, which distinct passage each is, and per passage its code, second hash
    and smallest document here."""

    at: np.ndarray
    of: np.ndarray
    codes: np.ndarray
    second: np.ndarray
    least: np.ndarray


def passages(words: Words, hits: pa.Table, size: int, block: int, buckets: int) -> Passages:
    p = probes(words, block, buckets)
    near = np.zeros(len(words.row) + 1, np.int64)
    hit = p.at[_flags(hits, p.codes)[p.of]]
    np.add.at(near, np.maximum(hit - (size - block), 0), 1)
    np.add.at(near, hit + 1, -1)
    at = words.windows(size)
    at = at[np.cumsum(near)[at] > 0]
    code, second = coded(rolled(words.hashes, size, BASES[0])[at], buckets), rolled(words.hashes, size, BASES[1])[at]
    doc = words.ids[words.row[at]]
    order = np.lexsort((doc, second, code))
    head = np.flatnonzero(leaders(code[order], second[order]))
    of = np.empty(len(at), np.int64)
    of[order] = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(at)]))
    lead = order[head]
    return Passages(at, of, code[lead], second[lead], doc[lead])


def _extend(body: pa.Table, hits: pa.Table, size: int, block: int, buckets: int) -> pa.Table:
    """What a chunk asks of each bucket about the passages around its hits."""
    rows = []
    for chunk, packed in zip(body.column("chunk").to_pylist(), body.column("body"), strict=True):
        p = passages(read(packed.as_py()), hits, size, block, buckets)
        for k, a, b in bucket_cuts(p.codes):
            docs, which = np.unique(p.least[a:b], return_inverse=True)
            rows.append((k, chunk, pack(gaps(p.codes[a:b].astype(np.uint32)), p.second[a:b].tobytes(), docs.tobytes(), which.astype(np.uint32).tobytes())))
    return _table(rows, ("bucket", "chunk", "packed"))


def _first(asked: pa.Table) -> pa.Table:
    """For each chunk of the bucket, which of its passages start in a smaller document of another chunk."""
    parts = [unpack(x.as_py()) for x in asked.column("packed")]
    codes = [from_gaps(p[0]) for p in parts]
    n = np.array([len(c) for c in codes])
    code, second = np.concatenate(codes), np.concatenate([np.frombuffer(p[1], np.uint64) for p in parts])
    doc = np.concatenate([np.frombuffer(p[2], np.int64)[np.frombuffer(p[3], np.uint32)] for p in parts])
    order = np.lexsort((doc, second, code))
    new = leaders(code[order], second[order])
    least = doc[order][new][np.cumsum(new) - 1]
    later = np.empty(len(code), bool)
    later[order] = doc[order] > least
    return _answers(asked, later, n)


def _cut(body: pa.Table, hits: pa.Table, later: pa.Table, size: int, block: int, buckets: int) -> pa.Table:
    """The rows of a chunk without the words that repeated passages cover."""
    out = []
    for packed in body.column("body"):
        words = read(packed.as_py())
        p = passages(words, hits, size, block, buckets)
        again = _flags(later, p.codes)[p.of] | (words.ids[words.row[p.at]] > p.least[p.of])
        cover = np.zeros(len(words.row) + 1, np.int64)
        np.add.at(cover, p.at[again], 1)
        np.add.at(cover, p.at[again] + size, -1)
        out.append(_rows(words, np.cumsum(cover)[:-1] > 0))
    return pa.concat_tables(out)


def _rows(words: Words, gone: np.ndarray) -> pa.Table:
    n = len(words.ids)
    first = np.searchsorted(words.row, np.arange(n + 1))
    edge = np.flatnonzero(gone & (np.r_[True, ~gone[:-1]] | leaders(words.row))), np.flatnonzero(gone & np.r_[~gone[1:] | leaders(words.row)[1:], True][: len(gone)])
    owner = words.row[edge[0]]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array((e - first[owner] + k).astype(np.int32)) for k, e in enumerate(edge)], ["start", "stop"]),
    )
    kept = np.flatnonzero(~gone)
    row = words.row[kept]
    last = np.r_[row[1:] != row[:-1], True][: len(row)]
    mark = np.zeros(len(words.data) + 1, np.int8)
    mark[words.starts[kept]] += 1
    np.add.at(mark, words.ends[kept], -1)
    take = np.cumsum(mark[:-1], dtype=np.int8) > 0
    between = words.ends[kept[~last]]
    take[between] = True
    data = words.data.copy()
    data[between] = 0x20
    size = np.bincount(row, words.ends[kept] - words.starts[kept] + ~last, n).astype(np.int64)
    offsets = np.r_[0, np.cumsum(size)]
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[take].tobytes())])
    columns = [
        pa.array(words.ids, pa.int64(), mask=~words.named),
        pa.array(np.bincount(words.row, minlength=n)[:n].astype(np.int64)),
        pa.array(np.bincount(words.row[gone], minlength=n)[:n].astype(np.int64)),
        spans,
        text.cast(pa.large_string()).cast(pa.string()),
    ]
    return pa.table(dict(zip(("doc_id", "n_words", "n_removed", "spans", "kept"), columns, strict=True)))


def without_passages(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept), a row for every row of ``docs``: words are runs of other bytes
    than ASCII white space; ``kept`` has the words left, joined by one space, and ``spans`` the maximal removed
    runs as word numbers, start inside and stop outside.

    A word goes if a run of ``size`` words that covers it also starts in a document with a smaller id, judged on
    the input. Null, empty and shorter texts lose nothing. Ids are whole numbers; rows without one are neither
    sources nor changed, rows that share an id are no sources for each other, and repeated rows are treated
    alike. Other columns of ``docs`` are not read. An empty table gives an empty one."""
    if size < 2:
        raise ValueError("size must be at least 2")
    block = (size + 1) // 2
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chunks = stored(rows.mapInArrow(_freeze, "chunk long, body binary"), "chunks")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // (6 * BUCKET_KEYS)))
    dealt = {"size": size, "block": block, "buckets": buckets}
    asked = chunks.mapInArrow(partial(_probe, block=block, buckets=buckets), ASKED)
    hits = stored(asked.groupBy("bucket").applyInArrow(_hit, ANSWER), "block-hits")
    around = chunks.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(partial(_extend_known, **dealt), ASKED)
    later = stored(around.groupBy("bucket").applyInArrow(_first, ANSWER), "later-passages")
    both = hits.withColumn("pass", F.lit(1)).unionByName(later.withColumn("pass", F.lit(2)))
    return chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(partial(_cut_known, **dealt), OUT)


def _extend_known(body: pa.Table, hits: pa.Table, **dealt: int) -> pa.Table:
    return _extend(body, hits, **dealt) if hits.num_rows else _table([], ("bucket", "chunk", "packed"))


def _cut_known(body: pa.Table, both: pa.Table, **dealt: int) -> pa.Table:
    turn = both.column("pass").to_numpy()
    return _cut(body, both.filter(pa.array(turn == 1)), both.filter(pa.array(turn == 2)), **dealt)

"""Passages that repeat across documents, by enhanced suffix arrays.

A suffix array of a corpus does not fit a task, so strings are dealt out such that equal ones meet: every
window of ``size`` bytes is represented by the least hash of its short pieces (its minimizer), and runs of
windows with the same minimizer form a segment. Equal windows have equal minimizers, so each bucket of
segments can be solved alone: a suffix array of its segments, the common prefixes of neighbours, and a stack
scan of the common-prefix intervals. An interval whose members differ in the byte before them is a maximal
repeat, and the interval holds all its occurrences.

Equal segments are merged before they travel: the copies in larger documents are covered by the one in the
smallest. Minimizers that occur once in the corpus have no repeat; a bit table of the repeated ones, whose
size is checked, lets tasks leave the others at home. Beyond that size everything is sent, with equal results.

A minimizer that stands in very many different segments is not solved as one group: its windows travel one by
one, each keyed by a hash of all its bytes, so that equal windows still meet and nothing else does. Such
minimizers are found by the windows of a sample of the distinct segments, chosen by the segments' marks. There
is at most one for every HOT windows of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.llm.neardup import mixed
from proofloom.llm.tables import release, text_key

SIZE, PIECE = 50, 20
SLICE = 1 << 16
FLUSH = 8 << 20
BUCKET_BYTES = 6 << 20
MOST_TABLE_BITS = 1 << 29
LONGEST, WINDOWS = 64, 60_000
HOT, ONE_OF = 1 << 16, 64
CHUNK = 1 << 19
SPANS = "doc bigint, version bigint, start bigint, stop bigint"


class SuffixArray:
    """The suffixes of some strings that hold at least ``least`` bytes, in order, with their common prefixes."""

    def __init__(self, strings: list[bytes], least: int):
        text = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.array([len(s) for s in strings])
        begins = np.cumsum(sizes) - sizes
        counts = np.maximum(sizes - least + 1, 0)
        owner = np.repeat(np.arange(len(strings)), counts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        at, left_over = begins[owner] + offset, sizes[owner] - offset
        width = int(sizes.max(initial=1))
        grid = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(width, np.uint8)]), width)[at]
        grid[np.arange(width)[None, :] >= left_over[:, None]] = 0
        order = np.argsort(grid.view(f"S{width}").ravel(), kind="stable")
        grid, self.owner, self.offset, left_over, at = grid[order], owner[order], offset[order], left_over[order], at[order]
        differ = grid[1:] != grid[:-1]
        prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        self.prefix = np.minimum(prefix, np.minimum(left_over[1:], left_over[:-1]))
        self.before = np.where(self.offset > 0, text[np.maximum(at, 1) - 1].astype(np.int64), -1 - np.arange(len(at)))
        self.deep = np.flatnonzero(self.prefix >= least)

    def runs(self) -> Iterator[tuple[int, int]]:
        """First and last of neighbours that share enough, where they differ to the left somewhere."""
        if not len(self.deep):
            return
        cuts = np.flatnonzero(np.diff(self.deep) > 1) + 1
        first, last = self.deep[np.r_[0, cuts]], self.deep[np.r_[cuts - 1, len(self.deep) - 1]] + 1
        change = np.r_[0, np.cumsum(self.before[1:] != self.before[:-1])]
        open_ = change[last] > change[first]
        yield from zip(first[open_].tolist(), last[open_].tolist(), strict=True)


def maximal_repeats(strings: list[bytes], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, string numbers, offsets) of every maximal repeat of at least ``least`` bytes, with all its occurrences."""
    array = SuffixArray(strings, least)
    for low, high in array.runs():
        for length, first, last in intervals(array.prefix[low:high].tolist(), array.before[low : high + 1].tolist()):
            yield length, array.owner[low + first : low + last + 1], array.offset[low + first : low + last + 1]


def intervals(prefix: list[int], before: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals whose members differ to the left, in one scan.

    ``prefix[k]`` is shared by members k and k + 1. A stack entry is [length, first member, left byte], the
    byte None once two of the members differ in it."""
    stack: list[list] = []
    for k, shared in enumerate([*prefix, 0]):
        first, left = k, before[k]
        while stack and stack[-1][0] > shared:
            length, first, held = stack.pop()
            left = held if held == left else None
            if left is None:
                yield length, first, k
        if stack and stack[-1][0] == shared:
            stack[-1][2] = stack[-1][2] if stack[-1][2] == left else None
        elif shared:
            stack.append([shared, first, left])


def covered(prefix: list[int], before: list[int], doc: list[int]) -> list[tuple[int, int]]:
    """(member, length): for each member the longest maximal repeat that a smaller document has too.

    The same scan; an entry also holds its members of the least document. All others are done with: their
    interval, or the one that begins further left, covers them."""
    out: list[tuple[int, int]] = []
    stack: list[list] = []
    for k, shared in enumerate([*prefix, 0]):
        left, members = before[k], [k]
        while stack and stack[-1][0] > shared:
            length, held, first = stack.pop()
            left = held if held == left else None
            members = first + members
            least = min([doc[m] for m in members])
            if left is None:
                out += [(m, length) for m in members if doc[m] > least]
            members = [m for m in members if doc[m] == least]
        if stack and stack[-1][0] == shared:
            stack[-1][1] = stack[-1][1] if stack[-1][1] == left else None
            stack[-1][2] += members
        elif shared:
            stack.append([shared, left, members])
    return out


def _later(texts: list[bytes], least: np.ndarray, size: int) -> np.ndarray:
    """(string, from, to) of what strings share with strings of smaller documents, touching parts as one."""
    array = SuffixArray(texts, size)
    doc = least[array.owner]
    found: list[tuple[int, int]] = []
    for low, high in array.runs():
        own = doc[low : high + 1]
        if (own != own[0]).any():
            found += [(low + m, n) for m, n in covered(array.prefix[low:high].tolist(), array.before[low : high + 1].tolist(), own.tolist())]
    if not found:
        return np.empty((0, 3), np.int64)
    at, length = np.array(found, np.int64).T
    start = array.owner[at] * (1 << 20) + array.offset[at]
    order = np.argsort(start)
    start, stop = start[order], np.maximum.accumulate((start + length)[order])
    new = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]])
    start, stop = start[new], stop[np.r_[new[1:] - 1, len(stop) - 1]]
    return np.column_stack([start >> 20, start & ((1 << 20) - 1), stop & ((1 << 20) - 1)])


def _windows(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimizer of every window of the bytes, and every 8 bytes as a number."""
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = (x[:-k] << np.uint64(8 * k)) | x[k:]
    gap = PIECE - 8
    least = mixed((x[:-gap] * np.uint64(0x9E3779B97F4A7C15) ^ x[gap // 2 : -(gap - gap // 2)]) * np.uint64(0xD6E8FEB86659FD93) + x[gap:])
    span, have = size - PIECE + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least, x


def segments(texts: list[bytes], size: int, marked: bool = True) -> list[np.ndarray]:
    """Minimizer, two marks, start, length and text number of every segment, of LONGEST windows at most.

    Equal segments are found by their 128-bit mark. The texts are taken as one row of bytes, in slices."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    parts = [_slice(data[begin : begin + SLICE + size - 1], begin, ends, size, marked) for begin in range(0, len(data) - size + 1, SLICE)]
    columns = list(zip(*parts, strict=True))
    del parts
    least, one, two, at, length = (np.concatenate(columns.pop(0)) for _ in range(5))
    row = np.searchsorted(ends, at, "right")
    return [least, one, two, at - (ends - sizes)[row], length, row]


def _slice(data: np.ndarray, begin: int, ends: np.ndarray, size: int, marked: bool) -> tuple[np.ndarray, ...]:
    least, x = _windows(data, size)
    inside = np.ones(len(least), bool)
    low, high = np.searchsorted(ends, (begin, begin + len(least) + size))
    for end in (ends[low:high] - begin).tolist():
        inside[max(end - size + 1, 0) : max(end, 0)] = False
    at = np.flatnonzero(inside)
    value = least[at]
    first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (np.diff(at) > 1)][: len(at)])
    run = np.r_[first[1:], len(at)] - first if len(at) else first
    pieces = -(-run // LONGEST)
    piece = LONGEST * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    length = np.minimum(np.repeat(run, pieces) - piece, LONGEST) + size - 1
    first = at[np.repeat(first, pieces) + piece] if len(at) else at
    none = np.zeros(0, np.uint64)
    one, two = _marks(x, first, length) if marked and len(first) else (none, none)
    return least[first], one, two, first + begin, length


def _marks(x: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
    for k in range(0, int(length.max()) - 7, 8):
        fits = np.flatnonzero(length >= k + 8) if k + 8 > length.min() else slice(None)
        word = x[first[fits] + k]
        one[fits] = mixed(one[fits] ^ word)
        two[fits] = (two[fits] + word) * np.uint64(0xD6E8FEB86659FD93) + (two[fits] >> np.uint64(29))
    word = x[first + length - 8]
    return mixed(one ^ word ^ length.astype(np.uint64)), mixed((two + word) * np.uint64(0xD6E8FEB86659FD93))


def _texts(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Rows in groups of about FLUSH bytes: texts, ids, versions."""
    release()
    texts: list[bytes] = []
    ids: list[int] = []
    versions: list[int] = []
    total = 0
    for batch in batches:
        for doc, version, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if text is None or doc is None or len(data := text.encode()) < size:
                continue
            texts.append(data)
            ids.append(doc)
            versions.append(version)
            total += len(data)
            if total >= FLUSH:
                yield texts, np.array(ids, np.int64), np.array(versions, np.int64)
                texts, ids, versions, total = [], [], [], 0
    if texts:
        yield texts, np.array(ids, np.int64), np.array(versions, np.int64)
    del texts, ids, versions
    release()


def _minimizers(batches: Iterable[pa.RecordBatch], size: int, buckets: int, listed: bool, one_of: int) -> Iterator[pa.RecordBatch]:
    """Per bucket the distinct minimizers of a group of texts and whether several documents have them, if they
    are to be listed, and minimizer, mark and windows of a sample of the distinct segments."""
    bounds = (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets)
    for texts, ids, _ in _texts(batches, size):
        yield _listing(texts, ids, size, bounds, listed, one_of)


def _listing(texts: list[bytes], ids: np.ndarray, size: int, bounds: np.ndarray, listed: bool, one_of: int) -> pa.RecordBatch:
    pack = zstandard.ZstdCompressor(1).compress
    least, mark, _, _, length, row = segments(texts, size)
    some = np.flatnonzero(mark % np.uint64(one_of) == 0)
    sample = np.unique(np.column_stack([mixed(least[some]), mark[some], (length[some] - size + 1).astype(np.uint64)]), axis=0)
    del mark, length
    ends = np.searchsorted(sample[:, 0] >> np.uint64(32), bounds)
    value, several, cut = np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(len(bounds), np.int64)
    if listed:
        doc = ids[row]
        order = np.argsort(least, kind="stable")
        least, doc = least[order], doc[order]
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        value = mixed(least[first])
        order = np.argsort(value)
        value, several = value[order], several[order]
        cut = np.searchsorted(value >> np.uint64(32), bounds)
    rows = []
    for k, (a, b, c, d) in enumerate(zip(cut[:-1], cut[1:], ends[:-1], ends[1:], strict=True)):
        if b > a or d > c:
            rows.append((k, pack(np.diff(value[a:b], prepend=np.uint64(0)).tobytes() + several[a:b].tobytes()), pack(sample[c:d].tobytes())))
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["bucket", "packed", "sample"])


def _repeated(rows: pd.DataFrame, bits: int, hot: int, one_of: int) -> pd.DataFrame:
    """The bits of a bucket's minimizers that several documents or several groups of texts have, and its
    minimizers whose distinct segments hold about ``hot`` windows or more."""
    read = zstandard.ZstdDecompressor().decompress
    values, flags = [], []
    for packed in rows["packed"]:
        raw = read(packed)
        n = len(raw) // 9
        values.append(np.cumsum(np.frombuffer(raw, np.uint64, n), dtype=np.uint64))
        flags.append(np.frombuffer(raw, bool, n, 8 * n))
    value, flag = np.concatenate(values), np.concatenate(flags)
    unique, at, count = np.unique(value, return_inverse=True, return_counts=True)
    again = (count > 1) | (np.bincount(at, flag, len(unique)) > 0)
    place = np.unique(unique[again] >> np.uint64(64 - bits)).astype(np.uint32)
    sample = np.unique(np.concatenate([np.frombuffer(read(p), np.uint64).reshape(-1, 3) for p in rows["sample"]]), axis=0)
    unique, at = np.unique(sample[:, 0], return_inverse=True)
    many = unique[np.bincount(at, sample[:, 2].astype(float), len(unique)) * one_of >= hot]
    return pd.DataFrame({"places": [place.tobytes()], "hot": [many.tobytes()]})


def _known(row: np.ndarray, start: np.ndarray, stop: np.ndarray, ids: np.ndarray, versions: np.ndarray, buckets: int) -> list[tuple[int, bool, bytes]]:
    """Runs of the spans that a task knows, dealt out by document."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    reach = np.maximum.accumulate(stop + row * (1 << 40)) - row * (1 << 40) if len(row) else stop
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] > reach[:-1])][: len(row)])
    runs = np.column_stack([ids[row[new]], versions[row[new]], start[new], np.maximum.reduceat(stop, new) if len(new) else stop])
    bucket = runs[:, 0] % buckets
    return [(int(k), True, runs[bucket == k].tobytes()) for k in np.unique(bucket)]


def _single(texts: list[bytes], start: np.ndarray, length: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The windows of some segments one by one: two marks, start, bytes that the copies behind it add, text number.

    Copies in one text that overlap or touch are one row, since all of them stay or go."""
    data = np.frombuffer(b"".join([texts[r][s : s + n] for r, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]), np.uint8)
    count = length - size + 1
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = (x[:-k] << np.uint64(8 * k)) | x[k:]
    one, two = _marks(x, np.repeat(np.cumsum(length) - length, count) + inner, np.full(len(inner), size))
    start, row = np.repeat(start, count) + inner, np.repeat(row, count)
    order = np.lexsort((start, row, two, one))
    one, two, start, row = (c[order] for c in (one, two, start, row))
    new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (row[1:] != row[:-1]) | (np.diff(start) > size)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(new)] - 1
    return one[first], two[first], start[first], start[last] - start[first], row[first]


def _parts(texts: list[bytes], size: int, held: tuple[np.ndarray, int] | None, hot: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Key, two marks, start, length, added bytes and text number of the segments that may repeat, and then of
    the single windows of hot minimizers, about CHUNK at a time."""
    least, one, two, start, length, row = segments(texts, size)
    value = mixed(least)
    if held is not None:
        place = value >> np.uint64(64 - held[1])
        keep = (held[0][place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        value, one, two, start, length, row = (c[keep] for c in (value, one, two, start, length, row))
    split = np.isin(value, hot)
    whole = [c[~split] for c in (value, one, two, start, length, np.zeros(len(value), np.int64), row)]
    yield whole
    start, length, row = start[split], length[split], row[split]
    chunk = np.cumsum(length - size + 1) // CHUNK
    for k in np.unique(chunk):
        some = chunk == k
        one, two, begin, added, text = _single(texts, start[some], length[some], row[some], size)
        yield [mixed(one ^ two), one, two, begin, np.full(len(one), size), added, text]


def _ship(batches: Iterable[pa.RecordBatch], size: int, buckets: int, table: Callable[[], tuple[tuple[np.ndarray, int] | None, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Per bucket the spans known here, and the first copies of what may repeat."""
    held, hot = table()
    for texts, ids, versions in _texts(batches, size):
        for part in _parts(texts, size, held, hot):
            yield _blocks(texts, ids, versions, part, buckets)


def _blocks(texts: list[bytes], ids: np.ndarray, versions: np.ndarray, part: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    pack = zstandard.ZstdCompressor(3).compress
    doc = ids[part[-1]]
    order = np.lexsort((part[3], doc, part[2], part[1]))
    value, one, two, start, length, added, row, doc = (c[order] for c in (*part, doc))
    new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])][: len(one)]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    later = doc > doc[first][group] if len(first) else np.zeros(0, bool)
    out = _known(row[later], start[later], (start + length + added)[later], ids, versions, buckets)
    mine = np.flatnonzero(~later)
    bucket = (value[mine] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    mine = mine[np.lexsort((group[mine], value[mine], bucket))]
    bucket = np.sort(bucket)
    cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if b > a:
            some = mine[a:b]
            lead = np.r_[True, group[some][1:] != group[some][:-1]]
            heads = some[lead]
            count = np.diff(np.r_[np.flatnonzero(lead), len(some)]).astype(np.uint32)
            body = b"".join([texts[r][s : s + n] for r, s, n in zip(row[heads].tolist(), start[heads].tolist(), length[heads].tolist(), strict=True)])
            columns = (value[heads], length[heads].astype(np.uint32), count, doc[some], versions[row[some]].astype(np.int32), start[some], added[some])
            head = np.array([len(heads), len(some)], np.int64)
            out.append((k, False, pack(b"".join([head.tobytes(), *(c.tobytes() for c in columns), body]))))
    kinds = (pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["bucket", "known", "packed"])


def _unpacked(packed: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Keys and strings of one block, how many starts each has, and all starts with the bytes that they add."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    heads, some = np.frombuffer(raw, np.int64, 2)
    at = 16
    columns = []
    for kind, n in ((np.uint64, heads), (np.uint32, heads), (np.uint32, heads), (np.int64, some), (np.int32, some), (np.int64, some), (np.int64, some)):
        columns.append(np.frombuffer(raw, kind, n, at))
        at += columns[-1].nbytes
    value, length, count, doc, version, start, added = columns
    ends = at + np.cumsum(length, dtype=np.int64)
    strings = [raw[a:b] for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]
    return value, strings, count, np.stack([doc, version.astype(np.int64), start, added], axis=1)


def _solve(packed: Iterable[bytes], size: int) -> np.ndarray:
    """Spans of a bucket: copies of segments outside the smallest document, and repeats between segments."""
    classes: dict[bytes, int] = {}
    own, counts, values, starts = [], [], [], []
    for block in packed:
        value, strings, count, begun = _unpacked(block)
        own.append(np.fromiter((classes.setdefault(s, len(classes)) for s in strings), np.int64, len(strings)))
        counts.append(count)
        values.append(value)
        starts.append(begun)
    head, at = np.concatenate(own), np.concatenate(starts)
    of = np.repeat(head, np.concatenate(counts))
    texts = list(classes)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    value = np.empty(len(texts), np.uint64)
    value[head] = np.concatenate(values)
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, of, at[:, 0])
    later = at[:, 0] > least[of]
    spans = [np.column_stack([at[later, :3], at[later, 2] + length[of[later]] + at[later, 3]])]
    of, at = of[~later], at[~later]
    order = np.argsort(of, kind="stable")
    at, first = at[order], np.searchsorted(of[order], np.arange(len(texts) + 1))
    order = np.argsort(value, kind="stable")
    same = np.r_[False, value[order][1:] == value[order][:-1]]
    met = order[same | np.r_[same[1:], False]]
    group = np.cumsum(np.r_[True, value[met][1:] != value[met][:-1]]) if len(met) else met
    ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) if len(met) else met
    begin, windows = 0, np.cumsum(length[met] - size + 1)
    for end in ends.tolist():
        if windows[end] - (windows[begin - 1] if begin else 0) >= WINDOWS or end == len(met) - 1:
            some = met[begin : end + 1]
            begin = end + 1
            owner, low, high = _later([texts[k] for k in some.tolist()], least[some], size).T
            part = some[owner]
            times = first[part + 1] - first[part]
            rows = np.repeat(first[part], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            start = at[rows, 2]
            spans.append(np.column_stack([at[rows, :2], start + np.repeat(low, times), start + np.repeat(high, times) + at[rows, 3]]))
    return np.concatenate(spans)


def _spans(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    """All spans of a bucket: those its tasks knew, and those that show when its segments meet."""
    release()
    known = [np.frombuffer(p, np.int64).reshape(-1, 4) for p in rows.loc[rows["known"], "packed"]]
    blocks = rows.loc[~rows["known"], "packed"]
    found = np.concatenate([*known, *([_solve(blocks, size)] if len(blocks) else [])])
    return pd.DataFrame(found, columns=["doc", "version", "start", "stop"])


def _version(text: Column) -> Column:
    """A 32-bit mark of the text, for rows that share an id."""
    return F.shiftright(text_key(text), 32)


def repeat_spans(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, version, start, stop): byte spans, overlapping or not, that cover exactly the bytes of every
    ``size``-byte string that also starts in a document with a smaller id.

    ``version`` tells rows with the same id and other text apart; such rows are no sources for each other."""
    if size < PIECE + 8:
        raise ValueError(f"size must be at least {PIECE + 8}")
    return sent_segments(docs, size, doc_id, text).groupBy("bucket").applyInPandas(lambda x: _spans(x, size), SPANS)


def sent_segments(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """(bucket, known, packed): what tasks know, and what has to meet in a bucket."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc"), _version(F.col(text)).alias("version"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    bits = max(16, int(total // 12).bit_length())
    listed, hot, one_of = 1 << bits <= MOST_TABLE_BITS, HOT, ONE_OF
    seen = rows.mapInArrow(partial(_minimizers, size=size, buckets=buckets, listed=listed, one_of=one_of), "bucket int, packed binary, sample binary")
    found = seen.groupBy("bucket").applyInPandas(lambda x: _repeated(x, bits, hot, one_of), "places binary, hot binary")
    flags, many = np.zeros(1 << bits if listed else 0, bool), []
    for row in found.toLocalIterator():
        flags[np.frombuffer(row[0], np.uint32)] = True
        many.append(np.frombuffer(row[1], np.uint64))
    sent = spark.sparkContext.broadcast((np.packbits(flags, bitorder="little"), np.concatenate([np.zeros(0, np.uint64), *many])))
    del flags
    table = lambda: ((sent.value[0], bits) if listed else None, sent.value[1])
    return rows.mapInArrow(partial(_ship, size=size, buckets=buckets, table=table), "bucket int, known boolean, packed binary")


def merged_spans(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of the spans; touching ones are one run."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(zip(starts, stops, strict=True)):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def cut(text: Column, spans: Column) -> Column:
    """(kept, runs): the bytes of a text outside the spans, and the runs that they make, packed as pairs of
    64-bit numbers. Null spans leave all of a text and have null runs; a null text has no bytes."""

    def kept(text: pa.Array, spans: pa.Array) -> pa.Array:
        out, packed = [], []
        for data, found in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            whole, at, parts = (data or "").encode(), 0, []
            runs = merged_spans([s["start"] for s in found], [s["stop"] for s in found]) if found else []
            for start, stop in runs:
                parts.append(whole[at:start])
                at = stop
            out.append(b"".join([*parts, whole[at:]]))
            packed.append(np.array(runs, "<i8").tobytes() if runs else None)
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(packed, pa.binary())], ["kept", "runs"])

    kept.__annotations__ = {"text": pa.Array, "spans": pa.Array, "return": pa.Array}
    return F.arrow_udf(kept, "struct<kept:binary,runs:binary>")(text, spans)


def left_over(text: Column, spans: Column) -> Column:
    """(text, cut): a text without the spans and without characters that a cut splits, and whether it had any.

    Marked as not deterministic, so that a filter on the result does not bring a second run of it in the same task."""

    def kept(text: pa.Array, spans: pa.Array) -> pa.Array:
        out, cut = [], []
        for data, found in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            cut.append(bool(found))
            if found:
                whole, at, parts = (data or "").encode(), 0, []
                for start, stop in merged_spans([s["start"] for s in found], [s["stop"] for s in found]):
                    parts.append(whole[at:start])
                    at = stop
                data = b"".join([*parts, whole[at:]]).decode("utf-8", "ignore")
            out.append(data)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(cut, pa.bool_())], ["text", "cut"])

    kept.__annotations__ = {"text": pa.Array, "spans": pa.Array, "return": pa.Array}
    return F.arrow_udf(kept, "struct<text:string,cut:boolean>").asNondeterministic()(text, spans)


def with_spans(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """``docs`` with the repeated spans of each text in ``__spans``."""
    per = repeat_spans(docs, size, doc_id, text).groupBy("doc", "version").agg(F.collect_set(F.struct("start", "stop")).alias("__spans"))
    per = per.withColumnsRenamed({"doc": "__doc", "version": "__version"})
    on = (F.col(doc_id).cast("bigint") == F.col("__doc")) & (_version(F.col(text)) == F.col("__version"))
    return docs.join(per, on, "left").drop("__doc", "__version")


def without_repeats(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text", kept: str = "kept_bytes", runs: str = "runs") -> DataFrame:
    """``docs`` with the bytes left of each text in ``kept`` and the removed runs, packed as pairs of 64-bit
    numbers, in ``runs`` (null where nothing is removed). Columns of these names are replaced.

    Null, empty and short texts lose nothing; rows without an id are neither sources nor changed; rows that
    repeat an id are no sources for each other, and repeated rows are all treated alike."""
    found = with_spans(docs, size, doc_id, text).withColumn("__cut", cut(F.col(text), F.col("__spans")))
    return found.withColumns({kept: F.col("__cut.kept"), runs: F.col("__cut.runs")}).drop("__spans", "__cut")


def deduplicated_text(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its columns and the repeated passages gone from the text; a character that a cut splits
    goes with it. Documents of which nothing but white space is left are dropped; untouched ones all stay."""
    found = with_spans(docs, size, doc_id, text).withColumn("__left", left_over(F.col(text), F.col("__spans")))
    found = found.withColumn(text, F.col("__left.text")).where(~F.col("__left.cut") | (F.length(F.trim(F.col(text))) > 0))
    return found.drop("__spans", "__left")

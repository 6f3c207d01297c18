"""Cross-entropy difference of two matched n-gram models over one vocabulary.

``scores`` has word models: bigrams interpolated with unigrams and a uniform share, over one vocabulary of all
words (runs without white space) and an end mark. Both models have the same form and count every document: the
chosen ones for the target, all others for the background. A document's own counts are left out of its score. The
score is the mean over its words and its end of the target's loss minus the background's, in nats: low scores are
like the target.

Documents stay in chunks (``packing``). Each chunk sends the distinct words and pairs that it holds, with its
counts in both models, once to the bucket that their hash names; the bucket adds the counts of all chunks and sends
them back in the same order, and the chunk scores its documents. A pair that stands in every document is one entry a
chunk. The number of buckets grows with the corpus; nothing is broadcast but ids under a counted bound. Words and
pairs stand for hashes: the bucket and 40 bits, so that in a bucket of two million a key meets another by chance
with two in a million, at every size.

``byte_scores`` has byte trigrams instead, at most 2^24, which bounds the model whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.functions.spread import join_checked
from proofloom.llm.neardup import mixed
from proofloom.llm.packing import BASES, BUCKET_KEYS, chunks_of, frozen, pack, text_bytes, thawed, unpack, word_bounds, word_hashes
from proofloom.llm.tables import bounded_batches, mapped, release, stored

CODES = 1 << 24
WEIGHTS = (0.7, 0.2, 0.1)
BROADCAST_IDS = 2_000_000


def codes(text: str) -> np.ndarray:
    """The trigram that ends in each byte; two line breaks stand before the text."""
    data = np.frombuffer(b"\n\n" + text.encode(), np.uint8).astype(np.int32)
    return data[:-2] << 16 | data[1:-1] << 8 | data[2:]


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    tables = np.zeros((2, CODES), np.int32)
    for batch in batches:
        for target, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, times = np.unique(codes(text), return_counts=True)
            tables[int(target), found] += times.astype(np.int32)
    at = np.flatnonzero(tables.any(axis=0))
    for some in np.array_split(at, max(1, -(-len(at) // 100_000))):
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(tables[k, some].astype(np.int64)) for k in (1, 0))], ["code", "target", "background"])


def log_probabilities(code: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each trigram's last byte after its first two."""
    three = count.astype(float)
    two, one = np.bincount(code & 0xFFFF, three, 1 << 16), np.bincount(code & 0xFF, three, 256)
    context, single = np.bincount(code >> 8, three, 1 << 16), np.bincount(code >> 8 & 0xFF, three, 256)
    share = lambda part, whole: np.divide(part, whole, out=np.zeros_like(part), where=whole > 0)
    p = WEIGHTS[0] * share(three, context[code >> 8]) + WEIGHTS[1] * share(two[code & 0xFFFF], single[code >> 8 & 0xFF])
    return np.log(p + WEIGHTS[2] * (one[code & 0xFF] + 1) / (three.sum() + 256))


START, END = mixed(np.array([11, 13], np.uint64))
LOW_BITS = 40
LOW = np.uint64((1 << LOW_BITS) - 1)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
ASKED = "bucket int, chunk long, packed binary"
ANSWER = "chunk long, bucket int, packed binary, size long, target long, background long"


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of 64-bit numbers, equal places together."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _codes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash above its low 40 bits; ``buckets`` is below 2^23."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(LOW_BITS) | hashes & LOW


class Pairs(NamedTuple):
    """The words of a chunk, each text between a start and an end, and its pairs of neighbours."""

    n_words: np.ndarray
    word_codes: np.ndarray
    word: np.ndarray
    pair_codes: np.ndarray
    pair: np.ndarray
    at: np.ndarray
    row: np.ndarray
    target: np.ndarray


def _pairs(batch: pa.RecordBatch, buckets: int) -> Pairs:
    """Distinct codes of words and pairs in ascending order, the number of each place's code among them, where the
    pairs start, and the row of every place."""
    data, begins = text_bytes(batch.column(1))
    starts, ends, row = word_bounds(data, begins, SPACE)
    n_words = np.bincount(row, minlength=batch.num_rows)
    full = np.flatnonzero(n_words)
    order = np.cumsum(n_words > 0) - 1
    held = np.empty(len(starts) + 2 * len(full), np.uint64)
    inner = np.arange(len(starts)) + 2 * order[row] + 1
    edge = np.ones(len(held), bool)
    edge[inner] = False
    held[inner] = word_hashes(data, starts, ends)
    marks = np.flatnonzero(edge)
    held[marks[0::2]], held[marks[1::2]] = START, END
    last = np.zeros(len(held), bool)
    last[marks[1::2]] = True
    at = np.flatnonzero(~last)
    word_codes, word = np.unique(_codes(held, buckets), return_inverse=True)
    pair_codes, pair = np.unique(_codes(mixed(held[at] * BASES[0] + held[at + 1]), buckets), return_inverse=True)
    target = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
    return Pairs(n_words, word_codes, word, pair_codes, pair, at, np.repeat(full, n_words[full] + 2), target)


def _freeze(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk, batch in chunks_of(batches):
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([frozen(batch)], pa.binary())], ["chunk", "body"])


def _cuts(codes: np.ndarray) -> dict[int, slice]:
    """Where the codes of each bucket stand."""
    bucket = (codes >> np.uint64(LOW_BITS)).astype(np.int64)
    found, first = np.unique(bucket, return_index=True)
    return {k: slice(a, b) for k, a, b in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(codes)], strict=True)}


def _ask(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """What each chunk counts of the words and pairs of a bucket, in both models."""
    release()
    for batch in batches:
        for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held = _pairs(thawed(body.as_py()), buckets)
            kinds = []
            for codes, of, row in ((held.word_codes, held.word, held.row), (held.pair_codes, held.pair, held.row[held.at])):
                both = np.bincount(of, minlength=len(codes))
                target = np.bincount(of[held.target[row]], minlength=len(codes))
                kinds.append((codes & LOW, target, both - target, _cuts(codes)))
            named = sorted({k for kind in kinds for k in kind[3]})
            packed = []
            for k in named:
                parts = []
                for low, target, background, cuts in kinds:
                    some = cuts.get(k, slice(0))
                    parts += [_planes(np.diff(low[some], prepend=np.uint64(0)), 5), _planes(target[some], 4), _planes(background[some], 4)]
                packed.append(pack(*parts))
            if named:
                yield pa.RecordBatch.from_arrays([pa.array(named, pa.int32()), pa.array([chunk] * len(named), pa.int64()), pa.array(packed, pa.binary())], ["bucket", "chunk", "packed"])


def _count(asked: pa.Table, start: int) -> pa.Table:
    """For each chunk the counts over all chunks, and one row for the bucket: distinct words and all words of both
    models, without the start."""
    bucket = int(asked.column("bucket")[0].as_py())
    parts = [unpack(x.as_py()) for x in asked.column("packed")]
    answers: list[list[bytes]] = [[] for _ in parts]
    sums = [0, 0, 0]
    for kind in (0, 3):
        codes = [np.cumsum(_numbers(p[kind], 5), dtype=np.uint64) for p in parts]
        found, of = np.unique(np.concatenate(codes), return_inverse=True)
        totals = [np.bincount(of, np.concatenate([_numbers(p[kind + k], 4) for p in parts]), len(found)).astype(np.int64) for k in (1, 2)]
        if kind == 0:
            word = np.flatnonzero(found != np.uint64(start & int(LOW))) if start >> LOW_BITS == bucket else slice(None)
            sums = [len(found[word]), *(int(t[word].sum()) for t in totals)]
        done = 0
        for k, own in enumerate(codes):
            some = of[done : done + len(own)]
            answers[k] += [_planes(t[some], 8) for t in totals]
            done += len(own)
    chunks = asked.column("chunk").to_pylist()
    columns = [[*chunks, None], [bucket] * (len(chunks) + 1), [*(pack(*a) for a in answers), None]]
    one = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)]
    rest = [pa.array([None] * len(chunks) + [n], pa.int64()) for n in sums]
    return pa.table([*one, *rest], ["chunk", "bucket", "packed", "size", "target", "background"])


def _own(row: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How often each place's code stands in its own row."""
    _, which, times = np.unique(row * n + of, return_inverse=True, return_counts=True)
    return times[which]


def _score(body: pa.Table, said: pa.Table, buckets: int, size: int, totals: tuple[int, int], left_out: bool) -> pa.Table:
    batch = thawed(body.column("body")[0].as_py())
    held = _pairs(batch, buckets)
    parts = {k: unpack(p) for k, p in zip(said.column("bucket").to_pylist(), said.column("packed").to_pylist(), strict=True)}
    order = sorted(parts)
    counts = [np.concatenate([np.zeros(0, np.uint64), *(_numbers(parts[k][kind], 8) for k in order)]).astype(np.int64) for kind in range(4)]
    row, word = held.row[held.at], held.word
    before, after = word[held.at], word[held.at + 1]
    own_word = _own(held.row, word, len(held.word_codes))
    own = (_own(row, held.pair, len(held.pair_codes)), own_word[held.at], own_word[held.at + 1], held.n_words[row] + 1)
    logs = []
    for k, mine in ((0, held.target[row]), (1, ~held.target[row])):
        less = mine * int(left_out)
        pair, first, second, all_words = (c - less * o for c, o in zip((counts[2 + k][held.pair], counts[k][before], counts[k][after], totals[k]), own, strict=True))
        share = lambda part, whole: np.divide(part, whole, out=np.zeros(len(row)), where=whole > 0)
        logs.append(np.log(WEIGHTS[0] * share(pair, first) + WEIGHTS[1] * share(second, all_words) + WEIGHTS[2] / max(size, 1)))
    sums = np.bincount(row, logs[1] - logs[0], batch.num_rows)
    mean = np.round(sums / (held.n_words + 1), 6)
    return pa.table([batch.column(0), pa.array(held.n_words, pa.int64()), pa.array(mean, pa.float64(), mask=held.n_words == 0)], ["doc_id", "n_tokens", "target_loss_minus_background"])


def scores(docs: DataFrame, chosen: DataFrame, doc_id: str = "doc_id", text: str = "text", left_out: bool = True) -> DataFrame:
    """(doc_id, n_tokens, target_loss_minus_background), a row for every row of ``docs``.

    ``chosen`` names the target documents by ``doc_id``; repeated and null ids in it add nothing. With ``left_out``
    a row is scored by the counts of all other rows, so that the score does not repeat the label. Null texts and
    texts without a word have no tokens and a null score; repeated rows count as often as they stand there, and
    each leaves out itself alone. Empty tables give no rows; other columns are not read."""
    bounded_batches(docs.sparkSession)
    ids = chosen.select(F.col("doc_id").alias("__id"), F.lit(True).alias("__target")).where("__id IS NOT NULL").distinct()
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text"))
    flagged = join_checked(rows, ids, ["__id"], ["__text"], "left", max_rows=BROADCAST_IDS)
    flagged = flagged.select("__id", "__text", F.coalesce("__target", F.lit(False)).alias("__target"))
    total = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    buckets = max(1, -(-total // (4 * BUCKET_KEYS)))
    body = stored(flagged.mapInArrow(_freeze, "chunk long, body binary"), "chunks")
    start = int(_codes(np.array([START]), buckets)[0])
    counted = body.mapInArrow(partial(_ask, buckets=buckets), ASKED).groupBy("bucket").applyInArrow(lambda t: _count(t, start), ANSWER)
    counted = stored(counted, "word-counts")
    size, target, background = counted.agg(F.sum("size"), F.sum("target"), F.sum("background")).first()
    said = counted.where("chunk IS NOT NULL").select("chunk", "bucket", "packed")
    judge = partial(_score, buckets=buckets, size=size or 0, totals=(target or 0, background or 0), left_out=left_out)
    kind = docs.schema[doc_id].dataType.simpleString()
    return body.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(lambda b, s: judge(b, s), f"doc_id {kind}, n_tokens long, target_loss_minus_background double")


def byte_scores(docs: DataFrame, chosen: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss_minus_background), a row for every row of ``docs``.

    ``chosen`` names the target documents by ``doc_id``; repeated and null ids in it add nothing. Null and empty texts have
    no tokens and a null score; repeated rows count as often as they stand there."""
    ids = chosen.select(F.col("doc_id").alias("__id"), F.lit(True).alias("__target")).where("__id IS NOT NULL").distinct()
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    flagged = rows.join(few, rows["doc_id"] == F.col("__id"), "left").select(F.coalesce("__target", F.lit(False)).alias("target"), "text").where("length(text) > 0")
    counted = flagged.mapInArrow(_counts, "code int, target long, background long")
    found = counted.groupBy("code").agg(F.sum("target").alias("target"), F.sum("background").alias("background")).toPandas()
    code = found["code"].to_numpy(np.int64)
    gap = log_probabilities(code, found["background"].to_numpy()) - log_probabilities(code, found["target"].to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast((code.astype(np.int32), gap.astype(np.float32)))

    def make() -> Callable[[pa.Array], pa.Array]:
        table = np.zeros(CODES, np.float32)
        table[sent.value[0]] = sent.value[1]

        def one(batch: pa.Array) -> pa.Array:
            out = [(0, None) if not t else (len(c := codes(t)), round(float(table[c].mean(dtype=np.float64)), 6)) for t in batch.to_pylist()]
            return pa.StructArray.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], pa.float64())], ["n", "score"])

        return one

    return rows.select("doc_id", mapped(make, "struct<n:bigint,score:double>")(F.col("text")).alias("f")).select("doc_id", F.col("f.n").alias("n_tokens"), F.col("f.score").alias("target_loss_minus_background"))

"""Phrases whose words stand together more often than their parts alone would, counted exactly by level.

Words that reach the least count get numbers; pairs of such words are packed into one key and counted in counting
quotient filters (``quotient``), one for each chunk of documents. Each filter is cut by the first bits of its
permuted keys; the parts of all chunks with the same bits merge in one task, sorted as they are. Pairs that reach
the least count get numbers too, and a phrase of three words is the number of its first pair and its third word,
counted where both its pairs are frequent, since no other phrase of three words can be. Each level sends a chunk
the numbers of its own frequent words or pairs, so no vocabulary is broadcast or gathered, and a word that stands
in every document is one entry a chunk. Numbers of words and of pairs may take up to 32 bits each.

Words are counted as such in the first level: they travel themselves, not as hashes, so no two are taken as one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.spread import first_rows
from proofloom.llm.packing import BUCKET_KEYS, bits, chunks_of, from_bits, from_gaps, gaps, pack, text_bytes, unpack
from proofloom.llm.quotient import QuotientFilter
from proofloom.llm.tables import bounded_batches, stored

WORD_BUCKET_BYTES = 32 << 20
MERGED_PARTS = 16
BREAKS = b".,;:!?\n\x0b\x0c\r"
TRANSLATE = bytes.maketrans(BREAKS + b"\t" + bytes(range(65, 91)), b"." * len(BREAKS) + b" " + bytes(range(97, 123)))
PARTS = "chunk long, bucket int, lang string, n long, packed binary"
WORDS = "chunk long, bucket int, packed binary, lang string, id long, word binary, f long"
PAIRS = "chunk long, bucket int, packed binary, id long, first long, second long, f long"
KINDS = {"chunk": pa.int64(), "bucket": pa.int32(), "lang": pa.string(), "n": pa.int64(), "packed": pa.binary(), "id": pa.int64(), "word": pa.binary(), "f": pa.int64(), "first": pa.int64(), "second": pa.int64()}


def _table(names: str, **columns: object) -> pa.Table:
    """A table of the named columns; those not given are null."""
    size = len(next(iter(columns.values())))
    given = [part.split()[0] for part in names.split(", ")]
    return pa.table({name: pa.array(columns[name], KINDS[name]) if name in columns else pa.nulls(size, KINDS[name]) for name in given})


def _split(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """For each language of a chunk the sequence of its words by local numbers, and per bucket its distinct words
    and their counts. Number 0 ends a piece."""
    n = 0
    for chunk, batch in chunks_of(batches):
        data, begins = text_bytes(batch.column(1))
        whole, at = data.tobytes(), begins.tolist()
        own: dict[str, list[bytes]] = {}
        for lang, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
            own.setdefault(lang, []).append(whole[a:b])
        for lang in sorted(own):
            words = b".".join(own[lang]).translate(TRANSLATE).replace(b".", b" . ").split()
            found = sorted(set(words) - {b"."})
            bucket = np.fromiter((zlib.crc32(w) for w in found), np.int64, len(found)) % buckets
            order = np.argsort(bucket, kind="stable")
            number = dict(zip((found[k] for k in order.tolist()), range(1, len(found) + 1), strict=True)) | {b".": 0}
            ids = np.fromiter(map(number.__getitem__, words), np.uint32, len(words))
            times = np.bincount(ids, minlength=len(found) + 1)[1:]
            sizes = np.bincount(bucket, minlength=buckets)
            unit = chunk >> 32 << 32 | n
            n += 1
            packed, kinds, cut = [pack(ids.view(np.uint8).reshape(-1, 4).T.tobytes(), sizes.tobytes())], [None], 0
            for k in np.flatnonzero(sizes).tolist():
                some = order[cut : cut + sizes[k]].tolist()
                packed.append(pack(b" ".join([found[j] for j in some]), times[cut : cut + sizes[k]].tobytes()))
                kinds.append(k)
                cut += int(sizes[k])
            one = _table(PARTS, chunk=[unit] * len(packed), bucket=kinds, lang=[lang] * len(packed), n=[int(times.sum()), *[0] * (len(packed) - 1)], packed=packed)
            yield from one.to_batches()


def _number(answers: list[np.ndarray], total: int, bucket: int, buckets: int) -> tuple[list[bytes], np.ndarray]:
    """Numbers for the frequent entries of a bucket, and for each chunk those of its own (0: not frequent).
    ``answers`` hold ranks in ascending order, or -1."""
    said = [pack(bits(a >= 0), gaps(a[a >= 0].astype(np.uint32))) for a in answers]
    return said, 1 + np.arange(total, dtype=np.int64) * buckets + bucket


def _said(packed: bytes, n: int, bucket: int, buckets: int) -> np.ndarray:
    flags, ranks = unpack(packed)
    out = np.zeros(n, np.uint64)
    out[from_bits(flags, n)] = 1 + from_gaps(ranks).astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket)
    return out


def _count_words(asked: pa.Table, least: int, buckets: int) -> pa.Table:
    """The frequent words of a bucket with their counts and numbers, and for each chunk the numbers of its words."""
    counts: dict[str, dict[bytes, int]] = {}
    rows = []
    for lang, packed in zip(asked.column("lang").to_pylist(), asked.column("packed"), strict=True):
        words, times = unpack(packed.as_py())
        rows.append((lang, words.split(b" ")))
        held = counts.setdefault(lang, {})
        for word, n in zip(rows[-1][1], np.frombuffer(times, np.int64).tolist(), strict=True):
            held[word] = held.get(word, 0) + n
    bucket = int(asked.column("bucket")[0].as_py())
    frequent = [(lang, word, held[word]) for lang, held in sorted(counts.items()) for word in sorted(held) if held[word] >= least]
    rank = {(lang, word): k for k, (lang, word, _) in enumerate(frequent)}
    said, ids = _number([np.fromiter((rank.get((lang, w), -1) for w in words), np.int64, len(words)) for lang, words in rows], len(frequent), bucket, buckets)
    langs, words, times = ([f[k] for f in frequent] for k in range(3))
    return pa.concat_tables([_table(WORDS, chunk=asked.column("chunk").to_pylist(), bucket=[bucket] * len(said), packed=said), _table(WORDS, lang=langs, id=ids, word=words, f=times)])


def _words(body: pa.Table, said: pa.Table, buckets: int) -> np.ndarray:
    """The sequence of a chunk by the numbers of frequent words, 0 elsewhere."""
    planes, sizes = unpack(body.column("packed")[0].as_py())
    local = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    size = np.frombuffer(sizes, np.int64)
    answers = dict(zip(said.column("bucket").to_pylist(), said.column("packed").to_pylist(), strict=True))
    parts = [_said(answers[k], int(size[k]), k, buckets) for k in np.flatnonzero(size).tolist()]
    return np.concatenate([np.zeros(1, np.uint64), *parts])[local]


def _filter(first: np.ndarray, second: np.ndarray, low: int, width: int) -> tuple[QuotientFilter, np.ndarray, np.ndarray]:
    """The filter of neighbours that both have numbers, where they start, and the entry of each."""
    at = np.flatnonzero((first > 0) & (second > 0))
    counted, of = QuotientFilter.of(first[at] << np.uint64(low) | second[at], width)
    return counted, at, of


def _sent(chunk: int, counted: QuotientFilter, prefix: int) -> pa.Table:
    rows = [(k, counted.packed(prefix, a, b)) for k, a, b in counted.parts(prefix)]
    return _table("chunk long, bucket int, packed binary", chunk=[chunk] * len(rows), bucket=[r[0] for r in rows], packed=[r[1] for r in rows])


def _pairs(body: pa.Table, said: pa.Table, buckets: int, low: int, prefix: int) -> pa.Table:
    if not body.num_rows:
        return _sent(0, QuotientFilter.of(np.zeros(0, np.uint64), 2 * low)[0], prefix)
    words = _words(body, said, buckets)
    return _sent(body.column("chunk")[0].as_py(), _filter(words[:-1], words[1:], low, 2 * low)[0], prefix)


def _triples(body: pa.Table, said: pa.Table, buckets: int, low: int, pair_bits: int, prefix: int) -> pa.Table:
    if not body.num_rows:
        return _sent(0, QuotientFilter.of(np.zeros(0, np.uint64), pair_bits + low)[0], prefix)
    level = said.column("level").to_numpy()
    words = _words(body, said.filter(pa.array(level == 1)), buckets)
    counted, at, of = _filter(words[:-1], words[1:], low, 2 * low)
    known = said.filter(pa.array(level == 2))
    answers = dict(zip(known.column("bucket").to_pylist(), known.column("packed").to_pylist(), strict=True))
    number = np.concatenate([np.zeros(0, np.uint64), *(_said(answers[k], b - a, k, 1 << prefix) for k, a, b in counted.parts(prefix))])
    pair = np.zeros(len(words), np.uint64)
    pair[at] = number[of]
    both = np.where(pair[1:] > 0, pair[:-1], 0)
    return _sent(body.column("chunk")[0].as_py(), _filter(both[:-1], words[2:], low, pair_bits + low)[0], prefix)


def _count(asked: pa.Table, least: int, low: int, prefix: int, answer: bool) -> pa.Table:
    """The frequent entries of merged filters with their counts and numbers, and for each chunk those of its own."""
    parts = [QuotientFilter.unpacked(x.as_py()) for x in asked.column("packed")]
    whole = QuotientFilter.merged(parts)
    bucket = int(asked.column("bucket")[0].as_py())
    good = np.flatnonzero(whole.counts >= least)
    rank = np.full(len(whole.held), -1, np.int64)
    rank[good] = np.arange(len(good))
    said, ids = _number([rank[np.searchsorted(whole.held, p.held)] for p in parts] if answer else [], len(good), bucket, 1 << prefix)
    keys = whole.keys()[good]
    first, second = (keys >> np.uint64(low)).astype(np.int64), (keys & np.uint64((1 << low) - 1)).astype(np.int64)
    chunks = asked.column("chunk").to_pylist() if answer else []
    return pa.concat_tables([_table(PAIRS, chunk=chunks, bucket=[bucket] * len(chunks), packed=said), _table(PAIRS, id=ids, first=first, second=second, f=whole.counts[good])])


def _bits(df: DataFrame) -> int:
    """How many bits the numbers of a level need."""
    width = int(df.agg(F.max("id")).first()[0] or 1).bit_length()
    if width > 32:
        raise ValueError("more than 32 bits of frequent words or pairs")
    return width


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(38,0)")
    top, below = (F.lit(1_000_000).cast("decimal(38,0)") * wide(a) * wide(a)), wide(left) * wide(right)
    return F.call_function("div", top, below)


def counted_phrases(docs: DataFrame, least: int = 10, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words (lang, id, word, f), pairs (id, first, second, f), triples (pair, third, f) that reach the least
    count, and the number of all words (lang, n)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // WORD_BUCKET_BYTES))
    prefix = max(0, -(-total // (6 * BUCKET_KEYS)) - 1).bit_length()
    parts = stored(rows.mapInArrow(partial(_split, buckets=buckets), PARTS), "word-parts")
    body = parts.where("bucket IS NULL").select("chunk", "packed")
    asked = parts.where("bucket IS NOT NULL").select("chunk", "bucket", "lang", "packed")
    level1 = stored(asked.groupBy("bucket").applyInArrow(lambda t: _count_words(t, least, buckets), WORDS), "words")
    words = level1.where("chunk IS NULL").select("lang", "id", F.col("word").cast("string").alias("word"), "f")
    low = _bits(words)
    prefix = min(prefix, low)
    kept = lambda answer: lambda t: _count(t, least, low, prefix, answer)
    said = level1.where("chunk IS NOT NULL").select("chunk", "bucket", "packed", F.lit(1).alias("level"))
    sent = body.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(partial(_pairs, buckets=buckets, low=low, prefix=prefix), "chunk long, bucket int, packed binary")
    level2 = stored(sent.groupBy("bucket").applyInArrow(kept(True), PAIRS), "pairs")
    pairs = level2.where("chunk IS NULL").select("id", "first", "second", "f")
    pair_bits = _bits(pairs)
    said = said.unionByName(level2.where("chunk IS NOT NULL").select("chunk", "bucket", "packed", F.lit(2).alias("level")))
    sent = body.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(partial(_triples, buckets=buckets, low=low, pair_bits=pair_bits, prefix=prefix), "chunk long, bucket int, packed binary")
    level3 = stored(sent.groupBy("bucket").applyInArrow(kept(False), PAIRS), "triples")
    triples = level3.select(F.col("first").alias("pair"), F.col("second").alias("third"), "f")
    return words, pairs, triples, parts.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = 10, share: int = 50, most: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language its ``most`` highest phrases of two or three words
    that occur ``least`` times, without those that a longer phrase holds with ``share`` hundredths of their count.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line breaks, words at blanks and tabs, and phrases stay
    inside a piece. ``a`` counts the phrase, ``l`` and ``r`` its parts before and after the cut with the lowest
    score, the first of equals; ``n`` counts all words. A null language is ``und``, null and empty texts have no
    words, repeated rows count as often as they stand there. Ties go to the higher ``a``, then to the smaller
    phrase. Counts and scores are exact. Empty tables give an empty result; other columns are not read."""
    words, pairs, triples, totals = counted_phrases(docs, least, text, lang)
    named = lambda k: words.select(F.col("id").alias(k), F.col("lang").alias("lang" + k), F.col("word").alias("word" + k), F.col("f").alias("f" + k))
    two = pairs.select(F.col("id").alias("pair"), F.col("first").alias("1"), F.col("second").alias("2"), F.col("f").alias("f12")).join(named("1"), "1")
    two = stored(two.join(named("2"), "2"), "named-pairs")
    three = triples.withColumnsRenamed({"third": "3", "f": "a"}).join(two, "pair")
    three = three.join(two.select(F.col("1").alias("2"), F.col("2").alias("3"), F.col("f12").alias("f23"), F.col("word2").alias("word3"), F.col("f2").alias("f3")), ["2", "3"])
    three = stored(three, "named-triples")
    holding = three.select(F.explode(F.array(F.struct("1", "2"), F.struct(F.col("2").alias("1"), F.col("3").alias("2")))).alias("p"), "a").groupBy("p.1", "p.2").agg(F.max("a").alias("longer"))
    alone = two.join(holding, ["1", "2"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("f12"), F.lit(True)))
    pair_rows = alone.select(
        F.col("lang1").alias("lang"), F.concat_ws(" ", "word1", "word2").alias("phrase"), F.col("f12").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), _score(F.col("f12"), F.col("f1"), F.col("f2")).alias("score")
    )
    one, other = _score(F.col("a"), F.col("f1"), F.col("f23")), _score(F.col("a"), F.col("f12"), F.col("f3"))
    early = F.col("one") <= F.col("other")
    triple_rows = three.withColumn("one", one).withColumn("other", other).select(
        F.col("lang1").alias("lang"),
        F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"),
        "a",
        F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"),
        F.least("one", "other").alias("score"),
    )
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    dealt = pair_rows.unionByName(triple_rows).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(MERGED_PARTS)))
    best = first_rows(first_rows(dealt, ["lang", "part"], order, most, "own").drop("own", "part"), ["lang"], order, most)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

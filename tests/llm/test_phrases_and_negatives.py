"""Collocations, quotient filters and hard negatives against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.llm import collocations, negatives, quotient, search


def brute_phrases(rows, least, most):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate({k: k + 32 for k in range(65, 91)})):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts[lang].update(tuple(w[k : k + s]) for s in (1, 2, 3) for k in range(len(w) - s + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            held = len(p) == 2 and any(len(q) == 3 and b >= least and 100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in f.items())
            if len(p) > 1 and a >= least and not held:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, total[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:most])]
    return sorted(out)


def test_phrases_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collocations, "WORD_BUCKET_BYTES", 2000)
    monkeypatch.setattr(collocations, "BUCKET_KEYS", 100)
    rnd = random.Random(4)
    words = ["the", "The", "bank", "bänk", "river", "漢字", "x" * 300, "a\x00b", "–"]
    rows = [("en", None), (None, "a b a b"), (None, None), ("de", ""), ("fr", " \t \n"), ("es", "one, two. three")]
    for k in range(150):
        text = "".join(rnd.choice(words[: 3 + k % 7]) + rnd.choice([" ", " ", " ", "\t", ". ", ",", "\x0b", "  "]) for _ in range(rnd.randrange(80)))
        rows.append((rnd.choice(["en", "de", None, "und", "l\n x"]), text + rnd.choice(["", "new york city ", "york city"])))
    rows += [rows[-1], rows[-1], ("en", "in spite of " * 3000)]
    df = spark.createDataFrame([(*r, "p", "a", 1) for r in rows], "lang string, text string, phrase string, f string, id int")
    for least, most in ((10, 2000), (3, 4)):
        got = sorted(tuple(r) for r in collocations.collocations(df.repartition(3), least, most=most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == brute_phrases(rows, least, most)
    assert collocations.collocations(df.where("false")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**12 + 7, 10**12 + 11, 10**12 + 13), (3, 3, 3), (10, 10**12, 10**12)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [r.s for r in got] == [10**6 * a * a // (x * y) for a, x, y in rows]


@pytest.mark.parametrize("bits", [1, 2, 7, 33, 64])
def test_quotient_filter_loses_nothing(bits):
    rnd = random.Random(bits)
    keys = np.array([rnd.getrandbits(bits) for _ in range(500)], np.uint64)
    assert (quotient.permuted(quotient.permuted(keys, bits), bits, back=True) == keys).all()
    if bits <= 7:
        every = np.arange(1 << bits, dtype=np.uint64)
        assert sorted(quotient.permuted(every, bits).tolist()) == every.tolist()
    shards = [np.r_[keys[rnd.randrange(400) :], np.repeat(keys[:3], rnd.choice([1, 254, 255, 70_000]))] for _ in range(5)]
    filters = [quotient.QuotientFilter.of(s, bits)[0] for s in shards]
    want = Counter(np.concatenate(shards).tolist())
    for prefix in {0, 1, min(bits, 4)}:
        sent = defaultdict(list)
        for f in filters:
            for k, a, b in f.parts(prefix):
                sent[k].append(quotient.QuotientFilter.unpacked(f.packed(prefix, a, b)))
        merged = [quotient.QuotientFilter.merged(parts) for parts in sent.values()]
        assert dict(kv for m in merged for kv in zip(m.keys().tolist(), m.counts.tolist(), strict=True)) == want
        assert all(m.count(k) in (0, want[k]) for m in merged for k in want) and sum(m.count(int(keys[0])) for m in merged) == want[int(keys[0])]


def brute_negatives(rows, anchors, positives, k):
    rows = sorted({(i, l, tuple(v)) for i, l, v in rows if None not in (i, l, v)})
    dot = lambda v, w: sum(a * b for a, b in zip(v, w, strict=True))
    out = []
    for a, la, va in rows:
        if a not in anchors:
            continue
        others = [(-dot(va, v), i, label) for i, label, v in rows if i != a and len(v) == len(va)]
        for p, pid, label in sorted(o for o in others if o[2] == la)[:positives]:
            near = sorted((s, i) for s, i, label in others if label != la and 30 * -p <= 100 * -s <= 90 * -p)[:k]
            out += [(a, pid, r + 1, i, -p, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD_ROWS", 40)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 4)
    rnd = random.Random(9)
    rows = [(k, rnd.randrange(3), [rnd.randrange(-40, 90) for _ in range(5)]) for k in range(150)]
    rows += [(200 + k, 1, [9, 9, 9, 9, 9]) for k in range(60)] + [(300, None, [1] * 5), (None, 1, [1] * 5), (301, 1, None), (302, 1, [1, 2]), (303, 2, [1, 2]), (304, 1, []), (305, 2, []), (306, 2, [0] * 5)]
    rows += [rows[0], rows[10], (10, 2, [5] * 5), (10, 1, [80] * 5), (310, 1, [2**25, 2**26, 1, 0, 3])]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, label int, vector array<long>, score string, rank int")
    anchors = {0, 10, 20, 205, 302, 304, 306, 310}
    for positives, k in ((5, 10), (2, 1)):
        found = negatives.hard_negatives(df.repartition(4), df.where(F.col("vec_id").isin(*anchors)), positives, k)
        assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows, anchors, positives, k)
    assert negatives.hard_negatives(df.where("false"), df).count() == negatives.hard_negatives(df, df.where("false")).count() == 0
    odd = spark.createDataFrame([(1, [None, 1.0]), (2, [math.nan, 1.0]), (3, [math.inf, 1.0]), (4, None), (5, [0.5, -0.001])], "id int, e array<double>")
    assert [r.v for r in odd.select(search.scaled(F.col("e")).alias("v")).collect()] == [None, None, None, None, [128, -1]]


def test_the_tree_covers_and_skips():
    rnd = np.random.default_rng(3)
    middle = rnd.integers(-200, 200, (12, 16))
    vectors = (middle[rnd.integers(0, 12, 2000)] + rnd.integers(-3, 4, (2000, 16))).astype(np.int64)
    tree = negatives.CoverTree(vectors)
    leaves = [n for n in tree.nodes if n.members is not None]
    assert sorted(np.concatenate([n.members for n in leaves]).tolist()) == list(range(2000))
    for n in leaves:
        assert (np.linalg.norm(tree.points[n.members] - n.centre, axis=1) <= n.radius + 1e-9).all()
    seen = []
    real = negatives.exact
    negatives.exact = lambda q, v: lambda rows: seen.append(len(rows)) or real(q, v)(rows)
    try:
        ids = np.arange(2000)
        (_, row, score), *_ = tree.descend(vectors[5], np.array([-(1 << 62)]), np.array([1 << 62]), 7, ids, ids != 5)
    finally:
        negatives.exact = real
    want = sorted(zip((-(vectors @ vectors[5])).tolist(), ids.tolist(), strict=True))
    assert [(-s, i) for s, i in zip(score.tolist(), row.tolist(), strict=True)] == [w for w in want if w[1] != 5][:7]
    assert sum(seen) < 600
    with pytest.raises(ValueError, match="64 bits"):
        negatives.exact(np.array([2**31, 2**31]), np.array([[2**31, 2**31]]))

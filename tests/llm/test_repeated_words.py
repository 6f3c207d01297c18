"""Passages of words against brute force."""

import random
import re

from proofloom.llm import blocks, packing
from tests.llm.test_operators import odd_rows

SCHEMA = "doc_id long, text string, kept string, n_words string, chunk string"


def brute(rows, size):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - size + 1):
            if doc is not None:
                first[tuple(w[k : k + size])] = min(doc, first.get(tuple(w[k : k + size]), doc))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {j for k in range(len(w) - size + 1) if doc is not None and first[tuple(w[k : k + size])] < doc for j in range(k, k + size)}
        spans = [(j, next(e for e in range(j, len(w) + 1) if e not in gone)) for j in sorted(gone) if j - 1 not in gone]
        out.append((str(doc), len(w), len(gone), spans, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_passages_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(blocks, "BUCKET_KEYS", 300)
    rnd = random.Random(11)
    word = lambda: rnd.choice(["a", "bb", "Ünï", "c" * 70, "ddd"]) + str(rnd.randrange(9))
    passage = [word() for _ in range(90)]
    rows = [(k, t) for k, t, *_ in odd_rows()]
    for k in range(60):
        a = rnd.randrange(60)
        own = [[word() for _ in range(rnd.randrange(40))] for _ in range(2)]
        rows.append((rnd.randrange(200), rnd.choice([" ", "\n", "\t \x0b"]).join([*own[0], *passage[a : a + rnd.randrange(8, 30)], *own[1], *passage[:20]])))
    rows += [rows[-1], rows[-1], (None, rows[-2][1]), (-5, rows[-3][1]), (900, "x " * 5000), (901, "x " * 70)]
    df = spark.createDataFrame([(d, t, "k", "n", "c") for d, t in rows], SCHEMA)
    for size in (2, 7, 10):
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, [tuple(s) for s in r.spans], r.kept) for r in blocks.without_passages(df.repartition(3), size).collect())
        assert got == brute(rows, size)
    assert blocks.without_passages(df.where("false")).count() == 0
    assert blocks.without_passages(df.where("text is null")).collect()[0].kept == ""


def test_a_shared_passage_is_one_entry_a_chunk(spark):
    rows = [(k, f"only{k} " + " ".join(f"w{j}" for j in range(60))) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    frozen = df.mapInArrow(blocks._freeze, "chunk long, body binary").collect()
    p = blocks.probes(blocks.read(frozen[0].body), 25, 1)
    assert len(p.codes) < 40 + len(set(p.at)) // 10 and len(frozen) == 2
    got = blocks.without_passages(df).selectExpr("n_removed", "kept", "doc_id").collect()
    assert {(r.n_removed, r.kept) for r in got if r.doc_id} == {(60, f"only{r.doc_id}") for r in got if r.doc_id}

import math
import random

import pytest
from pyspark.sql import functions as F

from proofloom.operators import chunking as ch
from proofloom.operators import fusion, lexical
from proofloom.operators.semantic import semantic_top_k, split_by_dimension
from proofloom.plans import retrieve
from proofloom.session import checkpoint_root

BOXES = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def chunk_rows(spark, texts, doc=1):
    rows = [(doc, i, f"chunk_{i}", 0, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, chunk_index int, chunk_id string, page_num int, text string")


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_bm25_hand_case(spark):
    chunks = chunk_rows(spark, [
        "the loan amount is ten million", "interest rate and loan margin",
        "the borrower repays quarterly", "signing date and maturity date",
    ])
    rows = retrieve.bm25(ask(spark, "loan amount amount"), chunks, 4).orderBy("rank").collect()
    assert [r["chunk_index"] for r in rows] == [0, 1, 2, 3]
    assert [round(r["score"], 6) for r in rows] == [1.554675, 0.0, 0.0, 0.0]


def test_bm25_floored_idf_ranks_zero_first(spark):
    index = lexical.build_index(chunk_rows(spark, ["a b", "a c", "a d"]))
    stats = index.doc_stats.first()
    assert stats["mean_idf"] == pytest.approx(-0.103358, abs=1e-6)
    weights = lexical.term_weights(index, lexical.query_terms(ask(spark, "a"))).collect()
    assert all(w["weight"] == pytest.approx(-0.025840, abs=1e-5) for w in weights)


def test_zero_rows_go_before_negative_ones(spark):
    chunks = chunk_rows(spark, ["a b", "a c", "a d", "x y"])
    rows = retrieve.bm25(ask(spark, "a"), chunks, 2).orderBy("rank").collect()
    brute = {i: 0.0 for i in range(4)}
    assert rows[0]["score"] >= rows[1]["score"] and len(rows) == 2 and set(brute) >= {r["chunk_index"] for r in rows}


def test_bm25_against_brute_force_over_segments(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT", 4)
    words = ["red", "blue", "green", "loan", "rate", "date"]
    texts = [" ".join(words[(i * j) % 6] for j in range(1, 2 + i % 5)) for i in range(23)]
    docs = [t.split() for t in texts]
    query = ["loan", "rate", "loan"]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {w: sum(w in d for d in docs) for w in {w for d in docs for w in d}}
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    score = [
        round(sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query), 9)
        for d in docs
    ]
    expected = sorted(range(n), key=lambda i: (-score[i], i))[:9]
    rows = retrieve.bm25(ask(spark, " ".join(query)), chunk_rows(spark, texts), 9).orderBy("rank").collect()
    assert [r["chunk_index"] for r in rows] == expected
    assert [r["score"] for r in rows] == pytest.approx([score[i] for i in expected], abs=1e-8)


def test_block_bounds_skip_segments_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT", 4)
    rnd = random.Random(12)
    common, rare = ["the", "of", "loan"], ["margin", "cap", "floor", "swap"]
    texts = [" ".join([*rnd.choices(common, k=rnd.randrange(3, 9)), *([rnd.choice(rare)] * rnd.randrange(0, 3) if k % 7 == 0 else [])]) for k in range(90)]
    index = lexical.build_index(chunk_rows(spark, texts))
    asked = ["margin cap", "the of", "the margin", "nothing", "swap swap of", ""]
    scores = {(r["query_id"], r["chunk_index"]): r["score"] for r in lexical.hit_scores(index, ask(spark, *asked)).collect()}
    for k in (1, 3):
        got = sorted((r["query_id"], r["rank"], r["chunk_index"], r["score"]) for r in lexical.bm25_top_k(ask(spark, *asked), index, k).collect())
        want = []
        for q in range(len(asked)):
            best = sorted(((-scores.get((q, c), 0.0), c) for c in range(len(texts))))[:k]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
        assert got == [(q, r, c, s + 0.0) for q, r, c, s in want]
    blocks = lexical.wanted_blocks(index, lexical.query_terms(ask(spark, "margin cap")))
    marked = lexical.open_segments(blocks, lexical.query_terms(ask(spark, "margin cap")), 1).collect()
    assert any(not r["open"] for r in marked) and any(r["open"] for r in marked)
    scope = spark.createDataFrame([(0, 1), (4, 2)], "query_id long, doc_id long")
    assert {r["query_id"] for r in lexical.bm25_top_k(ask(spark, *asked), index, 3, scope).collect()} == {0}
    again = lexical.LexicalIndex.read(spark, index.write(f"{checkpoint_root(spark)}/index-again") and f"{checkpoint_root(spark)}/index-again")
    assert again.term_stats.count() == index.term_stats.count() and again.impacts.count() == index.impacts.count()


def test_retry_serves_from_the_pool_and_widens_only_where_asked(spark):
    texts = [f"word{k % 3} word{k % 5} loan text number {k}" for k in range(12)]
    chunks = chunk_rows(spark, texts).withColumn("embedding", F.array(F.col("chunk_index").cast("float"), F.lit(1.0).cast("float")))
    q = ask(spark, "word1 loan", "word2").withColumn("embedding", F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float"))).withColumn("bm25_weight", F.lit(0.5)).withColumn("semantic_weight", F.lit(0.5))
    advice = spark.createDataFrame([(0, 0.9, 0.1, 6)], "query_id long, recommended_bm25_weight double, recommended_semantic_weight double, recommended_top_k int")
    pool = retrieve.candidate_pool(q, chunks, 3)
    scope = spark.createDataFrame([(0, 1)], "query_id long, doc_id long")
    rows = retrieve.retry(q, advice, chunks, pool, 3, 3, scope=scope).collect()
    runs = {(r["query_id"], r["run"]): 0 for r in rows}
    for r in rows:
        runs[r["query_id"], r["run"]] += 1
    assert runs == {(0, "retry"): 6, (1, "original"): 3}
    fresh = retrieve.hybrid(retrieve.apply_advice(q, advice), chunks, 3).where("query_id = 0")
    pick = lambda rs: sorted((r["chunk_index"], r["rank"], r["score"]) for r in rs)
    assert pick(fresh.collect()) == pick(r for r in rows if r["query_id"] == 0)


def vectors(spark, rows, key):
    return spark.createDataFrame(rows, f"{key}, embedding array<float>")


def test_semantic_skips_zero_vectors_and_wrong_sizes(spark):
    chunks = vectors(spark, [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 0.0]), (1, 2, [0.5, 0.5]), (1, 3, [1.0, 0.0, 0.0]), (1, 4, None)], "doc_id long, chunk_index int")
    fits, rejects = split_by_dimension(chunks, 2)
    assert fits.count() == 3 and rejects.count() == 2
    q = vectors(spark, [(7, [1.0, 0.0])], "query_id long")
    rows = semantic_top_k(q, chunks, 5, dim=2).orderBy("rank").collect()
    assert [(r["chunk_index"], round(r["score"], 6)) for r in rows] == [(0, 1.0), (2, 0.707107)]


def test_query_size_is_the_size_of_all(spark):
    chunks = vectors(spark, [(1, 0, [1.0, 0.0]), (1, 1, [1.0]), (1, 2, [1.0, 0.0, 0.0])], "doc_id long, chunk_index int")
    one = vectors(spark, [(7, [1.0, 0.0]), (8, None)], "query_id long")
    two = vectors(spark, [(7, [1.0, 0.0]), (8, [1.0])], "query_id long")
    assert [r["chunk_index"] for r in semantic_top_k(one, chunks, 5).collect()] == [0]
    assert semantic_top_k(one.where("query_id = 8"), chunks, 5).count() == 0
    with pytest.raises(ValueError):
        semantic_top_k(two, chunks, 5)


def test_semantic_ways_agree(spark):
    rows = [(d, i, [float((d * 7 + i * 3 + j) % 5 - 2) for j in range(4)]) for d in range(3) for i in range(12)]
    chunks = vectors(spark, rows, "doc_id long, chunk_index int")
    q = vectors(spark, [(k, [float((k + j) % 3 - 1) + 0.5 for j in range(4)]) for k in range(6)], "query_id long")
    scope = q.select("query_id").crossJoin(chunks.select("doc_id").distinct())
    pick = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "chunk_index", "rank").collect()))
    small = pick(semantic_top_k(q, chunks, 3))
    grid = pick(semantic_top_k(q, chunks, 3, query_limit=2, block=2, slice_rows=7))
    scoped = pick(semantic_top_k(q, chunks, 3, scope=scope))
    assert small == grid == scoped and len(small) == 6 * 3 * 3


def test_all_zero_bm25_normalises_to_zero(spark):
    rows = spark.createDataFrame([(0, 1, 0, 0.0), (0, 1, 1, 0.0)], "query_id long, doc_id long, chunk_index int, score double")
    assert [r["bm25_norm"] for r in fusion.normalise_by_best(rows).collect()] == [0.0, 0.0]


def test_fusion_sorts_before_it_cuts(spark):
    found = spark.createDataFrame([(0, 1, i, None, i / 10) for i in range(10)], "query_id long, doc_id long, chunk_index int, bm25_norm double, cosine double")
    q = spark.createDataFrame([(0, 0.2, 0.8)], "query_id long, bm25_weight double, semantic_weight double")
    rows = fusion.fuse(found, q, 3).orderBy("rank").collect()
    assert [r["chunk_index"] for r in rows] == [9, 8, 7] and rows[0]["score"] == pytest.approx(0.72)


def test_rerank_prefers_shared_words(spark):
    q = ask(spark, "capital of France")
    chunks = chunk_rows(spark, ["The sea is blue", "Paris is the capital of France"])
    found = spark.createDataFrame([(0, 1, 0), (0, 1, 1)], "query_id long, doc_id long, chunk_index int")
    rows = fusion.rerank(fusion.score_pairs(found, q, chunks), 2).orderBy("rank").collect()
    assert rows[0]["chunk_index"] == 1 and 0 <= rows[1]["score"] <= rows[0]["score"] <= 1


def test_empty_inputs_give_empty_results(spark):
    assert retrieve.bm25(ask(spark, "loan").limit(0), chunk_rows(spark, ["a b"]), 3).count() == 0
    assert retrieve.bm25(ask(spark, "loan"), chunk_rows(spark, ["a b"]).limit(0), 3).count() == 0


def test_scope_limits_documents(spark):
    chunks = chunk_rows(spark, ["loan one", "rate two"], 1).unionByName(chunk_rows(spark, ["loan three", "date"], 2))
    scope = spark.createDataFrame([(0, 2)], "query_id long, doc_id long")
    rows = retrieve.bm25(ask(spark, "loan", "date"), chunks, 2, scope).collect()
    assert {(r["query_id"], r["doc_id"]) for r in rows} == {(0, 2)} and len(rows) == 2


def test_short_group_takes_no_number(spark):
    long = "Many words fill this sentence so that it is long enough to stay in."
    docs = spark.createDataFrame([(1, f"{long}\nShort bit.\n{long}")], "doc_id long, text string")
    rows = ch.chunks_from_documents(docs, size=1).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == [0, 1] and all(r["text"] == long for r in rows)


def test_block_geometry(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    chunks = spark.createDataFrame([(1, 0, 0, 100, 200)], "doc_id long, page_num int, chunk_index int, char_start int, char_end int")
    blocks = spark.createDataFrame(
        [(1, 0, 1, 0, 100, box), (1, 0, 2, 4, 104, box), (1, 0, 3, 6, 106, box), (1, 0, 4, 200, 300, box)],
        "doc_id long, page_num int, block_no long, char_start int, char_end int, bbox struct<x0:double,y0:double,x1:double,y1:double>",
    )
    overlaps = ch.block_overlaps(chunks, blocks)
    assert {r["block_no"] for r in overlaps.collect()} == {2, 3}
    assert {r["block_no"] for r in ch.wide_overlaps(overlaps).collect()} == {3}
    none = ch.wide_overlaps(overlaps).limit(0)
    assert {r["block_no"] for r in ch.holding_blocks(chunks, blocks, none).collect()} == {2, 3}


def test_plan_has_no_nested_loop_and_prunes_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Some words here. " * 20, "en")], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/d")
    plan = ch.chunks_from_documents(spark.read.parquet(f"{tmp_path}/d"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "lang" not in plan
    found = retrieve.bm25(ask(spark, "words"), chunk_rows(spark, ["some words", "other"]), 1)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "WindowGroupLimit" in text


def test_term_frequencies_split_each_text_once(spark):
    table = lexical.postings_of(lexical.token_table(chunk_rows(spark, ["b a  B c", " ", "c"])))
    assert table._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    rows = sorted((r["chunk_index"], r["term"], r["tf"], r["n_tokens"]) for r in table.collect())
    assert rows == [(0, "a", 1, 4), (0, "b", 2, 4), (0, "c", 1, 4), (2, "c", 1, 1)]

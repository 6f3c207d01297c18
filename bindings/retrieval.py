"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import tables as tb
from bindings.ctes import words
from bindings.registry import Group
from proofloom.functions import text as tx
from proofloom.operators import fusion, lexical, onepass, semantic
from proofloom.plans import retrieve
from proofloom.session import stored

K = tb.K
GROUP = Group()
query = GROUP.query
QUERIES, ORACLES = GROUP.queries, GROUP.oracles


def _index(spark, d):
    return tb.index(spark, d)


@query("p02_bm25_topk", "SELECT query_id, doc_id, chunk_index, round(score + 2e-10, 6) AS score, rank FROM t_bm25")
def p02(spark, d):
    found = retrieve.bm25(tb.queries(spark, d), _index(spark, d), K)
    return found.select("query_id", "doc_id", "chunk_index", tb.show("score"), "rank")


@query("a04_tf", "SELECT doc_id, chunk_index, term, tf, n_tokens FROM t_tf")
def a04_tf(spark, d):
    return lexical.postings_of(lexical.token_table(tb.chunks(spark, d)))


@query("a04_df", "SELECT doc_id, term, df FROM t_df")
def a04_df(spark, d):
    return _index(spark, d).term_stats


@query(
    "a05_idf_stats",
    "SELECT doc_id, n_chunks, round(avg_tokens + 2e-10, 6) AS avg_tokens, round(mean_idf + 2e-10, 6) AS mean_idf FROM t_sizes LEFT JOIN t_mean_idf USING (doc_id)",
)
def a05(spark, d):
    return _index(spark, d).doc_stats.select(
        "doc_id", "n_chunks", tb.show("avg_tokens"), tb.show("mean_idf")
    )


@query("j04_query_postings", """
SELECT q.query_id, t.doc_id, t.chunk_index, count(*) AS n_terms, CAST(sum(q.qtf * t.tf) AS BIGINT) AS n_matches
FROM t_query_terms q JOIN t_tf t USING (term) GROUP BY q.query_id, t.doc_id, t.chunk_index""")
def j04(spark, d):
    terms = lexical.query_terms(tb.queries(spark, d))
    postings = lexical.postings_of(lexical.token_table(tb.chunks(spark, d)))
    hits = fusion.join_checked(postings, terms, ["term"], ["doc_id", "chunk_index"])
    return hits.groupBy("query_id", "doc_id", "chunk_index").agg(
        F.count("*").alias("n_terms"), F.sum(F.col("qtf") * F.col("tf")).alias("n_matches")
    )


@query("a06_bm25_score", "SELECT query_id, doc_id, chunk_index, round(score + 2e-10, 6) AS score FROM t_hit_scores")
def a06(spark, d):
    return lexical.hit_scores(_index(spark, d), tb.queries(spark, d)).withColumn("score", tb.show("score"))


@query("w03_bm25_best", "SELECT query_id, doc_id, chunk_index, round(score + 2e-10, 6) AS score FROM t_bm25 WHERE rank = 1")
def w03(spark, d):
    found = retrieve.bm25(tb.queries(spark, d), _index(spark, d), 1)
    return found.select("query_id", "doc_id", "chunk_index", tb.show("score"))


@query("a08_bm25_norm", "SELECT query_id, doc_id, chunk_index, round(bm25_norm + 2e-10, 6) AS bm25_norm FROM t_bm25_norm")
def a08(spark, d):
    found = fusion.normalise_by_best(retrieve.bm25(tb.queries(spark, d), _index(spark, d), K))
    return found.select("query_id", "doc_id", "chunk_index", tb.show("bm25_norm"))


@query("p03_cosine_topk", """
SELECT query_id, doc_id, chunk_index, round(score + 2e-10, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_index) AS rank FROM (
    SELECT q.vec_id AS query_id, CAST(c.label AS BIGINT) AS doc_id, CAST(c.vec_id AS INTEGER) AS chunk_index,
           round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score
    FROM embeddings q CROSS JOIN embeddings c)) WHERE rank <= 5""")
def p03(spark, d):
    vectors = tb.table(spark, d, "embeddings")
    corpus = vectors.select(F.col("label").alias("doc_id"), F.col("vec_id").alias("chunk_index"), "embedding")
    asked = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieve.semantic(asked, corpus, K)
    return found.select("query_id", "doc_id", "chunk_index", tb.show("score"), "rank")


@query("w04_semantic_topk", "SELECT query_id, doc_id, chunk_index, round(score + 2e-10, 6) AS score, rank FROM t_semantic")
def w04(spark, d):
    found = retrieve.semantic(tb.vector_queries(spark, d), tb.vector_chunks(spark, d), K)
    return found.select("query_id", "doc_id", "chunk_index", tb.show("score"), "rank")


@query("j03_chunk_cosine", """
SELECT v.doc_id, v.chunk_index, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) + 2e-10, 6) AS score
FROM t_vectors v JOIN embeddings e ON e.vec_id = v.doc_id % (SELECT count(*) FROM embeddings)""")
def j03(spark, d):
    """Each document has one question of its own (a stored vector), asked through a scope table."""
    vectors = tb.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    scope = tb.documents(spark, d, "doc_id").select("doc_id", (F.col("doc_id") % vectors.count()).alias("query_id"))
    asked = scope.join(vectors.withColumnRenamed("embedding", "query_vector"), "query_id")
    pairs = fusion.salted_join(tb.vector_chunks(spark, d), asked, ["doc_id"], ["chunk_index"])
    return pairs.select("doc_id", "chunk_index", tb.show(semantic.cosine("embedding", "query_vector"), "score"))


@query("a07_cosine_self", """
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 6) AS score
FROM embeddings""")
def a07(spark, d):
    vectors = tb.table(spark, d, "embeddings")
    return vectors.select("vec_id", tb.show(semantic.cosine(F.col("embedding"), F.reverse("embedding")), "score"))


@query("f12_dimension", """
SELECT vec_id, len(embedding) AS dim, len(embedding) = 64 AS accepted FROM embeddings""")
def f12(spark, d):
    fits, rejects = semantic.split_by_dimension(tb.table(spark, d, "embeddings"), 64)
    both = fits.withColumn("accepted", F.lit(True)).unionByName(rejects.withColumn("accepted", F.lit(False)))
    return both.select("vec_id", F.size("embedding").alias("dim"), "accepted")


@query("f03_valid_chunks", r"SELECT doc_id, chunk_index FROM t_chunks WHERE length(regexp_replace(text, '\s', '', 'g')) > 0")
def f03(spark, d):
    return lexical.valid_chunks(tb.chunks(spark, d)).select("doc_id", "chunk_index")


def _candidates(spark, d, *only, grouped=False):
    return retrieve.candidates(tb.vector_queries(spark, d), tb.vector_chunks(spark, d), K, index=tb.index(spark, d), grouped=grouped, only=only)


@query("j05_candidates", """
SELECT query_id, doc_id, chunk_index, round(bm25_norm + 2e-10, 6) AS bm25_norm, round(cosine + 2e-10, 6) AS cosine,
       bm25_norm IS NOT NULL AS in_bm25, cosine IS NOT NULL AS in_semantic FROM t_candidates""")
def j05(spark, d):
    return _candidates(spark, d).withColumn("bm25_norm", tb.show("bm25_norm")).withColumn("cosine", tb.show("cosine"))


@query("u01_candidate_union", """
SELECT query_id, doc_id, chunk_index FROM t_bm25 UNION SELECT query_id, doc_id, chunk_index FROM t_semantic""")
def u01(spark, d):
    b = retrieve.bm25(tb.queries(spark, d), _index(spark, d), K)
    s = retrieve.semantic(tb.vector_queries(spark, d), tb.vector_chunks(spark, d), K)
    return b.select(*fusion.KEY).unionByName(s.select(*fusion.KEY)).distinct()


@query("j16_in_both", """
SELECT query_id, doc_id, chunk_index FROM t_bm25 INTERSECT SELECT query_id, doc_id, chunk_index FROM t_semantic""")
def j16(spark, d):
    b = retrieve.bm25(tb.queries(spark, d), _index(spark, d), K)
    s = retrieve.semantic(tb.vector_queries(spark, d), tb.vector_chunks(spark, d), K)
    return b.select(*fusion.KEY).join(s.select(*fusion.KEY), fusion.KEY, "left_semi")


HYBRID = "SELECT query_id, doc_id, chunk_index, round(score + 2e-10, 6) AS score, 'hybrid_no_rerank' AS retrieval_method, rank FROM t_hybrid"


def _hybrid(spark, d, k=K, grouped=False):
    return retrieve.hybrid(tb.vector_queries(spark, d), tb.vector_chunks(spark, d), k, index=tb.index(spark, d), grouped=grouped)


@query("p04_hybrid", HYBRID)
def p04(spark, d):
    return _hybrid(spark, d).select(*fusion.KEY, tb.show("score"), "retrieval_method", "rank")


# The pair is fitted to 512 - 8 - 3 tokens, the query first, before shared tokens are counted.
Q_WORDS = f"list_slice({words('query')}, 1, 500)"
D_WORDS = f"list_slice({words('text')}, 1, greatest(501 - len({Q_WORDS}), 1))"
RERANK_SCORE = f"""round(len(list_intersect(list_distinct({Q_WORDS}), {D_WORDS}))::DOUBLE / nullif(len(list_distinct({Q_WORDS})), 0), 9)"""
RERANKED = f"""
SELECT query_id, doc_id, chunk_index, score, fused, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_index) AS rank
FROM (SELECT f.query_id, f.doc_id, f.chunk_index, coalesce({RERANK_SCORE}, 0) AS score, f.score AS fused
      FROM t_fused f JOIN t_chunks c USING (doc_id, chunk_index))"""


@query("p05_rerank", f"""
SELECT query_id, doc_id, chunk_index, round(score + 2e-10, 6) AS score, round(fused + 2e-10, 6) AS fused_score, 'hybrid' AS retrieval_method, rank
FROM ({RERANKED}) WHERE rank <= 5""")
def p05(spark, d):
    found = retrieve.hybrid_reranked(tb.vector_queries(spark, d), tb.vector_chunks(spark, d), K, index=tb.index(spark, d), only=("fused_score",))
    return found.select(
        *fusion.KEY, tb.show("score"), tb.show("fused_score"), "retrieval_method", "rank"
    )


@query("j06_attach_scores", """
SELECT c.query_id, c.doc_id, c.chunk_index, round(s.score + 2e-10, 6) AS rerank_score
FROM t_candidates c LEFT JOIN t_hit_scores s ON s.query_id = c.query_id AND s.doc_id = c.doc_id AND s.chunk_index = c.chunk_index""")
def j06(spark, d):
    scores = lexical.hit_scores(_index(spark, d), tb.queries(spark, d), grouped=True)
    return fusion.attach_scores(_candidates(spark, d, grouped=True), scores).select(*fusion.KEY, tb.show("rerank_score"))


@query("a19_mean_rerank", f"""
SELECT query_id, round(avg(score) + 2e-10, 6) AS mean_score, count(*) AS n FROM ({RERANKED}) WHERE rank <= 5 GROUP BY query_id""")
def a19(spark, d):
    found = retrieve.hybrid_reranked(tb.vector_queries(spark, d), tb.vector_chunks(spark, d), K, index=tb.index(spark, d), only=("fused_score",))
    return found.groupBy("query_id").agg(tb.show(F.avg("score"), "mean_score"), F.count("*").alias("n"))


@query("p06_chat_retrieve", "SELECT query_id, 'doc_' || doc_id || '.pdf' AS filename, chunk_index, round(score + 2e-10, 6) AS score FROM t_hybrid")
def p06(spark, d):
    found = retrieve.chat_retrieve(tb.vector_queries(spark, d), tb.vector_chunks(spark, d), K, index=tb.index(spark, d))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return found.select("query_id", name.alias("filename"), "chunk_index", tb.show("score"))


@query("o01_global_top", """
SELECT query_id, doc_id, chunk_index, round(score + 2e-10, 6) AS score FROM t_hybrid QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) <= 20""")
def o01(spark, d):
    found = retrieve.chat_retrieve(tb.vector_queries(spark, d), tb.vector_chunks(spark, d), K, total=20, index=tb.index(spark, d))
    return found.select(*fusion.KEY, tb.show("score"))


ADVICE = """
SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 0.8 WHEN 1 THEN 0.2 WHEN 2 THEN 1.5 END::DOUBLE AS b,
       CASE item_id % 4 WHEN 0 THEN 0.4 WHEN 1 THEN 0.8 WHEN 2 THEN 0.2 END::DOUBLE AS s, CAST(2 + item_id % 3 AS INTEGER) AS k
FROM benchmark"""
ADVISED = f"""
SELECT q.query_id, CASE WHEN a.b IS NULL THEN q.bm25_weight WHEN a.b > 1 THEN 0.5 WHEN abs(a.b + a.s - 1) > 0.01 THEN a.b / (a.b + a.s) ELSE a.b END AS wb,
       CASE WHEN a.b IS NULL THEN q.semantic_weight WHEN a.b > 1 THEN 0.5 WHEN abs(a.b + a.s - 1) > 0.01 THEN a.s / (a.b + a.s) ELSE a.s END AS ws,
       CASE WHEN a.b IS NULL THEN 5 ELSE a.k END AS k
FROM t_queries q JOIN ({ADVICE}) a USING (query_id)"""
RETRIED = f"""
SELECT query_id, doc_id, chunk_index, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_index) AS rank FROM (
    SELECT c.query_id, c.doc_id, c.chunk_index, c.k, round(coalesce(bm25_norm, 0) * wb + coalesce(cosine, 0) * ws, 9) AS score
    FROM (SELECT coalesce(b.query_id, s.query_id) AS query_id, coalesce(b.doc_id, s.doc_id) AS doc_id,
                 coalesce(b.chunk_index, s.chunk_index) AS chunk_index, coalesce(b.k, s.k) AS k,
                 coalesce(b.wb, s.wb) AS wb, coalesce(b.ws, s.ws) AS ws, b.bm25_norm, s.score AS cosine
          FROM (SELECT * FROM t_bm25_norm JOIN ({ADVISED}) USING (query_id) WHERE rank <= k) b
          FULL JOIN (SELECT * FROM t_semantic JOIN ({ADVISED}) USING (query_id) WHERE rank <= k) s
            ON b.query_id = s.query_id AND b.doc_id = s.doc_id AND b.chunk_index = s.chunk_index) c)) WHERE rank <= k"""


def _advice(spark, d):
    kind = F.col("item_id") % 4
    return tb.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.when(kind == 0, 0.8).when(kind == 1, 0.2).when(kind == 2, 1.5).alias("recommended_bm25_weight"),
        F.when(kind == 0, 0.4).when(kind == 1, 0.8).when(kind == 2, 0.2).alias("recommended_semantic_weight"),
        (2 + F.col("item_id") % 3).cast("int").alias("recommended_top_k"),
    )


@query("p07_retry", f"""
SELECT query_id, doc_id, chunk_index, round(score + 2e-10, 6) AS score, rank, 'retry' AS run FROM ({RETRIED}) WHERE (query_id + doc_id) % 3 <> 0
UNION ALL SELECT query_id, doc_id, chunk_index, round(score + 2e-10, 6), rank, 'original' FROM t_hybrid WHERE (query_id + doc_id) % 3 = 0""")
def p07(spark, d):
    """Two thirds of the pairs are asked again; the others keep what they had."""
    q, c = tb.vector_queries(spark, d), tb.stored_vector_chunks(spark, d)
    pool = stored(retrieve.candidate_pool(q, c, K, index=tb.index(spark, d)), "pool")
    again = q.select("query_id").join(tb.documents(spark, d, "doc_id"), (F.col("query_id") + F.col("doc_id")) % 3 != 0)
    found = retrieve.retry(q, _advice(spark, d), c, pool, K, K, scope=again, index=tb.index(spark, d))
    return found.withColumn("score", tb.show("score"))


@query("a20_compare_runs", f"""
SELECT query_id, doc_id, count(*) FILTER (src = 0) AS n_original, count(*) FILTER (src = 1) AS n_new FROM (
  SELECT query_id, doc_id, 0 AS src FROM t_hybrid UNION ALL SELECT query_id, doc_id, 1 FROM ({RETRIED})) GROUP BY query_id, doc_id""")
def a20(spark, d):
    q, c = tb.vector_queries(spark, d), tb.stored_vector_chunks(spark, d)
    pool = stored(retrieve.candidate_pool(q, c, K, index=tb.index(spark, d)), "pool")
    return fusion.compare_runs(retrieve.from_pool(pool, q, K), retrieve.from_pool(pool, retrieve.apply_advice(q, _advice(spark, d)), K))


@query("o05_retry_top3", f"""
SELECT r.query_id, r.doc_id, r.rank, round(r.score, 3) AS score, c.page_num + 1 AS page, substr(c.text, 1, 200) || '...' AS preview
FROM ({RETRIED}) r JOIN t_chunks c USING (doc_id, chunk_index) WHERE r.rank <= 3""")
def o05(spark, d):
    """A pair's results come in order, so its first three are its three best."""
    q, c = tb.vector_queries(spark, d), tb.vector_chunks(spark, d)
    found = retrieve.hybrid(retrieve.apply_advice(q, _advice(spark, d)), c, K, index=tb.index(spark, d), grouped=True)
    pairs = F.transform("pairs", lambda p: F.struct(p["query_id"].alias("query_id"), F.filter(p["found"], lambda h: h["rank"] <= 3).alias("found")))
    top = fusion.attach_text(found.withColumn("pairs", pairs), tb.chunks(spark, d), "page_num", "text")
    return onepass.as_rows(top).select(
        "query_id", "doc_id", "rank", F.round("score", 3).alias("score"), (F.col("page_num") + 1).alias("page"),
        tx.preview("text", 200, always=True).alias("preview"),
    )


@query("w05_fused_best", "SELECT query_id, doc_id, chunk_index, round(score + 2e-10, 6) AS score FROM t_hybrid WHERE rank = 1")
def w05(spark, d):
    return _hybrid(spark, d).where("rank = 1").select(*fusion.KEY, tb.show("score"))


@query("a11_result_summary", """
SELECT h.query_id, h.doc_id, count(*) AS n_results, round(avg(h.score) + 2e-10, 6) AS avg_score, round(min(h.score) + 2e-10, 6) AS min_score,
       round(max(h.score) + 2e-10, 6) AS max_score, string_agg(substr(c.text, 1, 100) || '...', '; ' ORDER BY h.rank) FILTER (h.rank <= 3) AS samples
FROM t_hybrid h JOIN t_chunks c USING (doc_id, chunk_index) GROUP BY h.query_id, h.doc_id""")
def a11(spark, d):
    rows = fusion.attach_text(_hybrid(spark, d, grouped=True), tb.chunks(spark, d), "text")
    return fusion.summarise_results(rows).select(
        "query_id", "doc_id", "n_results", tb.show("avg_score"), tb.show("min_score"), tb.show("max_score"), "samples"
    )


@query("a21_chunks_by_document", """
SELECT query_id, doc_id, count(*) AS n_results, string_agg(CAST(chunk_index AS VARCHAR), ',' ORDER BY rank) AS chunk_list
FROM t_hybrid GROUP BY query_id, doc_id""")
def a21(spark, d):
    grouped = fusion.chunks_by_document(_hybrid(spark, d, grouped=True))
    chunk_list = F.array_join(F.col("results.chunk_index").cast("array<string>"), ",")
    return grouped.select("query_id", "doc_id", "n_results", chunk_list.alias("chunk_list"))


@query("m04_scorer_chain", """
SELECT c.query_id, c.doc_id, c.chunk_index, round(coalesce(s.score, c.cosine, 0.5) + 2e-10, 6) AS score,
       CASE WHEN s.score IS NOT NULL THEN 1 WHEN c.cosine IS NOT NULL THEN 2 ELSE 0 END AS score_source
FROM t_candidates c LEFT JOIN t_hit_scores s ON s.query_id = c.query_id AND s.doc_id = c.doc_id AND s.chunk_index = c.chunk_index""")
def m04(spark, d):
    scores = lexical.hit_scores(_index(spark, d), tb.queries(spark, d), grouped=True)
    value, source = fusion.scorer_chain(F.col("rerank_score"), F.col("cosine"))
    rows = fusion.attach_scores(_candidates(spark, d, "cosine", grouped=True), scores)
    return rows.select(*fusion.KEY, tb.show(value, "score"), source.alias("score_source"))


@query("m02_pair_scorer", f"""
SELECT f.query_id, f.doc_id, f.chunk_index, round(coalesce({RERANK_SCORE}, 0) + 2e-10, 6) AS rerank_score
FROM t_fused f JOIN t_chunks c USING (doc_id, chunk_index)""")
def m02(spark, d):
    scored = fusion.score_pairs(_candidates(spark, d, grouped=True), tb.queries(spark, d), tb.chunks(spark, d))
    return scored.select(*fusion.KEY, tb.show("rerank_score"))

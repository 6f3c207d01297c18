"""Cosine ranks that leave a document's task finished."""

import numpy as np

from proofloom.operators import semantic


def test_scores_are_not_shuffled_for_many_queries(spark, monkeypatch):
    monkeypatch.setattr(semantic, "SPAN", 40)
    rng = np.random.default_rng(3)
    rows = [(int(d), int(i), rng.integers(-2, 3, 4).astype(float).tolist()) for d, n in enumerate((1, 3, 30, 120, 7)) for i in range(n)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(q, rng.normal(size=4).tolist()) for q in range(20)], "query_id long, embedding array<double>")
    found = {tuple(r) for r in semantic.semantic_top_k(asked, chunks, 4).collect()}
    few = set()
    for part in range(4):
        some = asked.where(f"query_id % 4 = {part}")
        few |= {tuple(r) for r in semantic.semantic_top_k(some, chunks, 4).collect()}
    assert found == few and len(found) > 200
    short = semantic.semantic_top_k(asked, chunks.where("doc_id <> 3"), 4)
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") <= 2


def test_first_rows_of_columns_with_ties():
    rng = np.random.default_rng(9)
    for k in (1, 3, 5):
        scores = rng.integers(0, 4, (40, 30)).astype(float)
        ranks = np.argsort(np.argsort(-scores, axis=0, kind="stable"), axis=0, kind="stable")
        assert (semantic._first_k(scores, k) == (ranks < k)).all()


def test_joins_of_texts_and_scores_are_not_broadcast(spark, tmp_path):
    """Compressed files make texts look small; the driver must not gather them."""
    from proofloom.operators import fusion

    spark.range(50).selectExpr("id AS doc_id", "0 AS chunk_index", "repeat('x', 1000) AS text").write.parquet(f"{tmp_path}/c")
    chunks = spark.read.parquet(f"{tmp_path}/c")
    rows = spark.range(50).selectExpr("id % 5 AS query_id", "id AS doc_id", "0 AS chunk_index")
    scores = rows.selectExpr("query_id", "doc_id", "chunk_index", "0.5D AS rerank_score")
    for joined in (fusion.attach_text(rows, chunks, "text"), fusion.attach_scores(rows, scores)):
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 50

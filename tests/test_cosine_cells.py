"""Cells of the cosine grid: the best scores of every run, and few partial results."""

import numpy as np

from proofloom.operators import semantic


def test_best_of_agrees_with_a_full_sort():
    rng = np.random.default_rng(1)
    for trial in range(120):
        n, k = int(rng.integers(1, 500)), int(rng.integers(1, 7))
        starts = np.unique(np.r_[0, rng.integers(0, n, 3)])
        unit, chunk = rng.normal(size=(6, 8)), rng.normal(size=(n, 8))
        if trial % 3 == 1:
            chunk = chunk[rng.integers(0, min(n, 3), n)]
        if trial % 3 == 2:  # neighbours closer than single precision tells apart
            chunk = chunk[rng.integers(0, min(n, 9), n)] * (1 + rng.normal(size=(n, 8)) * 1e-8)
        unit, chunk = (x / np.sqrt((x * x).sum(axis=1))[:, None] for x in (unit, chunk))
        if trial % 4 == 0:
            chunk[rng.random(n) < 0.02] = np.nan
        row, col, score = semantic._best_of(unit, chunk, np.ascontiguousarray(chunk.T, dtype=np.float32), starts, k)
        exact = np.stack([np.round(np.einsum("ij,ij->i", np.repeat(u[None], n, axis=0), chunk), 9) for u in unit])
        down = np.where(np.isnan(exact), -np.inf, -exact)
        want = {(r, int(c)) for r in range(6) for a, b in zip(starts, [*starts[1:], n]) for c in np.argsort(down[r, a:b], kind="stable")[:k] + a}
        assert set(zip(row.tolist(), col.tolist())) == want
        assert np.array_equal(score, exact[row, col], equal_nan=True)


def test_cells_are_wide(spark, monkeypatch):
    """A cell passes on k rows per (query, document): few slices keep the partial results few."""
    seen = []
    monkeypatch.setattr(semantic, "first_rows", lambda df, *a: seen.append(df) or df)
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, rng.normal(size=2).tolist()) for i in range(45_000)]
    vectors = spark.createDataFrame(rows, "id long, label int, embedding array<double>")
    chunks = vectors.selectExpr("label AS doc_id", "id AS chunk_index", "embedding")
    semantic.semantic_top_k(vectors.where("id < 3000").selectExpr("id AS query_id", "embedding"), chunks, 5)
    assert seen[0].count() == 3000 * 3 * 5

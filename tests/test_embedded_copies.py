"""Vectors go back to their rows without being repeated, and no text's copies meet in one task."""

from pyspark.sql import functions as F

from proofloom.sources import responses as rs


def test_vectors_are_not_repeated_for_salts(spark, monkeypatch):
    monkeypatch.setattr(rs, "HOT_ROWS", 5)
    monkeypatch.setattr(rs, "HOT_SHARE", 10)
    texts = ["copied text"] * 30 + [f"word {i}" for i in range(40)] + [" ", None, ""] * 4 + ["twice"] * 2
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    found = rs.embed_texts(rows, ["id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    assert plan.count("rightHint=(strategy=broadcast)") == 1  # the copied text alone
    got = {r["id"]: r["embedding"] for r in found.collect()}
    assert sorted(got) == list(range(len(texts)))
    assert all((got[i] is None) == (not (t or "").strip()) for i, t in enumerate(texts))
    assert len({tuple(got[i]) for i in range(30)}) == 1 and got[82] == got[83] and got[30] != got[31]


def test_few_rows_need_no_broadcast(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, text string")
    found = rs.embed_texts(rows, ["id"])
    assert "broadcast" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert found.where(F.col("embedding").isNull()).count() == 1

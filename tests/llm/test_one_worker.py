"""Python workers: how many steps a task needs, and tasks without rows."""

from proofloom.llm import repeats
from proofloom.llm.tables import mapped


def test_cut_text_takes_one_python_pass(spark):
    """A filter on the cut text must not bring further Python steps into the same task."""
    passage = "0123456789" * 6
    docs = spark.createDataFrame([(1, passage), (2, "ä" + passage + "é tail"), (3, passage), (4, None), (5, "  "), (6, "other")], "doc_id long, text string")
    found = repeats.deduplicated_text(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {tuple(r) for r in found.collect()} == {(1, passage), (2, "äé tail"), (4, None), (5, "  "), (6, "other")}


def test_mapped_takes_a_task_without_batches(spark):
    import pyarrow as pa

    upper = mapped(lambda: lambda batch: pa.array([t.upper() for t in batch.to_pylist()]), "string")
    docs = spark.range(8).selectExpr("'a' AS t", "id").repartition(4, "t")
    assert {r[0] for r in docs.select(upper(docs["t"])).collect()} == {"A"}

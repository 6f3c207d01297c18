import datetime as dt

from pyspark.sql import functions as F

from proofloom.functions.spread import running_offset, salted_join
from proofloom.operators import corpus as co
from proofloom.sources.documents import file_catalogue
from proofloom.sources.responses import call_model, embed_texts, pending, read_responses, responses_for, store_responses
from proofloom.streaming import jobs


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_gap_edge(spark):
    rows = spark.createDataFrame([(1, at(0)), (1, at(5400)), (1, at(10801)), (2, at(86399)), (2, at(86401))], "user_id long, ts timestamp")
    found = sorted((r["user_id"], r["n_events"]) for r in co.sessions(rows).collect())
    assert found == [(1, 1), (1, 2), (2, 2)]


def test_stream_matches_batch(spark, tmp_path):
    rows = [(u, at(u * 100 + i * i * 700)) for u in range(4) for i in range(12)]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp")
    events.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    flush = spark.createDataFrame([(99, at(10_000_000))], "user_id long, ts timestamp")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = jobs.stream_sessions(stream).writeStream.format("memory").queryName("found").outputMode("append").option(
        "checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    flush.coalesce(1).write.parquet(f"{tmp_path}/in/b")
    query.processAllAvailable()
    query.stop()
    got = sorted((r["user_id"], r["session_start"], r["n_events"]) for r in spark.table("found").collect())
    want = sorted((r["user_id"], r["session_start"], r["n_events"]) for r in co.sessions(events).collect())
    assert got == want


def test_incremental_ingest(spark, tmp_path):
    text = "Many words fill this sentence so that it is long enough to stay in. " * 3
    schema = "doc_id long, text string"
    run = lambda: jobs.ingest_stream(
        spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), f"{tmp_path}/chunks", f"{tmp_path}/cp"
    ).awaitTermination()
    spark.createDataFrame([(1, text), (1, text)], schema).write.parquet(f"{tmp_path}/in/a")
    run()
    spark.createDataFrame([(1, text), (2, text)], schema).write.parquet(f"{tmp_path}/in/b")
    run()
    rows = spark.read.parquet(f"{tmp_path}/chunks").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in rows} == {1: 1, 2: 1}


def test_ingest_replaces_and_removes(spark, tmp_path):
    text = "Many words fill this sentence so that it is long enough to stay in. "
    schema = "doc_id long, text string, removed boolean, at int"

    def arrive(folder, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{folder}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        jobs.ingest_stream(stream, f"{tmp_path}/chunks", f"{tmp_path}/cp", version="at").awaitTermination()
        rows = jobs.current_chunks(spark, f"{tmp_path}/chunks").collect()
        return {r["doc_id"]: ("Second" in r["text"], "Third" in r["text"]) for r in rows}

    held = arrive("a", (1, text, None, 1), (1, text + "Third one is newer.", False, 2), (2, text, False, 1), (None, text, None, 1))
    assert held == {1: (False, True), 2: (False, False)}
    assert arrive("b", (1, text + "Second form.", None, 3), (2, None, True, 2), (3, text, True, 1)) == {1: (True, False)}
    assert arrive("c", (2, text, None, 4)) == {1: (True, False), 2: (False, False)}


def test_ingest_plan_of_empty_tables(spark):
    state = spark.createDataFrame([], "doc_id long, content string")
    assert jobs.ingest_plan(state, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_changes_and_purge(spark):
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "doc_id long")
    got = {(r["doc_id"], r["change"]) for r in co.changes(ids(1, 2, 2), ids(2, 3)).collect()}
    assert got == {(1, "removed"), (3, "added")}
    assert [r["doc_id"] for r in co.purge(ids(1, 2), co.removed(ids(1, 2), ids(2))).collect()] == [2]


def test_running_offset_over_many_spans(spark):
    rows = spark.range(50).select(F.lit(1).alias("k"), F.col("id").alias("p"), (F.col("id") % 4).alias("n"))
    got = {r["p"]: r["o"] for r in running_offset(rows, "k", "p", "n", "o", span=7).collect()}
    assert got == {p: sum(i % 4 for i in range(p)) for p in range(50)}


def test_salted_join_keeps_every_pair_once(spark):
    big = spark.range(100).select(F.lit("hot").alias("k"), "id")
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3)], "k string, v int")
    assert salted_join(big, other, ["k"], ["id"]).count() == 200
    assert salted_join(big, other, ["k"], ["id"], "left_anti").count() == 0


def test_equal_texts_share_a_vector(spark):
    rows = spark.createDataFrame([(1, "loan rate"), (2, "loan rate"), (3, " "), (4, "date")], "id long, text string")
    got = {r["id"]: r["embedding"] for r in embed_texts(rows, ["id"]).collect()}
    assert got[1] == got[2] and got[3] is None and got[4] != got[1] and len(got[1]) == 64


def test_failed_model_batch_gives_nulls(spark):
    def broken(prompts):
        raise RuntimeError("down")

    rows = spark.createDataFrame([("r", 0, "ask")], "request_id string, attempt int, prompt string")
    assert call_model(rows, broken, "analysis").first()["response"] is None
    assert call_model(rows, lambda p: [x.upper() for x in p], "chat").first()["response"] == "ASK"


def test_only_the_failing_prompt_is_lost(spark):
    def picky(prompts):
        if "bad" in prompts:
            raise RuntimeError("down")
        return [p.upper() for p in prompts if p != "short"]

    asked = ["a", "bad", "b", "short", "c", "d"]
    rows = spark.createDataFrame([(str(i), 0, p) for i, p in enumerate(asked)], "request_id string, attempt int, prompt string").coalesce(1)
    for batch in (1, 3, 100):
        got = {r["request_id"]: r["response"] for r in call_model(rows, picky, "chat", batch).collect()}
        assert got == {"0": "A", "1": None, "2": "B", "3": None, "4": "C", "5": "D"}


def test_retention_follows_its_clock_and_repeats_nothing(spark, tmp_path):
    rows = [(1, at(0)), (2, at(99)), (3, at(100)), (4, None), (5, at(86_500))]
    spark.createDataFrame(rows, "id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/a")

    def run():
        stream = spark.readStream.schema("id long, ts timestamp").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        jobs.retain(stream, f"{tmp_path}/out", f"{tmp_path}/log", as_of=F.lit(at(86_500))).awaitTermination()
        return sorted(r.id for r in spark.read.schema("id long, ts timestamp").parquet(f"{tmp_path}/out").collect())

    assert run() == [3, 5]
    assert run() == [3, 5]
    spark.createDataFrame([(6, at(50)), (7, at(200))], "id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    assert run() == [3, 5, 7]


def test_catalogue_names_every_file_and_rejects_other_kinds(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("a.pdf", "B.PDF", "deep/c.docx", "d.txt", "none", "two.pdf.zip"):
        (tmp_path / "in" / name).write_bytes(b"x" * len(name))
    found = {r.path.split("/in/")[1]: r for r in file_catalogue(spark, f"{tmp_path}/in").collect()}
    assert {k: (r.status, r.length) for k, r in found.items()} == {
        "a.pdf": ("accepted", 5), "B.PDF": ("accepted", 5), "deep/c.docx": ("accepted", 11),
        "d.txt": ("error", 5), "none": ("error", 4), "two.pdf.zip": ("error", 11),
    }
    assert found["d.txt"].message == "Unsupported file type: .txt" and found["none"].message == "Unsupported file type: "


def test_only_what_failed_is_asked_again(spark, tmp_path):
    requests = spark.createDataFrame([(k, 1, f"p{k}") for k in range(70)] + [(3, 2, "again")], "request_id long, attempt int, prompt string")

    def first(prompts):
        if "p5" in prompts or "p69" in prompts:
            raise RuntimeError
        return [p.upper() for p in prompts]

    path = f"{tmp_path}/said"
    store_responses(call_model(requests, first, "k"), path)
    left = pending(requests, read_responses(spark, path), "k")
    assert sorted((r.request_id, r.attempt) for r in left.collect()) == [("5", 1), ("69", 1)]
    assert pending(requests, read_responses(spark, path), "other").count() == 71
    store_responses(call_model(left, lambda prompts: [None if p == "p5" else "late" for p in prompts], "k"), path)
    found = {(r.request_id, r.attempt): r.response for r in responses_for(requests, read_responses(spark, path), "k").collect()}
    assert len(found) == 71 and found["5", 1] is None and found["69", 1] == "late" and found["3", 2] == "AGAIN" and found["7", 1] == "P7"


def test_salted_join_never_gathers_the_repeated_side(spark):
    big = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    other = spark.range(3).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    plan = salted_join(big, other, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan

"""Structured Streaming forms of session expiry, retention and incremental ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proofloom.operators.chunking import Chunker, chunks_from_documents
from proofloom.operators.corpus import MAX_AGE, SESSION_GAP, is_expired

LEDGER = "doc_id long, content string, batch_id long"


def stream_sessions(events: DataFrame, user: str = "user_id", stamp: str = "ts", gap: int = SESSION_GAP) -> DataFrame:
    """Sessions closed by inactivity; append mode emits each once the watermark passes its end."""
    return (
        events.withWatermark(stamp, f"{gap} seconds")
        .groupBy(F.col(user), F.session_window(stamp, f"{gap} seconds").alias("_w"))
        .agg(F.count("*").alias("n_events"), F.max(stamp).alias("last_access"))
        .select(user, F.col("_w.start").alias("session_start"), "last_access", "n_events")
    )


def stream_retained(artefacts: DataFrame, stamp: str = "ts", max_age: int = MAX_AGE, as_of: Column | None = None) -> DataFrame:
    """Artefacts that are no older than ``max_age`` seconds at ``as_of``; those without a time are dropped.

    A given clock makes a replay keep the same rows; without one each micro-batch goes by the wall clock."""
    now = F.current_timestamp() if as_of is None else as_of
    return artefacts.where(~is_expired(stamp, now, max_age))


def retain(
    artefacts: DataFrame, output: str, checkpoint: str, stamp: str = "ts", max_age: int = MAX_AGE, as_of: Column | None = None
) -> StreamingQuery:
    """Writes what ``stream_retained`` keeps of all that has arrived to a Parquet folder, then ends.

    The folder's log names each micro-batch once, so a restart or a repeated batch adds nothing twice."""
    kept = stream_retained(artefacts, stamp, max_age, as_of)
    sink = kept.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    return sink.trigger(availableNow=True).start()


def _existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Keys already written; an output folder that does not exist yet holds none."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def ingest_plan(state: DataFrame, batch: DataFrame, version: str | None = None) -> DataFrame:
    """(doc_id, text, content, action) for every document of ``batch``.

    ``state`` has (doc_id, content) of the documents that are held, ``content`` being the text's hash.
    A document is added, changed, unchanged or, if ``batch`` has a true ``removed``, removed; removing
    what isn't held is unchanged. Of several rows of a document the one with the greatest ``version``
    counts, and of equal ones the greatest text. Rows without an id are left out; a null text is empty."""
    gone = F.coalesce(F.col("removed"), F.lit(False)) if "removed" in batch.columns else F.lit(False)
    age = F.col(version) if version else F.lit(0)
    rows = batch.where("doc_id IS NOT NULL").select("doc_id", F.struct(age.alias("v"), F.coalesce("text", F.lit("")).alias("text"), gone.alias("gone")).alias("r"))
    newest = rows.groupBy("doc_id").agg(F.max("r").alias("r")).select("doc_id", "r.text", "r.gone").withColumn("content", F.sha2("text", 256))
    held = state.select("doc_id", F.col("content").alias("_held"))
    action = (
        F.when(F.col("gone") & F.col("_held").isNotNull(), "removed")
        .when(F.col("gone") | (F.col("_held") == F.col("content")), "unchanged")
        .when(F.col("_held").isNull(), "added")
        .otherwise("changed")
    )
    return newest.join(held, "doc_id", "left").select("doc_id", "text", "content", action.alias("action"))


def _held(ledger: DataFrame) -> DataFrame:
    """(doc_id, content, batch_id): the last entry of every document that is still held."""
    last = ledger.groupBy("doc_id").agg(F.max(F.struct("batch_id", "content")).alias("e"))
    return last.select("doc_id", "e.content", "e.batch_id").where("content IS NOT NULL")


def ledger_path(chunk_path: str) -> str:
    return f"{chunk_path.rstrip('/')}-ledger"


def current_chunks(spark: SparkSession, chunk_path: str) -> DataFrame:
    """Chunks of the held documents in their newest form; replaced and removed ones are passed over."""
    held = _held(_existing(spark, ledger_path(chunk_path), LEDGER)).select("doc_id", "batch_id")
    return spark.read.parquet(chunk_path).join(held, ["doc_id", "batch_id"], "left_semi")


def ingest_stream(
    documents: DataFrame,
    chunk_path: str,
    checkpoint: str,
    chunker: Chunker = chunks_from_documents,
    version: str | None = None,
) -> StreamingQuery:
    """Chunk documents as they arrive; a changed text replaces the old one, a removed document goes.

    Every micro-batch writes a partition of chunks and one of the ledger (doc_id, content, null where
    removed) in overwrite mode, the ledger last, so a batch that is replayed after a failure replaces
    itself. Only the ledger's narrow rows of arriving documents are looked at. ``current_chunks`` reads
    the result."""

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ledger = _existing(spark, ledger_path(chunk_path), LEDGER).where(F.col("batch_id") < batch_id)
        known = ledger.join(batch.select("doc_id").distinct(), "doc_id", "left_semi")
        planned = ingest_plan(_held(known), batch, version).where("action <> 'unchanged'")
        fresh = planned.where("action <> 'removed'").select("doc_id", "text")
        chunker(fresh).write.mode("overwrite").parquet(f"{chunk_path}/batch_id={batch_id}")
        entries = planned.select("doc_id", F.when(F.col("action") != "removed", F.col("content")).alias("content"))
        entries.write.mode("overwrite").parquet(f"{ledger_path(chunk_path)}/batch_id={batch_id}")

    return (
        documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )

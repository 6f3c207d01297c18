"""Model output as tables: stored responses, or a user's endpoint called per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESPONSES = "request_id string, kind string, attempt int, response string"
EMBED_BATCH = 32
CALL_BATCH = 32
# A text is held often if it fills more than one in so many rows, and more than so many.
HOT_SHARE = 1000
HOT_ROWS = 1000


def read_responses(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Stored raw responses (JSON lines); ``response`` is null for a failed call."""
    rows = spark.read.schema(RESPONSES).json(path)
    return rows if kind is None else rows.where(F.col("kind") == kind)


def call_model(requests: DataFrame, complete: Callable[[list[str]], list[str | None]], kind: str, batch: int = CALL_BATCH) -> DataFrame:
    """Send ``prompt`` texts to ``complete``, at most ``batch`` at a time.

    A call that fails, or answers with another number of texts, is repeated prompt by prompt, so that
    only the failing prompts have a null response."""

    def answered(prompts: list[str]) -> list[str | None]:
        try:
            answers = list(complete(prompts))
            if len(answers) == len(prompts):
                return answers
        except Exception:
            pass
        return [None] if len(prompts) == 1 else [answer for prompt in prompts for answer in answered([prompt])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                some = rows.iloc[at : at + batch]
                answers = answered(some["prompt"].tolist())
                yield pd.DataFrame(
                    {"request_id": some["request_id"].array, "kind": kind, "attempt": some["attempt"].array, "response": answers}
                )

    return requests.select(F.col("request_id").cast("string").alias("request_id"), "attempt", "prompt").mapInPandas(
        run, RESPONSES
    )


def pending(requests: DataFrame, held: DataFrame, kind: str) -> DataFrame:
    """Requests without a stored response of this kind, told by request and attempt: only these need a call."""
    done = held.where((F.col("kind") == kind) & F.col("response").isNotNull()).select("request_id", "attempt").distinct()
    return requests.withColumn("request_id", F.col("request_id").cast("string")).join(done, ["request_id", "attempt"], "left_anti")


def store_responses(responses: DataFrame, path: str) -> None:
    """Adds what was answered to the stored responses; failed calls are left out and stay pending."""
    responses.where(F.col("response").isNotNull()).write.mode("append").json(path)


def responses_for(requests: DataFrame, held: DataFrame, kind: str) -> DataFrame:
    """A row for every request; ``response`` is null where no call has succeeded. Of several the greatest counts."""
    said = held.where(F.col("kind") == kind).groupBy("request_id", "attempt").agg(F.max("response").alias("response"))
    asked = requests.select(F.col("request_id").cast("string").alias("request_id"), "attempt")
    return asked.join(said, ["request_id", "attempt"], "left").select("request_id", F.lit(kind).alias("kind"), "attempt", "response")


def hash_embedder(dim: int = 64):
    """Offline embedder: signed token hashing into ``dim`` buckets, unit length."""

    def make():
        import numpy as np
        import xxhash

        def embed(texts):
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for row, text in enumerate(texts):
                for token in str(text).lower().split():
                    h = xxhash.xxh64_intdigest(token)
                    out[row, h % dim] += 1.0 if (h >> 32) & 1 else -1.0
                norm = np.linalg.norm(out[row])
                if norm > 0:
                    out[row] /= norm
            return out

        return embed

    return make


def embed_texts(
    rows: DataFrame, spread_by: list[str], text: str = "text", make_embedder=None, batch: int = EMBED_BATCH
) -> DataFrame:
    """Add ``embedding``: equal texts are embedded once, then joined back by content hash. ``spread_by`` is no longer needed.

    Copies of one text may be a large share of the rows: vectors of the texts that hold more than one in ``HOT_SHARE``
    rows each, so at most that many, are broadcast to their rows, and only the others are joined by hash. A blank text or
    a failed vector gives null.
    """
    embed = predict_batch_udf(make_embedder or hash_embedder(), return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    keyed = rows.withColumn("_key", F.sha2(F.col(text), 256))
    filled = keyed.where(F.length(F.trim(text)) > 0)
    distinct = filled.groupBy("_key").agg(F.any_value(text).alias("_text"))
    vectors = distinct.select("_key", embed("_text").alias("_vector")).select(
        "_key", F.when(F.exists("_vector", lambda v: v != 0), F.col("_vector")).alias("embedding")
    )
    hot = _hot_keys(filled)
    bare = keyed.where(~F.coalesce(F.length(F.trim(text)) > 0, F.lit(False)))
    found = bare.withColumn("embedding", F.lit(None).cast("array<float>"))
    often = F.col("_key").isin(hot) if hot else F.lit(False)
    found = found.unionByName(filled.where(~often).join(vectors.where(~often).hint("merge"), ["_key"], "left"))
    if hot:
        found = found.unionByName(filled.where(often).join(F.broadcast(vectors.where(often)), ["_key"], "left"))
    return found.drop("_key")


def _hot_keys(keyed: DataFrame) -> list[str]:
    """Keys with more than one in ``HOT_SHARE`` of the rows and ``HOT_ROWS`` at least."""
    counts = keyed.groupBy("_key").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(HOT_ROWS), F.col("total") / HOT_SHARE)
    total = keyed.agg(F.count("*").alias("total"))
    return [r["_key"] for r in counts.join(F.broadcast(total)).where(F.col("n") > least).select("_key").collect()]

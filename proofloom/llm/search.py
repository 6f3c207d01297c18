"""Exact top-k by inner product: a grid of tiles, each one matrix product with a partial selection, and a tree of merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS = 1024
SHARD_ROWS = 2048
FAN_IN = 64
EXACT = float(1 << 53)
FOUND = "query_id long, vec_id long, score long, shard int"


def scaled(vector: Column, factor: int = 256) -> Column:
    """Components as whole numbers, or null for a vector that is null or holds a null, infinite or undefined component."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | F.abs(x.cast("double")).isin(float("inf")))
    return F.when(~odd, whole)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point where no sum can leave the whole numbers it holds, else in 64 bits."""
    if queries.size and rows.size:
        most = float(np.abs(queries.astype(float)).max()) * float(np.abs(rows.astype(float)).max()) * queries.shape[1]
        if most < EXACT:
            return queries.astype(float) @ rows.astype(float).T
    return queries @ rows.T


def tile_best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query the k best rows of the tile, ties to the smaller id; rows come sorted by id."""
    scores = products(queries, rows)
    for q, row in zip(query_ids.tolist(), scores, strict=True):
        at = np.flatnonzero(ids != q)
        if len(at) > k:
            own = row[at]
            bar = np.partition(own, len(own) - k)[len(own) - k]
            above = at[own > bar]
            at = np.concatenate([above, at[own == bar][: k - len(above)]])
        at = at[np.lexsort((ids[at], -row[at]))]
        yield q, ids[at], row[at]


def _tile(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    if len(queries) and len(rows):
        rows = rows.sort_values("id", kind="stable")
        ids = rows["id"].to_numpy(np.int64)
        matrix = np.stack(rows["v"].to_numpy()).astype(np.int64)
        for start in range(0, len(queries), QUERY_ROWS):
            some = queries.iloc[start : start + QUERY_ROWS]
            found += tile_best(np.stack(some["v"].to_numpy()).astype(np.int64), some["id"].to_numpy(np.int64), matrix, ids, k)
    flat = [np.concatenate([part[side] for part in found]) if found else np.empty(0) for side in (1, 2)]
    asked = np.repeat(np.array([q for q, _, _ in found], np.int64), [len(ids) for _, ids, _ in found])
    return pd.DataFrame({"query_id": asked, "vec_id": flat[0].astype(np.int64), "score": flat[1].astype(np.int64), "shard": np.int32(key[1])})


def _best(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query row among all other rows.

    ``vector`` holds whole numbers; rows with a null id or vector take no part, and vectors of different
    length are not compared. A row is another one if its id differs; repeated rows each count. Queries meet
    rows in tiles of about 1024 by 2048: each side is dealt by a hash of the row alone, so that a task that
    runs again deals alike, and both sides are copied once per block of the other. Equal rows are counted
    first and dealt as numbered copies, k at most, since no result holds more; so no id, vector or source
    makes a large tile."""
    rows, asked = (
        df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<bigint>").alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .withColumn("n", F.size("v"))
        for df in (vectors, queries.distinct())
    )
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    at = lambda n, *key: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    rows = rows.groupBy("id", "v", "n").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    asked = asked.withColumn("block", at(blocks, "id", "v")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = rows.withColumn("shard", at(shards, "id", "v", "copy")).drop("copy").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ("block", "shard", "n")
    found = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(lambda key, q, r: _tile(key, q, r, k), FOUND)
    while shards > FAN_IN:
        found = _best(found.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int")), ["query_id", "shard"], k).drop("rank")
        shards = -(-shards // FAN_IN)
    return _best(found, ["query_id"], k).select("query_id", "rank", "vec_id", "score")

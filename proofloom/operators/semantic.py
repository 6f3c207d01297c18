"""Cosine ranking with numpy inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.functions.spread import first_rows, is_small, join_checked, long_range, salted_join
from proofloom.operators.lexical import RANK_DIGITS, TOP_K

QUERY_VECTORS = 2048
# A cell of the grid: queries and chunks at most. Wide cells repeat the vectors and the partial results less often.
QUERY_BLOCK = 8192
LEAST_BLOCK = 256
CHUNK_SLICE = 81_920
CELLS = 4_000_000
# Columns that share a highest score, and how many times k scores of a row may reach the bar before ties are counted.
GROUP = 16
MANY = 8
PAIRS = 65_536
# Documents within so many chunk numbers are ranked whole in one task, where so many queries make that pay.
SPAN = 4096
FEW_QUERIES = 16
SCORED = "query_id long, doc_id long, chunk_index int, score double"


def split_by_dimension(vectors: DataFrame, dim: int, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows with the expected vector size, and the rejects that need to be embedded again."""
    fits = F.coalesce(F.size(column) == dim, F.lit(False))
    return vectors.where(fits), vectors.where(~fits)


def query_dimension(queries: DataFrame, column: str = "embedding") -> int | None:
    """The one vector size of all queries, None without any; queries of several sizes are an error."""
    least, most = queries.select(F.size(column).alias("n")).agg(F.min("n"), F.max("n")).first()
    if least != most:
        raise ValueError(f"query vectors of {least} to {most} components: name the right size as dim")
    return most


def cosine(a, b) -> Column:
    """Cosine of two array columns; null when either has no length (zero vector)."""

    def dot(x: Column, y: Column) -> Column:
        pairs = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(pairs, F.lit(0.0), lambda total, step: total + step)

    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return dot(x, y) / F.nullif(norm, F.lit(0.0))


def _matrix(values: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((matrix * matrix).sum(axis=1))
    usable = norm > 0
    return matrix[usable] / norm[usable, None], usable


def _first_k(scores: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the ``k`` highest of their column, the upper ones of equals."""
    across = scores.T
    bar = np.partition(across, -k, axis=1)[:, -k:][:, :1]
    above, level = across > bar, across == bar
    return (above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))).T


def _bar(scores: np.ndarray, k: int) -> np.ndarray:
    """A value per row that the ``k`` highest of the row reach: the k-th highest among the best of groups of columns."""
    rows, size = scores.shape
    width = max(1, min(GROUP, size // (8 * k)))
    best = scores[:, : size // width * width].reshape(rows, width, -1).max(axis=1)
    return np.partition(best, -k, axis=1)[:, -k]


def _best_of(unit: np.ndarray, chunk: np.ndarray, coarse: np.ndarray, starts: np.ndarray, k: int):
    """Row, column and rounded score of the ``k`` highest cosines of every row in each run of columns.

    ``starts`` names the first column of each run; the left ones of equals count. Not-a-number is the highest, as in
    Spark's order. Products in single precision (``coarse``: the chunks across) only shut out what lies further below the
    bar than their error and the rounding reach; what is left is computed again in double precision.
    """
    scores = unit.astype(np.float32) @ coarse
    odd = bool(np.isnan(unit).any() or np.isnan(chunk).any())
    if odd:
        np.nan_to_num(scores, copy=False, nan=np.inf)
    slack = np.float32((unit.shape[1] + 16) * np.finfo(np.float32).eps + 2 * 10.0**-RANK_DIGITS)
    keep = np.ones(scores.shape, dtype=bool)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), scores.shape[1]]):
        if b - a <= k:
            continue
        run = scores[:, a:b]
        np.greater_equal(run, _bar(run, k)[:, None] - slack, out=keep[:, a:b])
        many = np.flatnonzero(np.count_nonzero(keep[:, a:b], axis=1) > MANY * k)
        if len(many):
            exact = np.round(unit[many] @ chunk[a:b].T, RANK_DIGITS)
            keep[many, a:b] = _first_k(np.where(np.isnan(exact), np.inf, exact).T, k).T
    row, col = np.divmod(np.flatnonzero(keep), scores.shape[1])
    score = np.concatenate([np.zeros(0), *(np.round(np.einsum("ij,ij->i", unit[row[at : at + PAIRS]], chunk[col[at : at + PAIRS]]), RANK_DIGITS) for at in range(0, len(row), PAIRS))])
    run = np.searchsorted(starts, col, "right")
    # Already by row, run and column: a stable sort by score inside these puts the left ones of equals first.
    order = np.lexsort((np.where(np.isnan(score), -np.inf, -score), run, row))
    row, col, score, run = row[order], col[order], score[order], run[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (run[1:] != run[:-1])][: len(row)])
    best = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
    return row[best], col[best], score[best]


def _rank_batches(batches: Iterator[pa.RecordBatch], ids: np.ndarray, unit: np.ndarray, k: int):
    """Up to k rows per (query, document) of each batch: a partial result, finished by a window."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        chunk, usable = _unit(_matrix(batch.column("embedding"), batch.num_rows))
        if not len(chunk):
            continue
        docs = batch.column("doc_id").to_numpy(zero_copy_only=False)[usable]
        index = batch.column("chunk_index").to_numpy(zero_copy_only=False)[usable]
        order = np.lexsort((index, docs))
        docs, index, chunk = docs[order], index[order], chunk[order]
        coarse = np.ascontiguousarray(chunk.T, dtype=np.float32)
        starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        step = max(1, CELLS // len(chunk))
        for at in range(0, len(ids), step):
            row, col, score = _best_of(unit[at : at + step], chunk, coarse, starts, k)
            columns = (pa.array(ids[at : at + step][row], pa.int64()), pa.array(docs[col], pa.int64()), pa.array(index[col], pa.int32()), pa.array(score, pa.float64()))
            yield from pa.table(dict(zip(("query_id", "doc_id", "chunk_index", "score"), columns))).to_batches(max_chunksize=65536)


def _ranked_documents(batches: Iterator[pa.RecordBatch], ids: np.ndarray, unit: np.ndarray, k: int):
    """The k best chunks with their ranks per (query, document), for rows in document and chunk order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(docs, docs[-1], "left"))
        if last:
            yield from _documents(pa.Table.from_batches([*held, batch.slice(0, last)]), ids, unit, k)
            held = []
        held.append(batch.slice(last))
        if held[0].column("doc_id")[0].as_py() != docs[-1]:
            yield from _documents(pa.Table.from_batches(held[:-1]), ids, unit, k)
            held = held[-1:]
    if held:
        yield from _documents(pa.Table.from_batches(held), ids, unit, k)


def _documents(rows: pa.Table, ids: np.ndarray, unit: np.ndarray, k: int):
    chunk, usable = _unit(_matrix(rows["embedding"], rows.num_rows))
    docs, index = (rows[name].to_numpy()[usable] for name in ("doc_id", "chunk_index"))
    if not len(docs):
        return
    starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    stops = np.r_[starts[1:], len(docs)]
    step = max(1, CELLS // len(chunk))
    for at in range(0, len(ids), step):
        asked = ids[at : at + step]
        scores = np.round(unit[at : at + step] @ chunk.T, RANK_DIGITS)
        down = np.where(np.isnan(scores), -np.inf, -scores)  # in Spark's order not-a-number is the highest
        places = [np.argsort(down[:, a:b], axis=1, kind="stable")[:, :k] + a for a, b in zip(starts.tolist(), stops.tolist())]
        row = np.concatenate([p.ravel() for p in places])
        width = np.array([p.shape[1] for p in places])
        col = np.concatenate([np.repeat(np.arange(len(asked)), n) for n in width.tolist()])
        rank = np.concatenate([np.tile(np.arange(1, n + 1, dtype=np.int32), len(asked)) for n in width.tolist()])
        columns = (pa.array(asked[col], pa.int64()), pa.array(docs[row], pa.int64()), pa.array(index[row], pa.int32()), pa.array(scores[col, row], pa.float64()), pa.array(rank))
        yield from pa.table(dict(zip(("query_id", "doc_id", "chunk_index", "score", "rank"), columns))).to_batches(max_chunksize=65536)


def _by_broadcast(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Query vectors proven few: one matrix product per Arrow batch, pairs never materialise.

    Unless very few queries ask, chunks move to their document's task once and come out ranked, so that only chunks
    are shuffled, not scores. Documents of more than SPAN chunk numbers stay spread: their batches pass on k rows."""
    order = [F.desc("score"), F.asc("chunk_index")]
    local = queries.select("query_id", "embedding").toPandas()
    if local.empty:
        return chunks.sparkSession.createDataFrame([], f"{SCORED}, rank int")
    unit, usable = _unit(np.stack(local["embedding"].to_numpy()).astype(np.float64))
    shared = chunks.sparkSession.sparkContext.broadcast((local["query_id"].to_numpy()[usable], unit))

    def score(batches):
        ids, matrix = shared.value
        yield from _rank_batches(batches, ids, matrix, k)

    def rank(batches):
        ids, matrix = shared.value
        yield from _ranked_documents(batches, ids, matrix, k)

    rows = chunks.select("doc_id", "chunk_index", "embedding")
    if len(local) < FEW_QUERIES:
        return first_rows(rows.mapInArrow(score, SCORED), ["query_id", "doc_id"], order, k)
    far = (F.col("chunk_index") < 0) | (F.col("chunk_index") >= SPAN)
    long = rows.where(far).select("doc_id").distinct()
    some = not long.isEmpty()
    short = join_checked(rows, long, ["doc_id"], ["chunk_index"], "left_anti") if some else rows
    laid = short.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index")
    ranked = laid.mapInArrow(rank, f"{SCORED}, rank int")
    if not some:
        return ranked
    spread = join_checked(rows, long, ["doc_id"], ["chunk_index"], "left_semi").mapInArrow(score, SCORED)
    return ranked.unionByName(first_rows(spread, ["query_id", "doc_id"], order, k))


def _by_grid(chunks: DataFrame, queries: DataFrame, k: int, block: int, slice_rows: int) -> DataFrame:
    """Many query vectors: bounded query blocks meet bounded chunk slices as a grid of tasks."""
    asked, cores = queries.count(), chunks.sparkSession.sparkContext.defaultParallelism
    n_slices = max(1, -(-chunks.count() // slice_rows))
    # Where the largest cells are fewer than the cores can share out evenly, blocks are smaller.
    n_blocks = max(1, -(-asked // block), min(-(-asked // LEAST_BLOCK), -(-3 * cores // n_slices)))
    q = queries.select(
        "query_id",
        F.col("embedding").alias("query_vector"),
        F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("_block"),
        F.explode(long_range(n_slices)).alias("_slice"),
    )
    c = chunks.select(
        "doc_id",
        "chunk_index",
        "embedding",
        F.pmod(F.xxhash64("doc_id", "chunk_index"), F.lit(n_slices)).alias("_slice"),
        F.explode(long_range(n_blocks)).alias("_block"),
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.table({f.name: pa.array([], f.type) for f in _SCHEMA})
        if left.num_rows and right.num_rows:
            unit, usable = _unit(_matrix(left["query_vector"], left.num_rows))
            ids = left["query_id"].to_numpy()[usable]
            parts = list(_rank_batches(right.combine_chunks().to_batches(), ids, unit, k))
            if parts:
                out = pa.Table.from_batches(parts)
        return out

    return q.groupBy("_block", "_slice").cogroup(c.groupBy("_block", "_slice")).applyInArrow(score, SCORED)


_SCHEMA = [
    pa.field("query_id", pa.int64()),
    pa.field("doc_id", pa.int64()),
    pa.field("chunk_index", pa.int32()),
    pa.field("score", pa.float64()),
]


def semantic_top_k(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = TOP_K,
    dim: int | None = None,
    scope: DataFrame | None = None,
    query_limit: int = QUERY_VECTORS,
    block: int = QUERY_BLOCK,
    slice_rows: int = CHUNK_SLICE,
) -> DataFrame:
    """The ``k`` chunks per (query, document) with the highest cosine, ties by chunk number.

    Every query meets every chunk by definition. The product is done as matrix blocks inside
    tasks, which pass on at most ``k`` rows per (query, document) and batch. Vectors of another size
    than ``dim``, by default that of the queries, take no part; ``split_by_dimension`` names them.
    """
    wanted = queries.where(F.col("embedding").isNotNull())
    usable = chunks.where(F.col("embedding").isNotNull())
    dim = query_dimension(wanted) if dim is None else dim
    if dim is not None:
        wanted, usable = split_by_dimension(wanted, dim)[0], split_by_dimension(usable, dim)[0]
    usable = usable.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn(
        "chunk_index", F.col("chunk_index").cast("int")
    )
    if scope is not None:
        return _by_scope(wanted, usable, scope, k)
    if is_small(wanted, query_limit):
        return _by_broadcast(usable, wanted, k)
    scored = _by_grid(usable, wanted, k, block, slice_rows)
    return first_rows(scored, ["query_id", "doc_id"], [F.desc("score"), F.asc("chunk_index")], k)


def _by_scope(queries: DataFrame, chunks: DataFrame, scope: DataFrame, k: int) -> DataFrame:
    """Queries that ask named documents only: equi joins, cosine in the JVM."""
    asked = scope.join(queries.select("query_id", F.col("embedding").alias("query_vector")), "query_id")
    scored = (
        salted_join(chunks.select("doc_id", "chunk_index", "embedding"), asked, ["doc_id"], ["chunk_index"])
        .withColumn("score", F.round(cosine("embedding", "query_vector"), RANK_DIGITS))
        .where(F.col("score").isNotNull())
        .select("query_id", "doc_id", "chunk_index", "score")
    )
    return first_rows(scored, ["query_id", "doc_id"], [F.desc("score"), F.asc("chunk_index")], k)

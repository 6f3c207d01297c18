"""Hard negatives by cover trees over norm-augmented candidates.

A candidate x gets one more component, the root of M^2 - |x|^2 with M the greatest norm of its shard, and an anchor
q gets a zero: inner products stay as they are, all candidates lie on one sphere, and the nearest candidate is the
one with the highest inner product. A cover tree over them halves its covering radius from level to level: the
centres of a level are further apart than its radius, and each node knows the true distance R of its farthest
member. With c its centre, every member's inner product lies within q.c - |q|R and q.c + |q|R.

A descent takes the open node with the highest upper bound first. Nodes whose bounds miss every window of the
anchor, or cannot reach the k best found in it, are skipped with all below them; members of leaves are checked with
exact whole-number products. Bounds are widened by more than their rounding error, so nothing is lost.

Candidates are dealt to shards by a hash of the row, anchors to blocks; each pair of a block and a shard is one
group, and per anchor and window only the k best of a shard leave it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.functions.spread import first_rows
from proofloom.llm.tables import stored

SHARD_ROWS = 4096
BLOCK_ROWS = 1024
LEAF = 16
SHRINK = 0.5
SLACK = 1e-9
FOUND = "anchor long, mark long, window int, id long, score long"


class Node(NamedTuple):
    centre: np.ndarray
    radius: float
    members: np.ndarray | None
    children: tuple[int, ...]


class CoverTree:
    """A cover tree of whole-number vectors, by levels of a shrinking covering radius."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        plain = vectors.astype(float)
        norm = (plain * plain).sum(axis=1)
        self.norm = float(np.sqrt(norm.max())) if len(norm) else 0.0
        self.points = np.column_stack([plain, np.sqrt(np.maximum(norm.max() - norm, 0))]) if len(norm) else plain
        self.nodes: list[Node] = []
        self.tops = (self._grow(np.arange(len(vectors))),) if len(vectors) else ()
        self.centres = np.stack([n.centre for n in self.nodes])[:, :-1] if self.nodes else plain
        self.radii = np.array([n.radius for n in self.nodes])

    def _grow(self, members: np.ndarray) -> int:
        """The node over ``members``, whose first is its centre."""
        centre = self.points[members[0]]
        away = self._away(members, centre)
        radius = float(away.max())
        if len(members) <= LEAF or radius == 0:
            return self._add(Node(centre, radius, members, ()))
        children, alone, reach, left = [], [], radius * SHRINK, members
        while len(left):
            near = away <= reach
            near[0] = True
            if near.sum() == 1:
                alone.append(left[0])
            else:
                children.append(left[near])
            left = left[~near]
            if len(left):
                away = self._away(left, self.points[left[0]])
        grown = [self._grow(c) for c in children]
        if alone:
            grown.append(self._add(Node(centre, radius, np.array(alone), ())))
        return self._add(Node(centre, radius, None, tuple(grown)))

    def _away(self, members: np.ndarray, centre: np.ndarray) -> np.ndarray:
        gap = self.points[members] - centre
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _add(self, node: Node) -> int:
        self.nodes.append(node)
        return len(self.nodes) - 1

    def descend(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, ids: np.ndarray, taken: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window from ``low`` to ``high``: its number, and members (with scores) among which are its ``k``
        best of those ``taken``, ties to the smaller id."""
        at = query.astype(float)
        size = float(np.sqrt((at * at).sum()))
        slack = SLACK * (size * self.norm + 1)
        whole = exact(query, self.vectors)
        bar = low.astype(float)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]
        heap: list[tuple[float, int]] = []

        def enter(nodes: tuple[int, ...]) -> None:
            some = np.array(nodes)
            middle = self.centres[some] @ at
            upper, lower = middle + size * self.radii[some] + slack, middle - size * self.radii[some] - slack
            wanted = ((upper[:, None] >= bar) & (lower[:, None] <= high)).any(axis=1)
            for u, n in zip(upper[wanted].tolist(), some[wanted].tolist(), strict=True):
                heapq.heappush(heap, (-u, n))

        if len(low) and self.tops:
            enter(self.tops)
        while heap:
            upper, n = heapq.heappop(heap)
            if -upper < bar.min():
                break
            node = self.nodes[n]
            if node.members is None:
                enter(node.children)
                continue
            rows = node.members[taken[node.members]]
            scores = whole(rows)
            for w in range(len(low)):
                good = (scores >= bar[w]) & (scores <= high[w])
                if good.any():
                    row, score = np.r_[best[w][0], rows[good]], np.r_[best[w][1], scores[good]]
                    order = np.lexsort((ids[row], -score))[:k]
                    best[w] = row[order], score[order]
                    if len(order) == k:
                        bar[w] = max(bar[w], float(score[order[-1]]))
        for w, (row, score) in enumerate(best):
            yield w, row, score


def exact(query: np.ndarray, vectors: np.ndarray):
    """The whole-number products of a query with given rows; a product beyond 64 bits is an error."""
    top = float(np.abs(vectors.astype(float)).max(initial=0)) * float(np.abs(query.astype(float)).max(initial=0)) * max(1, len(query))
    if top >= float(1 << 53):
        if top >= float(1 << 62):
            raise ValueError("an inner product may need more than 64 bits: use a smaller factor")
        return lambda rows: vectors[rows] @ query
    one = query.astype(float)
    return lambda rows: (vectors[rows].astype(float) @ one).astype(np.int64)


def _group(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """The k best of a shard for each window of each anchor, of the same label or of the others."""
    out = []
    if len(asked) and len(rows):
        vectors = np.stack(rows["v"].to_numpy()).astype(np.int64) if key[2] else np.zeros((len(rows), 0), np.int64)
        ids, labels = rows["id"].to_numpy(np.int64), rows["label"].to_numpy()
        once = ~pd.DataFrame({"id": ids, "label": labels, "v": [v.tobytes() for v in vectors]}).duplicated().to_numpy()
        ids, labels, vectors = ids[once], labels[once], vectors[once]
        tree = CoverTree(vectors)
        for row in asked.itertuples():
            taken = (ids != row.id) & ((labels == row.label) if same else (labels != row.label))
            low, high = np.array(row.low, np.int64), np.array(row.high, np.int64)
            query = np.array(row.v, np.int64)
            for w, found, scores in tree.descend(query, low, high, k, ids, taken):
                out.append((np.repeat(row.id, len(found)), np.repeat(row.mark, len(found)), np.repeat(w, len(found)), ids[found], scores))
    columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(5)]
    return pd.DataFrame(dict(zip(("anchor", "mark", "window", "id", "score"), (c.astype(np.int64) for c in columns), strict=True))).astype({"window": np.int32})


def _searched(asked: DataFrame, rows: DataFrame, shards: int, blocks: int, k: int, same: bool) -> DataFrame:
    keys = ("block", "shard", "n")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", F.pmod(F.col("mark"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    right = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(partial(_group, k=k, same=same), FOUND)
    return first_rows(found, ["anchor", "mark", "window"], [F.desc("score"), F.col("id")], k)


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, vec_id: str = "vec_id", vector: str = "vector", label: str = "label"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of whole-number vectors. An anchor's positives are its ``positives`` best other rows
    of the same label; for each of them come the ``k`` best rows of other labels whose score is from ``low`` to
    ``high`` hundredths of the positive's; ties go to the smaller id. Another row has another id. Rows without an
    id, label or vector take no part; vectors of another length are not compared; equal rows count once; a
    positive score below zero leaves an empty window. Empty tables give an empty result, other columns are not
    read, and a product that could pass 64 bits is an error."""
    rows, asked = (
        df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<bigint>").alias("v"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
        .withColumn("n", F.size("v"))
        for df in (vectors, anchors)
    )
    asked = asked.distinct().withColumn("mark", F.xxhash64("id", "label", "v"))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    whole = asked.withColumn("low", F.array(F.lit(-(1 << 62)))).withColumn("high", F.array(F.lit(1 << 62)))
    near = stored(_searched(whole, rows, shards, blocks, positives, True), "positives")
    bound = lambda share, up: F.expr(f"transform(list, p -> CAST({'ceil' if up else 'floor'}(CAST(p.score AS DECIMAL(38,0)) * {share} / 100) AS BIGINT))")
    mine = near.groupBy("anchor", "mark").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("list"))
    windows = asked.join(mine, ["mark"]).where(F.col("anchor") == F.col("id")).withColumn("low", bound(low, True)).withColumn("high", bound(high, False))
    found = _searched(windows.select(*asked.columns, "low", "high"), rows, shards, blocks, k, False)
    named = near.select("anchor", "mark", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(named, ["anchor", "mark", "window"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )

"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.llm.tables import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """(v, least): for every node the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    found = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return found[0], found[1]


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every linked node; the component is its least node.

    Alternates two steps until nothing changes: each node hangs its larger neighbours, then its smaller
    ones and itself, on the least node it sees. The number of rounds grows with the logarithm of the
    longest chain. Minima are taken before the shuffle, so a node with very many links is no burden."""
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    edges = stored(edges, "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        least = _smallest(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "links")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    linked = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return linked.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

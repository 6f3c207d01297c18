"""Chat formatting after a collapse of cumulative snapshots, with DataFrame functions only.

A log that stores a conversation after every turn holds all its prefixes. The hash of a prefix is the
exclusive or of its turns' hashes, so it can be rolled on over blocks of turns: a conversation with very many
turns is never gathered, neither for its hashes nor for its text. Conversations whose hash is a proper prefix
hash of another one are dropped by an anti-join of distinct hashes, and of equal ones the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofloom.llm.tables import stored

BLOCK = 64


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("turn").isNull(), "turn", F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def prefixes(turns: DataFrame, conv_id: str = "conv_id", block: int = BLOCK) -> DataFrame:
    """(conv, turn, h1, h2, n): per turn number the hashes and the count of all rows up to it.

    Rows that agree in everything count once; several rows may share a turn number. A null turn comes first.
    Rows without a conversation id belong to no conversation and are left out."""
    rows = turns.select(F.col(conv_id).alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text").where("conv IS NOT NULL")
    hashed = rows.select("conv", "turn", _hash(1).alias("a"), _hash(2).alias("b")).distinct()
    per = hashed.groupBy("conv", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 60))).alias("block"), "turn").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count(F.lit(1)).alias("c"))
    per = stored(per, "turns")
    totals = per.groupBy("conv", "block").agg(F.bit_xor("a").alias("ta"), F.bit_xor("b").alias("tb"), F.sum("c").alias("tc"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("conv", "block", *[F.coalesce(f.over(before), F.lit(0)).alias(n) for f, n in ((F.bit_xor("ta"), "ta"), (F.bit_xor("tb"), "tb"), (F.sum("tc"), "tc"))])
    within = Window.partitionBy("conv", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rolled = per.join(base, ["conv", "block"])
    return rolled.select(
        "conv",
        "turn",
        F.col("ta").bitwiseXOR(F.bit_xor("a").over(within)).alias("h1"),
        F.col("tb").bitwiseXOR(F.bit_xor("b").over(within)).alias("h2"),
        (F.col("tc") + F.sum("c").over(within)).alias("n"),
    )


def maximal(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv, n): conversations that are no prefix of a longer one; of equal ones that with the smallest id."""
    rolled = stored(prefixes(turns, conv_id), "prefixes")
    whole = rolled.groupBy("conv").agg(F.max(F.struct("n", "h1", "h2")).alias("w")).select("conv", "w.*")
    first = whole.groupBy("n", "h1", "h2").agg(F.min("conv").alias("conv"))
    proper = rolled.join(whole.select("conv", F.col("n").alias("all")), "conv").where("n < all").select("n", "h1", "h2").distinct()
    return first.join(proper, ["n", "h1", "h2"], "left_anti").select("conv", "n")


def rendered(turns: DataFrame, conv_id: str = "conv_id", block: int = BLOCK) -> DataFrame:
    """(conv_id, part, n_rows, chat): the kept conversations in chat markup, in parts of 64 turn numbers.

    Ordinary conversations have one part; one with very many turns has as many as it needs, in the order of
    ``part``. Null roles become ``user`` and null texts empty; roles are lower-cased. Equal rows are shown once,
    rows of one turn number in the order of role and text. An empty table gives an empty one."""
    kept = maximal(turns, conv_id).select(F.col("conv").alias("conv_id"))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    line = F.concat(F.lit("<|"), F.lower(F.coalesce("role", F.lit("user"))), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    parts = rows.join(kept, "conv_id", "left_semi").groupBy("conv_id", F.coalesce(F.floor(F.col("turn") / block), F.lit(-1)).cast("long").alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line"))))
    return parts.agg(F.count(F.lit(1)).alias("n_rows"), F.array_join(F.transform(ordered, lambda r: r["line"]), "").alias("chat"))

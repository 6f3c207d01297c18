"""Ways to keep big keys spread over tasks: checked broadcasts, salted joins, two-step running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 16


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count at most ``max_rows + 1`` rows; the limit lets Spark stop reading early."""
    return df.limit(max_rows + 1).count() <= max_rows


def long_range(n: int) -> Column:
    """Array of the numbers 0 .. n-1."""
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def salted_join(
    big: DataFrame,
    other: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi join whose hot keys are split over ``salts`` tasks.

    ``big`` rows pick a salt from ``spread_by``; ``other`` is repeated once per salt, so each
    big row still meets every partner exactly once. ``how`` must keep ``big`` rows:
    inner, left, left_semi or left_anti. The join is a merge of shuffled rows by hint: Spark judges ``other``
    by its compressed files, and would gather all its repeated rows in the driver to broadcast them.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot do a {how} join")
    salt = "_salt"
    left = big.withColumn(salt, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = other.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*on, salt], how).drop(salt)


def join_checked(
    big: DataFrame,
    other: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Broadcast ``other`` when a count proves it small, else use a salted shuffle join."""
    if is_small(other, max_rows):
        return big.join(F.broadcast(other), list(on), how)
    return salted_join(big, other, on, spread_by, how)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The ``n`` first rows per key.

    Spark cuts each map task to ``n`` rows per key before the shuffle (WindowGroupLimit), so a
    hot key never moves whole.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def running_offset(
    df: DataFrame, key: str, position: str, amount: str, out: str, span: int = 1024
) -> DataFrame:
    """Exclusive running sum of ``amount`` per ``key`` in ``position`` order, in two steps.

    Positions are grouped in spans. Sums per span are small and get their own running sum;
    inside a span a bounded window finishes the job, so one huge key is many tasks.
    """
    spanned = df.withColumn("_span", F.floor(F.col(position) / span))
    totals = spanned.groupBy(key, "_span").agg(F.sum(amount).alias("_total"))
    before = W.partitionBy(key).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(key, "_span", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(key, "_span").orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    return (
        spanned.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(bases, [key, "_span"])
        .withColumn(out, F.col("_base") + F.col("_in"))
        .drop("_span", "_base", "_in")
    )

"""Changes between corpus snapshots, retention and inactivity sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Inactivity that ends a session, and age at which artefacts go (seconds).
SESSION_GAP = 5400
MAX_AGE = 86_400


def added(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys only the new snapshot has."""
    return new.select(key).distinct().join(old.select(key).distinct(), key, "left_anti")


def removed(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    return added(new, old, key)


def purge(rows: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of documents that are still there."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def changes(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Added and removed keys in one pass over both snapshots."""
    both = old.select(key, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(
        new.select(key, F.lit(0).alias("o"), F.lit(1).alias("n"))
    )
    state = both.groupBy(key).agg(F.max("o").alias("o"), F.max("n").alias("n")).where(F.col("o") != F.col("n"))
    return state.select(key, F.when(F.col("n") == 1, F.lit("added")).otherwise(F.lit("removed")).alias("change"))


def is_expired(stamp: str, as_of: Column, max_age: int = MAX_AGE) -> Column:
    return F.col(stamp) < as_of - F.make_dt_interval(secs=F.lit(max_age))


def sessions(events: DataFrame, user: str = "user_id", stamp: str = "ts", gap: int = SESSION_GAP) -> DataFrame:
    """Inactivity sessions: a pause of more than ``gap`` seconds starts a new one.

    Events are first merged per user and hour, then the hours' session pieces are merged per
    user: a pause is judged once inside its hour and once between neighbouring pieces, and one
    busy user is spread over its hours.
    """
    pause = F.make_dt_interval(secs=F.lit(gap))
    daily = events.select(user, F.col(stamp).alias("_at"), F.date_trunc("hour", stamp).alias("_hour"))
    in_hour = W.partitionBy(user, "_hour").orderBy("_at")
    marked = daily.withColumn("_new", (F.col("_at") > F.lag("_at").over(in_hour) + pause).cast("int"))
    pieces = (
        marked.withColumn("_piece", F.coalesce(F.sum("_new").over(in_hour), F.lit(0)))
        .groupBy(user, "_hour", "_piece")
        .agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.count("*").alias("_n"))
    )
    order = W.partitionBy(user).orderBy("_from")
    joined = pieces.withColumn("_new", (F.col("_from") > F.lag("_to").over(order) + pause).cast("int"))
    numbered = joined.withColumn("session_no", F.coalesce(F.sum("_new").over(order), F.lit(0)))
    return numbered.groupBy(user, "session_no").agg(
        F.min("_from").alias("session_start"), F.max("_to").alias("last_access"), F.sum("_n").alias("n_events")
    )


def expired_sessions(found: DataFrame, as_of: Column, gap: int = SESSION_GAP) -> DataFrame:
    """Sessions idle for more than ``gap`` seconds at ``as_of``."""
    return found.where(as_of > F.col("last_access") + F.make_dt_interval(secs=F.lit(gap)))

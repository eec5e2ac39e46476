"""Joins that hold up under hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgram.session import checkpointed, stored


def join_unique(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", heavy: int = 1000,
                counts: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Join a stored table to one with a single row per key; a key that is hot in ``many`` is not one task's work.

    Keys that hold more than a ``heavy``-th of the rows (so at most ``heavy`` keys) meet their rows by broadcast, the
    others by the usual join. Keys are never null. ``counts`` (keys and ``_n``, stored) and ``rows`` (their sum) save the
    counting, and ``many`` need not be stored then.
    """
    rows = many.count() if rows is None else rows
    least = max(rows // heavy, 1000)
    if rows <= least:
        return many.join(one, keys, how)
    if counts is None:
        counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = checkpointed(counts.filter(F.col("_n") > least).select(*keys))
    if hot.isEmpty():
        return many.join(one, keys, how)
    hot_one = F.broadcast(one.join(F.broadcast(hot), keys, "left_semi"))
    spread = many.join(F.broadcast(hot), keys, "left_anti").join(one, keys, how)
    return spread.unionByName(many.join(F.broadcast(hot), keys, "left_semi").join(hot_one, keys, how))


#: Rows of hot keys that are sent to every task, and parts that a hot key is divided into beyond them.
BROADCAST_ROWS = 200_000
SALTS = 64
#: Rows of one key that a task joins without harm.
HARMLESS = 100_000


def hot_keys(rows: DataFrame, key: str, heavy: int = 1000, harmless: int = HARMLESS) -> DataFrame | None:
    """``key`` of those that hold more than a ``heavy``-th of the rows (so at most ``heavy``) and more than ``harmless``, written;
    None if there are none."""
    n = rows.count()
    least = max(n // heavy, harmless)
    if n <= least:
        return None
    hot = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least).select(key), "hot_keys")
    return None if hot.isEmpty() else hot


def join_hot(many: DataFrame, few: DataFrame, key: str, hot: DataFrame | None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join on ``key`` where ``hot`` keys have many rows in ``many`` and some in ``few``.

    The rows of ``few`` under hot keys are counted: up to ``most`` they are broadcast, beyond it each is copied to every
    salt and the rows of ``many`` are dealt to the salts by their hash.
    """
    if hot is None:
        return many.join(few, key)
    hot = F.broadcast(hot)
    usual = many.join(hot, key, "left_anti").join(few.join(hot, key, "left_anti"), key)
    left, right = many.join(hot, key, "left_semi"), few.join(hot, key, "left_semi")
    if right.limit(most + 1).count() <= most:
        return usual.unionByName(left.join(F.broadcast(right), key))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return usual.unionByName(dealt.join(copies, [key, "_salt"]).drop("_salt"))

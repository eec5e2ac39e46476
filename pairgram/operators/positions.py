"""Position statistics (D1-D5): where the grams of one side that also occur on the
other side sit, as min / max / mean / exact median / population std, plain and
divided by the side's gram count. A side with no shared gram gets 0 everywhere
(the reference's ``[0]`` list).

A window max over ``(conv_id, turn, family, gram)`` flags the shared grams; one
aggregate over ``(conv_id, turn, family, side)`` gives the statistics. Both are
clustered on the pair key, so a pair-partitioned gram table needs no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairgram.keys import PAIR
from pairgram.functions.safe import r6, safe_div

STATS = ("min", "max", "mean", "median", "std")


def shared_flags(grams: DataFrame) -> DataFrame:
    """Add ``shared``: the gram occurs on the other side of the same pair."""
    w = Window.partitionBy(*PAIR, "family", "gram")
    on1 = F.max(F.when(F.col("side") == 1, 1).otherwise(0)).over(w)
    on2 = F.max(F.when(F.col("side") == 2, 1).otherwise(0)).over(w)
    return grams.withColumn(
        "shared", F.when(F.col("side") == 1, on2 == 1).otherwise(on1 == 1))


def gram_positions(grams: DataFrame) -> DataFrame:
    """D1 as rows: ``conv_id, turn, family, side, pos`` of every shared gram occurrence."""
    return shared_flags(grams).filter("shared").select(*PAIR, "family", "side", "pos")


def position_stats(grams: DataFrame) -> DataFrame:
    """D2-D5 per ``(conv_id, turn, family, side)``."""
    hit = F.when(F.col("shared"), F.col("pos"))
    agg = shared_flags(grams).groupBy(*PAIR, "family", "side").agg(
        F.count("gram").cast("bigint").alias("n"),
        F.min(hit).cast("double").alias("min"),
        F.max(hit).cast("double").alias("max"),
        F.avg(hit).alias("mean"),
        F.median(hit).cast("double").alias("median"),
        F.stddev_pop(hit).alias("std"),
    )
    out = [*map(F.col, PAIR), F.col("family"), F.col("side")]
    for s in STATS:
        v = F.coalesce(F.col(s), F.lit(0.0))
        out.append(r6(v).alias(f"pos_{s}"))
        out.append(r6(safe_div(v, F.col("n"))).alias(f"norm_pos_{s}"))
    return agg.select(*out)

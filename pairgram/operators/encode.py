"""Label encoding (F7) and dense 0-based ranks of distinct values, distributed.

A global ``dense_rank() OVER (ORDER BY v)`` runs in one task; instead the
distinct values are range-partitioned and sorted, each partition counts its
rows (one small row per partition), the running sum of those counts gives each
partition's offset, and a row number inside the partition completes the code.
The ranged table is checkpointed so that partition ids stay fixed if a task is
re-run after an executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairgram.joins import join_unique
from pairgram.session import checkpointed, stored


def dense_codes(values: DataFrame, col: str, code_col: str = "code", num_partitions: int | None = None) -> DataFrame:
    """``col, code``: code = number of distinct non-null values smaller than ``col``."""
    spark = values.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = values.select(col).filter(F.col(col).isNotNull()).distinct()
    ranged = checkpointed(distinct.repartitionByRange(n, col).sortWithinPartitions(col)
                          .withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(col)
    return (ranged.join(F.broadcast(offsets), "_pid")
            .select(col, (F.col("_off") + F.row_number().over(w) - 1).cast("bigint").alias(code_col)))


class LabelEncoder:
    """Fit codes on one frame; transform maps unseen values to the vocabulary size."""

    def __init__(self, col: str):
        self.col = col
        self.codes: DataFrame | None = None
        self.size: int | None = None

    def fit(self, df: DataFrame) -> "LabelEncoder":
        self.codes = checkpointed(dense_codes(df, self.col))
        self.size = self.codes.count()
        return self

    def transform(self, df: DataFrame, out_col: str | None = None) -> DataFrame:
        out_col = out_col or f"{self.col}_code"
        joined = df.join(self.codes.withColumnRenamed("code", out_col), self.col, "left")
        return joined.withColumn(out_col, F.coalesce(F.col(out_col), F.lit(self.size).cast("bigint")))


#: Characters of a value that it is ordered by; a value that shares them with another one is ordered by all of it.
HEAD = 96
#: Values with a shared beginning that are sent to every task; more are joined by shuffling.
SHARED_ROWS = 100_000


class FrameEncoder:
    """F7 over many text columns at once: one range partitioning of (column, value), not a sort per column.

    fit numbers the distinct (column, value) rows in order; a column's codes are those numbers
    less its first one, so they are 0-based by sorted distinct value. Null values have no code (null); values that
    fit has not seen get the size of their column's vocabulary.

    Whole values are neither stored nor sorted: a value is known by its key (itself, or its SHA-256 if it is longer than
    its head) and ordered by its head. Only values of which another has the same head are brought in whole. The frame is
    read again for that and for transform, not kept.
    """

    def __init__(self, columns: list[str]):
        self.columns = list(columns)
        self.codes: DataFrame | None = None

    def melted(self, df: DataFrame, *keys: str) -> DataFrame:
        """``keys, column, value``, one row per cell that is not null."""
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in self.columns])
        return df.select(*keys, F.inline(cells)).filter("value IS NOT NULL")

    def keyed(self, df: DataFrame, *keys: str) -> DataFrame:
        """``keys, column, value, head, key``; the key's first byte tells a digest from a value."""
        head = F.substring("value", 1, HEAD)
        whole = F.concat(F.lit(b"\x00"), F.col("value").cast("binary"))
        digest = F.concat(F.lit(b"\x01"), F.unhex(F.sha2("value", 256)))
        return self.melted(df, *keys).select(*keys, "column", "value", head.alias("head"), F.when(head == F.col("value"), whole).otherwise(digest).alias("key"))

    def fit(self, df: DataFrame) -> "FrameEncoder":
        slim = stored(self.keyed(df).select("column", "head", "key").distinct(), "values")
        shared = stored(slim.groupBy("column", "head").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("column", "head"), "shared_heads")
        few = shared.limit(SHARED_ROWS + 1).count()
        if few:
            shared = F.broadcast(shared) if few <= SHARED_ROWS else shared
            whole = self.keyed(df).join(shared, ["column", "head"], "left_semi").select("column", "head", "key", "value").distinct()
            slim = slim.join(shared, ["column", "head"], "left_anti").withColumn("value", F.lit(None).cast("string")).unionByName(whole)
            slim = stored(slim, "values")
        order = ["column", "head", *(["value"] if few else [])]
        placed = checkpointed(slim.repartitionByRange(*order).sortWithinPartitions(*order).select("column", "key")
                              .withColumn("_at", F.monotonically_increasing_id()))
        # one row per partition and column: how many values of the column the partition holds, and its first place
        parts = placed.groupBy("column", F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        before = F.sum("_n").over(Window.partitionBy("column").orderBy("_part")) - F.col("_n")
        parts = parts.select("column", "_part", "_first", before.alias("_before"), F.sum("_n").over(Window.partitionBy("column")).alias("size"))
        placed = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(parts), ["column", "_part"])
        self.codes = stored(placed.select("column", "key", (F.col("_before") + F.col("_at") - F.col("_first")).alias("code"), "size"), "codes")
        return self

    def transform(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """``keys`` and a column ``<column>_code`` for each column; keys name one row each."""
        sizes = F.broadcast(self.codes.groupBy("column").agg(F.max("size").alias("size")))  # a row per column
        cells = stored(self.keyed(df, *keys).select(*keys, "column", "key"), "cells")
        found = join_unique(cells, self.codes.drop("size"), ["column", "key"], "left").join(sizes, "column", "left")
        code = F.coalesce("code", "size", F.lit(0))
        wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, code)).alias(f"{c}_code") for c in self.columns])
        return df.select(*keys).join(wide, keys, "left")

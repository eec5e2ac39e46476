"""Precomputed pair similarities (S9) and their place beside the features.

Sentence similarity is dear, so it is computed once, kept as a file, and joined to the
feature frame of every later run. The table is bucketed by the pair key: its side of that
join is read in place, without an exchange.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from pairgram.keys import PAIR
from pairgram.session import shared_dir
from pairgram.sources.tsv import read_tsv, write_tsv

SIMILARITY_SCHEMA = StructType([*[StructField(c, LongType()) for c in PAIR],
                                *[StructField(c, DoubleType()) for c in ("similarity", "similarity_ic")]])


def write_similarity(similarities: DataFrame, path: str) -> None:
    write_tsv(similarities.select(*SIMILARITY_SCHEMA.names), path)


def read_similarity(spark: SparkSession, path: str) -> DataFrame:
    """``conv_id, turn, similarity, similarity_ic`` from a TSV file, keyed by the pair instead of by its line."""
    return read_tsv(spark, path, SIMILARITY_SCHEMA)


def bucketed(df: DataFrame, name: str, buckets: int | None = None) -> DataFrame:
    """df as a table bucketed and sorted by the pair key, kept in the shared folder."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    # one task per bucket writes one file per bucket
    (df.repartition(buckets, *PAIR).write.format("parquet").option("path", shared_dir(spark, name))
     .bucketBy(buckets, *PAIR).sortBy(*PAIR).saveAsTable(table))
    return spark.table(table)


def attach_similarity(features: DataFrame, similarities: DataFrame) -> DataFrame:
    """The features with the two similarity columns; pairs without them have nulls."""
    return features.join(similarities.hint("merge"), list(PAIR), "left")

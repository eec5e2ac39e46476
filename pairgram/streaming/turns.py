"""Structured Streaming over conversation turns.

The reference has no streaming; what carries over is that the text operators
(tokenisers, n-grams, tag parsing) are stateless column expressions, so the same
functions run unchanged on a streaming DataFrame. ``turn_features`` is one
definition used by both the batch and the streaming path; the stream reads new
parquet files as they land, runs with the ``availableNow`` trigger (process
what is there, then stop) and writes an append-only parquet sink whose
checkpoint lives in the shared folder, so a restarted job resumes exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgram.functions import ngrams as ng
from pairgram.functions import text as tx
from pairgram.session import shared_dir
from pairgram.sources.tables import table_path


def turn_features(turns: DataFrame) -> DataFrame:
    """Per turn: token, alphabetic, digit and distinct char-trigram counts."""
    t = turns.select("conv_id", "turn", tx.word_punct_tokens("text").alias("toks"),
                     F.coalesce(F.col("text"), F.lit("")).alias("txt"))
    return t.select(
        "conv_id", "turn",
        F.size("toks").cast("bigint").alias("n_tokens"),
        F.size(F.filter("toks", lambda x: x.rlike(tx.ALPHA_RE))).cast("bigint").alias("n_alpha"),
        F.size(F.filter("toks", lambda x: x.rlike(tx.DIGIT_RE))).cast("bigint").alias("n_digit"),
        F.size(F.array_distinct(ng.char_ngrams(F.col("txt"), 3))).cast("bigint").alias("n_char3"),
    )


def stream_turn_features(spark: SparkSession, sf_dir: str, sink: str | None = None, max_files: int | None = None) -> DataFrame:
    """Run the stream to completion over the files present; return the sink as a batch frame."""
    src = table_path(sf_dir, "conversations")
    schema = spark.read.parquet(src).schema
    # The file source watches a folder; a glob selects this table's file(s) in it.
    pattern = src[:-1] + "[" + src[-1] + "]"
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(pattern)
    sink = sink or shared_dir(spark, "stream-turn-features")
    query = (turn_features(stream).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{sink}/_checkpoint").option("path", f"{sink}/data")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{sink}/data")

"""Feature plans: compose the operators over the conversation-pair fixture.

The pair frame is hash-partitioned on the pair key once; the gram table, the
gram-count table, the per-pair aggregates, the position windows and the edit
distances all run inside those partitions without another exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgram.operators import grams as G
from pairgram.operators.overlap import metric_group, overlap_metrics, pair_gram_stats
from pairgram.sources import fixtures as fx

# Which families each reference feature block covers.
FAMILIES_FOR = {
    "gram_counts": G.WORD_FAMILIES,
    "digit_counts": ("word1", "stem1"),
    "gram_containment": G.WORD_FAMILIES,
    "common_grams": G.WORD_FAMILIES + G.CHAR_FAMILIES + G.POS_FAMILIES,
    "jaccard": G.WORD_FAMILIES,
    "dice": G.WORD_FAMILIES,
    "sorensen": G.WORD_FAMILIES + G.CHAR_FAMILIES + G.POS_FAMILIES,
    "bag_cosine": G.WORD_FAMILIES + G.CHAR_FAMILIES + G.POS_FAMILIES,
    "gram_prf": G.WORD_FAMILIES + G.CHAR_FAMILIES + G.POS_FAMILIES,
}


def tagged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs plus their rule-tagged sentences (narrow: no exchange after the pairing)."""
    pairs = fx.conversation_pairs(spark, sf_dir)
    return pairs.select("*", fx.tag_sentence(F.col("sent_1")).alias("tags_1"),
                        fx.tag_sentence(F.col("sent_2")).alias("tags_2"))


def family_metrics(spark: SparkSession, sf_dir: str, families) -> DataFrame:
    """All overlap metrics per ``(conv_id, turn, family)`` for the given families."""
    pairs = tagged_pairs(spark, sf_dir)
    gc = G.gram_counts(G.gram_table(pairs, families, keep_empty=True))
    return overlap_metrics(pair_gram_stats(gc))


def metric_query(group: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metric_group(family_metrics(spark, sf_dir, FAMILIES_FOR[group]), group)
    run.__name__ = group
    return run

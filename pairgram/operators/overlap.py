"""Count, overlap, set and bag measures (C1-C18) as aggregates of the gram-count table.

Every metric is a function of ``(ca, cb)`` per distinct gram, so one
``groupBy(conv_id, turn, family)`` over ``gram_counts`` yields all of them:

* |A|, |B| (bag sizes) = sum(ca), sum(cb)
* distinct sizes = count_if(ca>0), count_if(cb>0); |A n B| = count_if(ca>0 and cb>0);
  |A u B| = count(*)
* bag intersection = sum(least(ca, cb)); dot = sum(ca*cb)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgram.keys import PAIR
from pairgram.functions.safe import r6, safe_div
from pairgram.functions.text import DIGIT_RE


def pair_gram_stats(gc: DataFrame) -> DataFrame:
    """Sufficient statistics per ``(conv_id, turn, family)`` from ``gram_counts``."""
    ca, cb = F.col("ca"), F.col("cb")
    digit = F.col("gram").rlike(DIGIT_RE)
    return gc.groupBy(*PAIR, "family").agg(
        F.sum(ca).cast("bigint").alias("count_1"),
        F.sum(cb).cast("bigint").alias("count_2"),
        F.count_if(ca > 0).cast("bigint").alias("unique_1"),
        F.count_if(cb > 0).cast("bigint").alias("unique_2"),
        F.count_if((ca > 0) & (cb > 0)).cast("bigint").alias("n_inter"),
        F.count("gram").cast("bigint").alias("n_union"),
        F.sum(F.least(ca, cb)).cast("bigint").alias("common"),
        F.sum(F.when(cb > 0, ca).otherwise(0)).cast("bigint").alias("count_1_in_2"),
        F.sum(F.when(ca > 0, cb).otherwise(0)).cast("bigint").alias("count_2_in_1"),
        F.sum(F.when(digit, ca).otherwise(0)).cast("bigint").alias("digit_count_1"),
        F.sum(F.when(digit, cb).otherwise(0)).cast("bigint").alias("digit_count_2"),
        F.sum(ca * cb).cast("bigint").alias("dot"),
        F.sum(ca * ca).cast("bigint").alias("sq_1"),
        F.sum(cb * cb).cast("bigint").alias("sq_2"),
    )


def overlap_metrics(stats: DataFrame) -> DataFrame:
    """All C1-C14 metrics; ratios follow the safe-divide rule (0.0 on an empty side)."""
    c = F.col
    precision = safe_div(c("n_inter"), c("unique_1"))
    recall = safe_div(c("n_inter"), c("unique_2"))
    dice = safe_div(2 * c("n_inter"), c("unique_1") + c("unique_2"))
    both_empty = (c("unique_1") + c("unique_2")) == 0
    return stats.select(
        *PAIR, "family",
        "count_1", "count_2", "unique_1", "unique_2",
        r6(safe_div(c("unique_1"), c("count_1"))).alias("unique_ratio_1"),
        r6(safe_div(c("unique_2"), c("count_2"))).alias("unique_ratio_2"),
        "digit_count_1", "digit_count_2",
        r6(safe_div(c("digit_count_1"), c("count_1"))).alias("digit_ratio_1"),
        r6(safe_div(c("digit_count_2"), c("count_2"))).alias("digit_ratio_2"),
        "count_1_in_2", "count_2_in_1",
        r6(safe_div(c("count_1_in_2"), c("count_1"))).alias("ratio_1_in_2"),
        r6(safe_div(c("count_2_in_1"), c("count_2"))).alias("ratio_2_in_1"),
        "common",
        r6(safe_div(c("n_inter"), c("n_union"))).alias("jaccard"),
        r6(dice).alias("dice"),
        r6(F.when(both_empty, F.lit(0.0)).otherwise(1.0 - dice)).alias("sorensen"),
        r6(safe_div(c("dot"), F.sqrt(c("sq_1")) * F.sqrt(c("sq_2")))).alias("cosine"),
        r6(precision).alias("precision"),
        r6(recall).alias("recall"),
        r6(safe_div(2 * precision * recall, precision + recall)).alias("f1"),
    )


# Column groups exposed as separate queries.
METRIC_GROUPS = {
    "gram_counts": ["count_1", "count_2", "unique_1", "unique_2", "unique_ratio_1", "unique_ratio_2"],
    "digit_counts": ["digit_count_1", "digit_count_2", "digit_ratio_1", "digit_ratio_2"],
    "gram_containment": ["count_1_in_2", "count_2_in_1", "ratio_1_in_2", "ratio_2_in_1"],
    "common_grams": ["common"],
    "jaccard": ["jaccard"],
    "dice": ["dice"],
    "sorensen": ["sorensen"],
    "bag_cosine": ["cosine"],
    "gram_prf": ["precision", "recall", "f1"],
}


def metric_group(metrics: DataFrame, group: str) -> DataFrame:
    return metrics.select(*PAIR, "family", *METRIC_GROUPS[group])


def ngram_set_features(pairs: DataFrame, generators: dict, text_cols=("sent_1", "sent_2")) -> DataFrame:
    """Six numbers per pair and generator on n-gram *sets*.

    [min size, max size, |n|, |u|, |small - large|, |large - small|]; the
    smaller set goes first, ties keep the given order. ``generators`` maps a
    name (C1, C2, V1, V2) to a function Column -> set Column.
    """
    rows = []
    for name, gen in generators.items():
        s1 = gen(F.col(text_cols[0]))
        s2 = gen(F.col(text_cols[1]))
        rows.append(F.struct(F.lit(name).alias("feature"), s1.alias("s1"), s2.alias("s2")))
    exploded = pairs.select(*PAIR, F.inline(F.array(*rows)))
    swap = F.size("s1") > F.size("s2")
    small = F.when(swap, F.col("s2")).otherwise(F.col("s1"))
    large = F.when(swap, F.col("s1")).otherwise(F.col("s2"))
    return exploded.select(
        *PAIR, "feature",
        F.size(small).cast("bigint").alias("size_small"),
        F.size(large).cast("bigint").alias("size_large"),
        F.size(F.array_intersect(small, large)).cast("bigint").alias("n_inter"),
        F.size(F.array_union(small, large)).cast("bigint").alias("n_union"),
        F.size(F.array_except(small, large)).cast("bigint").alias("n_small_only"),
        F.size(F.array_except(large, small)).cast("bigint").alias("n_large_only"),
    )

"""E1 per (pair, family): the only per-pair algorithm left after the gram table.

The family lists of both sides are built with the same expressions as the gram
table and handed to the Arrow UDF; rows stay in their partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgram.keys import PAIR
from pairgram.functions.editdist import nlevenshtein
from pairgram.functions.safe import r6
from pairgram.operators import grams as G


def edit_distance(pairs: DataFrame, families, text_cols=("sent_1", "sent_2"),
                  tag_cols=("tags_1", "tags_2")) -> DataFrame:
    """``conv_id, turn, family, levenshtein`` for every family."""
    fams = list(families)
    base = G.with_base_arrays(pairs, fams, text_cols, tag_cols)
    rows = F.inline(F.array(*[
        F.struct(F.lit(f).alias("family"), G.family_array(f, 1).alias("a"), G.family_array(f, 2).alias("b"))
        for f in fams]))
    per_family = base.select(*PAIR, rows)
    return per_family.select(*PAIR, "family", r6(nlevenshtein(F.col("a"), F.col("b"))).alias("levenshtein"))

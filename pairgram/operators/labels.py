"""Label rules and simple projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


from pairgram.keys import PAIR
def train_label(judge: Column) -> Column:
    """First number of the vote tuple: >= 3 -> 1, == 2 -> 2 (ambiguous), else 0."""
    first = F.regexp_extract(judge, r"^\s*\(\s*(\d+)", 1).cast("int")
    return F.when(first >= 3, 1).when(first == 2, 2).otherwise(0)


def test_label(vote: Column) -> Column:
    """Vote 4 or 5 -> 1, 3 -> 2 (ambiguous), else 0."""
    return F.when(vote.isin(4, 5), 1).when(vote == 3, 2).otherwise(0)


def drop_ambiguous(df: DataFrame, label_col: str = "is_paraphrase") -> DataFrame:
    """Keep rows whose label is not 2."""
    return df.filter(F.col(label_col) != 2)


def numeric_projection(df: DataFrame) -> DataFrame:
    """Keep the numeric columns only (schema-driven)."""
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)])


def missing_flags(tokens_1: Column, tokens_2: Column) -> list[Column]:
    """1 when a side has no token (the reference compared a list with '')."""
    return [(F.size(tokens_1) == 0).cast("int").alias("missing_1"),
            (F.size(tokens_2) == 0).cast("int").alias("missing_2")]


def join_gold(pairs: DataFrame, gold: DataFrame, key=PAIR) -> DataFrame:
    """Equi-join of pairs and gold labels on the pair key (both sides keyed and
    partitioned on it; AQE turns it into a broadcast when a side is small)."""
    return pairs.join(gold, list(key), "inner")

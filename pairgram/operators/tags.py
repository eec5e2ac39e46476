"""Tag operators (G1-G6): parse ``word/NER/POS/CHUNK/EVENT`` strings, tag lists,
and left/right tag context by window functions over token positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairgram.keys import PAIR
FIELDS = ("word", "ner", "pos", "chunk", "event")


def _tokens(tag_col: Column) -> Column:
    return F.filter(F.split(F.coalesce(tag_col, F.lit("")), " "), lambda t: t != "")


def parse_tags(tag_col: Column) -> Column:
    """G1: array of structs (word, ner, pos, chunk, event), lower-cased."""
    return F.transform(_tokens(tag_col), lambda t: F.struct(
        *[F.get(F.split(F.lower(t), "/"), i).alias(name) for i, name in enumerate(FIELDS)]))


def parse_field(tag_col: Column, index: int, drop_o: bool = False) -> Column:
    """One field of every token (lower-cased); ``drop_o`` removes ``o``."""
    values = F.transform(_tokens(tag_col), lambda t: F.get(F.split(F.lower(t), "/"), index))
    return F.filter(values, lambda v: v != "o") if drop_o else values


def tag_rows(tagged: DataFrame, tag_cols=("tags_1", "tags_2")) -> DataFrame:
    """``conv_id, turn, side, pos, word, ner, pos_tag, chunk, event``: one row per tagged token."""
    sides = F.array(*[F.struct(F.lit(i + 1).alias("side"), parse_tags(F.col(c)).alias("toks"))
                      for i, c in enumerate(tag_cols)])
    return (tagged.select(*PAIR, F.inline(sides))
            .select(*PAIR, "side", F.posexplode_outer("toks").alias("p0", "t"))
            .filter(F.col("p0").isNotNull())
            .select(*PAIR, "side", (F.col("p0") + 1).alias("pos"), "t.word", "t.ner",
                    F.col("t.pos").alias("pos_tag"), "t.chunk", "t.event"))


def tag_context(pairs: DataFrame, token_cols=("tok_1", "tok_2"), tag_cols=("tags_1", "tags_2")) -> DataFrame:
    """Each token with the POS tag of its left and right neighbour.

    ``token_cols`` hold token arrays, ``tag_cols`` tag strings of the same
    sentences. A side whose token and tag counts differ yields no rows (the
    reference returns an empty list then). ``phi`` marks the sentence edges.
    Rows come from the pair-partitioned input, so the window needs no exchange.
    """
    sides = F.array(*[
        F.struct(F.lit(i + 1).alias("side"), F.col(tc).alias("toks"),
                 parse_field(F.col(gc), 2).alias("tags"))
        for i, (tc, gc) in enumerate(zip(token_cols, tag_cols))])
    rows = (pairs.select(*PAIR, F.inline(sides))
            .filter(F.size("toks") == F.size("tags"))
            .select(*PAIR, "side", F.posexplode_outer(F.transform(
                "toks", lambda t, i: F.struct(t.alias("token"), F.get(F.col("tags"), i).alias("tag"))
            )).alias("p0", "z"))
            .filter(F.col("p0").isNotNull())
            .select(*PAIR, "side", (F.col("p0") + 1).alias("pos"),
                    F.col("z.token").alias("token"), F.col("z.tag").alias("tag")))
    w = Window.partitionBy(*PAIR, "side").orderBy("pos")
    return (rows.withColumn("left_tag", F.lag("tag", 1, "phi").over(w))
            .withColumn("right_tag", F.lead("tag", 1, "phi").over(w)))

"""Fixtures derived from the driver tables, identical in Spark and in the SQL oracle.

* ``conversation_pairs``: each turn paired with the next turn of the same
  conversation, whole texts.
* ``votes`` / ``gold``: a 0..5 vote from shared tokens, and the gold answer.
* ``tagged``: a rule tagger producing ``word/NER/POS/CHUNK/EVENT`` strings.
* ``hypernyms`` / ``lemmas``: a prefix-tree taxonomy over the corpus words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgram.keys import PAIR
from pairgram.functions.text import WORD_RE, clean_sentence
from pairgram.sources.tables import read_table

#: Bytes of text in a partition of pairs. A pair makes about 2.4 distinct grams a byte over all families, each about 100 bytes of a task's memory.
PAIR_BYTES = 256 << 10
# The short stop list written identically in both engines.
STOP_WORDS = ["the", "and", "of", "in", "to", "is", "der", "die", "und", "le", "la", "de", "el"]


def pair_partitions(conv: DataFrame) -> int:
    """Partitions of the pairs: as many as their text asks for. The bytes that leave the join say nothing about the grams made of them,
    so they are not left to the adaptive merging of small partitions."""
    size = conv.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(conv.sparkSession.sparkContext.defaultParallelism, -(-size // PAIR_BYTES))


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, trend_id, raw_1, raw_2, sent_1, sent_2`` from turns turn - 1 and turn.

    A pair is two turns of a conversation whose numbers follow each other; a gap in
    the numbers parts them. The pairing joins on ``(conv_id, turn)``, the first
    side shifted by one turn, so one very long conversation does not land in one
    task. The merge hint keeps the join's partitioning by that key, which is the
    pair key: every per-pair operator groups on it without a new exchange. Partitions hold a bounded
    amount of text (``pair_partitions``), so a task's grams do not grow with the table. Rows with a null key, which
    pair with none, are left out before.
    """
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"]).filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    n = pair_partitions(conv)
    first = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("raw_1")).repartition(n, *PAIR)
    second = conv.select("conv_id", "turn", F.col("text").alias("raw_2")).repartition(n, *PAIR)
    return (first.hint("merge").join(second, list(PAIR))
            .select(*PAIR, F.col("conv_id").alias("trend_id"), "raw_1", "raw_2",
                    clean_sentence("raw_1").alias("sent_1"), clean_sentence("raw_2").alias("sent_2")))


def lower_words(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(WORD_RE), 0)


def vote_expr() -> Column:
    """vote = least(5, distinct common lower-case words of the two sentences)."""
    common = F.size(F.array_intersect(lower_words("sent_1"), lower_words("sent_2")))
    return F.least(F.lit(5), common).cast("int")


def with_vote(pairs: DataFrame) -> DataFrame:
    """The pairs plus their vote: a row-local column, no join back to the pairs."""
    return pairs.withColumn("vote", vote_expr())


def votes(pairs: DataFrame) -> DataFrame:
    """``conv_id, turn, vote``."""
    return pairs.select(*PAIR, vote_expr().alias("vote"))


def judge_string(vote: Column) -> Column:
    """The training-file vote tuple, e.g. ``(3, 2)``."""
    return F.concat(F.lit("("), vote.cast("string"), F.lit(", "), (5 - vote).cast("string"), F.lit(")"))


def gold(votes_df: DataFrame) -> DataFrame:
    """``conv_id, turn, ans, prob``: prob = vote / 5; true for 4-5, ---- for 3, false below."""
    v = F.col("vote")
    return votes_df.select(
        *PAIR,
        F.when(v >= 4, "true").when(v == 3, "----").otherwise("false").alias("ans"),
        (v / 5.0).alias("prob"),
    )


def _tag_word(w: Column) -> Column:
    n = F.length(w)
    ner = F.when(n % 7 == 0, "B-person").when(n % 11 == 0, "B-geo-loc").otherwise("O")
    pos = (F.when(w.endswith("ing"), "VBG").when(w.endswith("ed"), "VBD")
           .when(w.endswith("tion"), "NN").when(n <= 3, "DT")
           .when(w != F.lower(w), "NNP").otherwise("JJ"))
    event = F.when(w.endswith("ed") | w.endswith("ing"), "B-EVENT").otherwise("O")
    return F.concat_ws("/", w, ner, pos, F.lit("B-NP"), event)


def tag_sentence(sent: Column) -> Column:
    words = F.filter(F.split(F.coalesce(sent, F.lit("")), " "), lambda w: w != "")
    return F.array_join(F.transform(words, _tag_word), " ")



def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lower-case words of all conversation turns."""
    conv = read_table(spark, sf_dir, "conversations", ["text"])
    return conv.select(F.explode_outer(lower_words("text")).alias("word")).filter("word IS NOT NULL").distinct()


def hypernyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``child, parent``: w:<word> -> p3:<3 chars> -> p2:<2> -> p1:<1> -> root."""
    words = corpus_words(spark, sf_dir)
    p3 = F.substring("word", 1, 3)
    levels = words.select(
        F.concat(F.lit("w:"), "word").alias("w"),
        F.concat(F.lit("p3:"), p3).alias("p3"),
        F.concat(F.lit("p2:"), F.substring(p3, 1, 2)).alias("p2"),
        F.concat(F.lit("p1:"), F.substring(p3, 1, 1)).alias("p1"),
    )
    edges = F.inline(F.array(
        F.struct(F.col("w").alias("child"), F.col("p3").alias("parent")),
        F.struct(F.col("p3").alias("child"), F.col("p2").alias("parent")),
        F.struct(F.col("p2").alias("child"), F.col("p1").alias("parent")),
        F.struct(F.col("p1").alias("child"), F.lit("root").alias("parent")),
    ))
    return levels.select(edges).distinct()


def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word, synset, rank``: sense w:<word> (rank 1) and p3:<prefix> (rank 2)."""
    words = corpus_words(spark, sf_dir)
    senses = F.inline(F.array(
        F.struct(F.concat(F.lit("w:"), "word").alias("synset"), F.lit(1).alias("rank")),
        F.struct(F.concat(F.lit("p3:"), F.substring("word", 1, 3)).alias("synset"), F.lit(2).alias("rank")),
    ))
    return words.select("word", senses)


"""Lexical-network similarity (W1-W9): corpus statistics and taxonomy distances.

The taxonomy arrives as tables ``hypernyms(child, parent)`` and
``lemmas(word, synset, rank)``. Everything is computed on the *distinct*
word pairs given, never on vocabulary squared; the hot root of a taxonomy
never becomes a join key on its own (shared ancestors are matched together with
the second synset).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgram.functions import text as tx
from pairgram.functions.safe import r6
from pairgram.joins import hot_keys, join_hot, join_unique
from pairgram.session import checkpointed, stored

# The published parameters of the similarity measure.
ALPHA = 0.2
BETA = 0.45
ETA = 0.4
PHI = 0.2
DELTA = 0.85


# ------------------------------------------------------------ corpus ----

def corpus_freq(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n`` over lower-cased word-punct tokens (map-side combined)."""
    return (docs.select(F.explode_outer(tx.word_punct_tokens(F.col(text_col), lower=True)).alias("word"))
            .filter(F.col("word").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def corpus_total(freq: DataFrame) -> int:
    """N: one number."""
    return int(freq.agg(F.sum("n")).first()[0] or 0)


def information_content(words: DataFrame, freq: DataFrame, total: int, word_col: str = "word") -> DataFrame:
    """1 - ln(n + 1) / ln(N + 1); an unseen word has n = 0."""
    joined = words.select(F.col(word_col).alias("word")).join(freq, "word", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    ic = F.lit(1.0) - F.log(n + 1) / F.log(F.lit(total + 1).cast("double"))
    return joined.select("word", ic.alias("ic"))


# ---------------------------------------------------------- taxonomy ----

def hypernym_closure(edges: DataFrame) -> DataFrame:
    """``node, ancestor, dist`` including (node, node, 0), minimum distance.

    Breadth-first: the frontier of distance d joins the edges once and keeps
    only (node, ancestor) pairs not reached before (an anti-join), so each pair
    is produced at its shortest distance and the loop ends when a round finds
    nothing new, cycles or not. Each round writes its new pairs only; the closure
    is the union of those parts. The rows of an ancestor that very many nodes have are
    divided (``join_hot``).
    """
    edges = checkpointed(edges.select("child", "parent").distinct())
    up = edges.select(F.col("child").alias("ancestor"), "parent")
    nodes = edges.select(F.col("child").alias("node")).union(edges.select(F.col("parent").alias("node"))).distinct()
    closure = checkpointed(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("dist")))
    frontier, depth = closure, 0
    while True:
        depth += 1
        hot = hot_keys(frontier, "ancestor") if depth > 1 else None
        step = join_hot(frontier.select("node", "ancestor"), up, "ancestor", hot).select("node", F.col("parent").alias("ancestor")).distinct()
        new = checkpointed(step.join(closure, ["node", "ancestor"], "left_anti").select(
            "node", "ancestor", F.lit(depth).alias("dist")))
        if new.isEmpty():
            break
        closure = closure.unionByName(new)
        frontier = new
    return closure


def sense_pairs(word_pairs: DataFrame, lemmas: DataFrame) -> DataFrame:
    """``word_1, word_2, s1, r1, s2, r2`` for every sense pair of each word pair."""
    l1 = lemmas.select(F.col("word").alias("word_1"), F.col("synset").alias("s1"), F.col("rank").alias("r1"))
    l2 = lemmas.select(F.col("word").alias("word_2"), F.col("synset").alias("s2"), F.col("rank").alias("r2"))
    return word_pairs.join(l1, "word_1").join(l2, "word_2")


def synset_path(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """W4/W5 (+ the depth term of W8): ``s1, s2, path, h, path_similarity``.

    path = min over shared ancestors of d1 + d2; h = max over shared ancestors
    of max(d1, d2). The second join matches (synset, ancestor) together, so a
    root shared by everything is not a hot key; the pairs of a first synset that is
    in very many of them are divided (``join_hot``).
    """
    distinct = stored(pairs.select("s1", "s2").distinct(), "synset_pairs")
    c1 = closure.select(F.col("node").alias("s1"), F.col("ancestor").alias("a"), F.col("dist").alias("d1"))
    c2 = closure.select(F.col("node").alias("s2"), F.col("ancestor").alias("a"), F.col("dist").alias("d2"))
    shared = join_hot(distinct, c1, "s1", hot_keys(distinct, "s1")).join(c2, ["s2", "a"])
    return (shared.groupBy("s1", "s2").agg(
        F.min(F.col("d1") + F.col("d2")).alias("path"),
        F.max(F.greatest("d1", "d2")).alias("h"))
        .withColumn("path_similarity", 1.0 / (1.0 + F.col("path"))))


def packed_senses(lemmas: DataFrame, closure: DataFrame) -> DataFrame:
    """``word, senses``: one row per word; a sense is its rank, its synset and the synset's ancestors with their distances.
    Synsets that the closure lacks are connected to none and left out."""
    up = closure.groupBy(F.col("node").alias("synset")).agg(F.collect_list(F.struct(F.col("ancestor").alias("a"), F.col("dist").alias("d"))).alias("up"))
    return lemmas.join(up, "synset").groupBy("word").agg(F.collect_list(F.struct("rank", "synset", "up")).alias("senses"))


def _best_of(senses_1: Column, senses_2: Column) -> Column:
    """The least (path, r1, r2, s1, s2, h) of the connected sense pairs of two words; null if there is none."""
    def met(x, y):
        shared = F.flatten(F.transform(x["up"], lambda u: F.transform(
            F.filter(y["up"], lambda v: v["a"] == u["a"]),
            lambda v: F.struct((u["d"] + v["d"]).alias("path"), F.greatest(u["d"], v["d"]).alias("h")))))
        # one element, so that the shared ancestors are found once and not by each of their users
        return F.transform(F.array(shared), lambda z: F.when(F.size(z) > 0, F.struct(
            F.array_min(z["path"]).alias("path"), x["rank"].alias("r1"), y["rank"].alias("r2"), x["synset"].alias("s1"), y["synset"].alias("s2"),
            F.array_max(z["h"]).alias("h"))))

    return F.array_min(F.flatten(F.flatten(F.transform(senses_1, lambda x: F.transform(senses_2, lambda y: met(x, y))))))


def best_synset_pair(word_pairs: DataFrame, lemmas: DataFrame, closure: DataFrame) -> DataFrame:
    """Per word pair the sense pair with the highest path similarity;
    ties go to the first pair in sense order (rank of word_1, then word_2).
    Word pairs without any connected sense pair have nulls.

    A word's senses and their ancestors are one row, so that a word pair meets them by two joins on a word and finds its best
    sense pair in its own row: neither sense pairs nor their shared ancestors are rows to be exchanged or sorted.
    """
    pairs = stored(word_pairs.select("word_1", "word_2").distinct(), "word_pairs")
    packed = stored(packed_senses(lemmas, closure), "packed_senses")
    rows = pairs.count()
    for k in (1, 2):
        counts = stored(pairs.groupBy(f"word_{k}").agg(F.count(F.lit(1)).alias("_n")), "words")
        own = packed.select(F.col("word").alias(f"word_{k}"), F.col("senses").alias(f"senses_{k}"))
        found = join_unique(pairs if k == 1 else found, own, [f"word_{k}"], "left", counts=counts, rows=rows)
    best = found.select("word_1", "word_2", _best_of(F.col("senses_1"), F.col("senses_2")).alias("m"))
    return best.select("word_1", "word_2", "m.s1", "m.s2", "m.path", "m.h", (1.0 / (1.0 + F.col("m.path"))).alias("path_similarity"))


def lemma_overlap(lemmas: DataFrame) -> DataFrame:
    """Synset pairs sharing a lemma word: self-join of lemmas on the word (bounded
    by senses per word squared), so no synset with many lemmas fans out."""
    a = lemmas.select("word", F.col("synset").alias("s1"))
    b = lemmas.select("word", F.col("synset").alias("s2"))
    return a.join(b, "word").select("s1", "s2").distinct()


def word_similarity(word_pairs: DataFrame, lemmas: DataFrame, closure: DataFrame) -> DataFrame:
    """``word_1, word_2, length_factor, depth_factor, similarity``.

    l = 0 for the same synset, 1 when the synsets share a lemma, else the path;
    length = exp(-alpha l), depth = tanh(beta h), similarity = product. A word
    pair with no connected sense pair gets 0.
    """
    best = best_synset_pair(word_pairs, lemmas, closure)
    overlap = lemma_overlap(lemmas).withColumn("_ov", F.lit(True))
    flagged = best.join(overlap, ["s1", "s2"], "left")
    l = (F.when(F.col("s1") == F.col("s2"), F.lit(0.0))
         .when(F.col("_ov"), F.lit(1.0)).otherwise(F.col("path").cast("double")))
    lf = F.coalesce(F.exp(-ALPHA * l), F.lit(0.0))
    dfc = F.coalesce(F.tanh(BETA * F.col("h")), F.lit(0.0))
    return flagged.select("word_1", "word_2", r6(lf).alias("length_factor"), r6(dfc).alias("depth_factor"),
                      r6(lf * dfc).alias("similarity"))


def adjacent_word_pairs(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``word_1, word_2``: distinct pairs of neighbouring lower-case words."""
    words = texts.select(
        F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(tx.WORD_RE), 0).alias("w"))
    w = F.col("w")
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1),
                        lambda i: F.struct(F.get(w, i - 1).alias("word_1"), F.get(w, i).alias("word_2")))
    return (words.select(F.explode_outer(F.when(F.size(w) > 1, pairs)).alias("p"))
            .filter(F.col("p").isNotNull()).select("p.word_1", "p.word_2").distinct())

"""Sentence similarity over a taxonomy.

The joint words of a pair are one table ``conv_id, turn, word, at_1, at_2, idx``. A joint word that a
side lacks asks for that side's most similar word (W10), the argmax of the word
similarity W9, and only that: no word is paired with every word of the other side.

Ask by ancestor. A word has one row per ancestor of its senses, with the least distance d and the
``reach`` (largest distance to any ancestor) of the sense that has it. If the senses that
W6 chooses for two words meet at an ancestor, they are the senses of those rows, so W9 is at most
exp(-alpha (d1 + d2)) tanh(beta max(reach)) for one of the shared ancestors (synsets that share a lemma
meet, at length 1, at one more row). A side's words under an ancestor fall into groups of equal (d, reach), within
which this bound is the same for a given asking word.

Exact answers from bounds. The best group's first word is verified by W9 itself; then groups whose bound is
above the verified best (or equal, with a word of smaller spelling) are verified, in ranges of rank that double,
until none is left. In a tree the bound is met by the first word. Ties go to the smaller word. All sizes are those of words times ancestors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from pairgram.functions.safe import r6, safe_div
from pairgram.joins import join_unique
from pairgram.keys import PAIR
from pairgram.operators import lexnet as W
from pairgram.session import stored
from pairgram.sources.fixtures import lower_words

ASK = [*PAIR, "side", "word"]


def joint_words(pairs: DataFrame) -> DataFrame:
    """``conv_id, turn, word, at_1, at_2, idx``: distinct words of both sides, their first places, and the
    1-based rank of the first occurrence in side 1, then side 2."""
    sides = F.array(*[F.struct(F.lit(k).alias("side"), lower_words(f"sent_{k}").alias("w")) for k in (1, 2)])
    words = pairs.select(*PAIR, F.inline(sides)).select(*PAIR, "side", F.posexplode_outer("w").alias("p", "word")).filter("word IS NOT NULL")
    at = lambda k: F.min(F.when(F.col("side") == k, F.col("p"))).alias(f"at_{k}")
    joint = words.groupBy(*PAIR, "word").agg(at(1), at(2))
    order = Window.partitionBy(*PAIR).orderBy(F.col("at_1").asc_nulls_last(), "at_2")
    return joint.withColumn("idx", F.row_number().over(order))


def sense_rows(lemmas: DataFrame, closure: DataFrame) -> DataFrame:
    """``word, a, d, reach``: each ancestor of a word's senses, and the meeting points of synsets that share a lemma."""
    reach = closure.groupBy(F.col("node").alias("synset")).agg(F.max("dist").alias("reach"))
    senses = stored(lemmas.select("word", "synset", "rank").join(reach, "synset"), "senses")
    up = senses.join(closure.select(F.col("node").alias("synset"), F.col("ancestor").alias("a"), F.col("dist").alias("d")), "synset")
    own = up.groupBy("word", "a").agg(F.min(F.struct("d", "rank", "synset", "reach")).alias("m")).select("word", "a", "m.d", "m.reach")
    # an edge of two synsets with a shared lemma is expanded from its end with fewer edges only
    edges = W.lemma_overlap(lemmas).filter("s1 != s2")
    degree = stored(edges.groupBy("s1").agg(F.count(F.lit(1)).alias("n")), "degree")
    ends = edges.join(degree, "s1").join(degree.select(F.col("s1").alias("s2"), F.col("n").alias("n2")), "s2")
    ends = ends.filter((F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("s1") < F.col("s2"))))
    low = senses.join(ends.select(F.col("s1").alias("synset"), "s2"), "synset").select("word", F.col("s2").alias("hub"), F.lit(1).alias("d"), "reach")
    hubs = ends.select(F.col("s2").alias("synset")).distinct()
    high = senses.join(hubs, "synset").select("word", F.col("synset").alias("hub"), F.lit(0).alias("d"), "reach")
    shared = low.unionByName(high).groupBy("word", "hub", "d").agg(F.max("reach").alias("reach"))
    return own.unionByName(shared.select("word", F.concat(F.lit("lemma "), "hub").alias("a"), "d", "reach"))


def _bound(d1: Column, d2: Column, reach1: Column, reach2: Column) -> Column:
    return r6(F.exp(-W.ALPHA * (d1 + d2).cast("double")) * F.tanh(W.BETA * F.greatest(reach1, reach2).cast("double")))


#: Joint words in a partition of pairs. A joint word makes a row per side and ancestor of its senses.
PART_WORDS = 50_000
#: Largest distance and reach that a packed row holds: beyond it exp(-ALPHA d) rounds to 0 and tanh(BETA reach) is 1, so no bound changes.
FAR = 255


def _pair_partitions(joint: DataFrame, rows: int) -> int:
    return max(joint.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_WORDS))


def packed_rows(rows: DataFrame) -> DataFrame:
    """``word, rows``: the sense rows of a word as one array of numbers, 48 bits of the ancestor's hash, 8 of d and 8 of the reach: a single row
    per word to join, however often the word occurs, and a fifth of the bytes of structs where it is brought to the pairs."""
    far = lambda c: F.least(F.col(c), F.lit(FAR)).cast("long")
    code = F.shiftleft(F.xxhash64("a"), 16).bitwiseOR(F.shiftleft(far("d"), 8)).bitwiseOR(far("reach"))
    return rows.groupBy("word").agg(F.collect_list(code).alias("rows"))


def _unpacked(rows: DataFrame, *names: str) -> DataFrame:
    """The columns ``names`` and ``a, d, reach`` of rows that have a number ``code``; nulls for a null."""
    code = F.col("code")
    low = lambda by: F.shiftright(code, by).bitwiseAND(F.lit(FAR)).cast("int")
    return rows.select(*names, F.shiftright(code, 16).alias("a"), low(8).alias("d"), low(0).alias("reach"))


#: Bounds of a group for an asking group that are looked at once.
BOUNDS = 1 << 20


def _bounds(spark) -> np.ndarray:
    """Spark's own ``_bound`` by d1 + d2 and the larger reach."""
    at = [(F.col("id") / (FAR + 1)).cast("int"), (F.col("id") % (FAR + 1)).cast("int")]
    zero = F.lit(0)
    table = spark.range((2 * FAR + 1) * (FAR + 1)).select("id", _bound(at[0], zero, at[1], zero).alias("b")).toArrow()
    out = np.empty(table.num_rows)
    out[table["id"].to_numpy()] = table["b"].to_numpy()
    return out.reshape(2 * FAR + 1, FAR + 1)


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each start, ``count`` numbers each."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _best_groups(bounds: np.ndarray, code: np.ndarray, group: np.ndarray, head: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best bound and its word (least of equal ones) of each group that asks, among the groups under its ancestor that have a head.

    A group is one (pair, ancestor, d, reach); ``group`` numbers its pair and ancestor, ascending; ``head`` is -1 without a word. Others get -1.
    """
    best, word = np.full(len(code), -1.0), np.full(len(code), -1, np.int64)
    heads, askers = np.flatnonzero(head >= 0), np.flatnonzero(asks)
    low, high = (np.searchsorted(group[heads], group[askers], side) for side in ("left", "right"))
    some = high > low
    askers, low, n = askers[some], low[some], (high - low)[some]
    d, reach = (code >> 8) & FAR, code & FAR
    ends = np.searchsorted(np.cumsum(n), np.arange(BOUNDS, n.sum() + BOUNDS, BOUNDS), "right") if len(n) else []
    for lo, hi in zip([0, *ends], [*ends, len(n)]):
        if lo == hi:
            continue
        m = n[lo:hi]
        other, own = heads[_spans(low[lo:hi], m)], np.repeat(askers[lo:hi], m)
        b = bounds[d[own] + d[other], np.maximum(reach[own], reach[other])]
        first = np.cumsum(m) - m
        top = np.maximum.reduceat(b, first)
        best[askers[lo:hi]] = top
        word[askers[lo:hi]] = np.minimum.reduceat(np.where(b == np.repeat(top, m), head[other], np.iinfo(np.int64).max), first)
    return best, word


def _lead_rows(bounds: np.ndarray, schema: pa.Schema):
    """Makes a partition of ``conv_id, turn, word, has_1, has_2, rows``, whole pairs, the rows of ``_leads``."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        conv, turn = (table[c].to_numpy() for c in PAIR)
        at = np.lexsort((turn, conv))
        table = table.take(pa.array(at))
        conv, turn = conv[at], turn[at]
        pair = np.cumsum(np.r_[0, (conv[1:] != conv[:-1]) | (turn[1:] != turn[:-1])])
        # words as their rank by spelling (by bytes, as Spark compares them)
        words = pc.dictionary_encode(table["word"].combine_chunks())
        spelling = pc.sort_indices(words.dictionary).to_numpy()
        rank = np.argsort(spelling)[words.indices.to_numpy()].astype(np.int64)
        by_rank = words.dictionary.take(pa.array(spelling))
        lists = table["rows"].combine_chunks()
        n_rows = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = pc.list_flatten(lists).to_numpy()
        word = np.repeat(np.arange(len(rank)), n_rows)
        order = np.lexsort((codes, pair[word]))
        code, of, place = codes[order], word[order], pair[word][order]
        new = np.r_[True, (place[1:] != place[:-1]) | (code[1:] != code[:-1])][:len(code)]
        start, mine = np.flatnonzero(new), np.cumsum(new) - 1
        under = place[start], code[start] >> 16
        group = np.cumsum(np.r_[0, (under[0][1:] != under[0][:-1]) | (under[1][1:] != under[1][:-1])])[:len(start)]
        pairs = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        filled = np.flatnonzero(n_rows)
        none = np.iinfo(np.int64).max
        for side in (1, 2):
            has = table[f"has_{side}"].combine_chunks().to_numpy(zero_copy_only=False)
            first = np.minimum.reduceat(np.where(has, rank, none), pairs)[pair]
            bound, v = np.full(len(rank), -1.0), np.full(len(rank), -1, np.int64)
            if len(code):
                head = np.minimum.reduceat(np.where(has[of], rank[of], none), start)
                best, best_word = _best_groups(bounds, code[start], group, np.where(head == none, -1, head), np.logical_or.reduceat(~has[of], start))
                # back to the words' own order, in which a word's rows are together
                each, each_word = np.empty(len(code)), np.empty(len(code), np.int64)
                each[order], each_word[order] = best[mine], best_word[mine]
                begin = (np.cumsum(n_rows) - n_rows)[filled]
                top = np.maximum.reduceat(each, begin)
                bound[filled] = top
                v[filled] = np.minimum.reduceat(np.where(each == np.repeat(top, n_rows[filled]), each_word, none), begin)
            asks = np.flatnonzero(~has)
            first, v, bound = first[asks], v[asks], bound[asks]
            spelled = lambda r, missing: by_rank.take(pa.array(np.where(missing, 0, r), mask=missing))
            yield pa.RecordBatch.from_arrays([*[table[c].combine_chunks().take(pa.array(asks)).cast(schema.field(c).type) for c in PAIR],
                                              pa.array(np.full(len(asks), side, np.int32)), table["word"].combine_chunks().take(pa.array(asks)),
                                              spelled(first, first == none), spelled(v, v < 0), pa.array(bound, mask=v < 0)], schema=schema)
    return make


def _leads(joint: DataFrame, packed: DataFrame) -> DataFrame:
    """``conv_id, turn, side, word, first, v, bound`` of every joint word that a side lacks: the first word of the group with the best bound
    (null if none meets), and the side's first word by spelling.

    A joint word meets its sense rows as one row, which is brought to its pair; a partition of pairs finds its groups and bounds by sorting
    numbers, so that no row of a word and an ancestor is made, exchanged or written.
    """
    words = joint.select(*PAIR, "word", "at_1", "at_2")
    n = words.count()
    met = join_unique(words, packed, ["word"], "left", rows=n).repartition(_pair_partitions(joint, n), *PAIR)
    types = {f.name: f.dataType for f in words.schema.fields}
    out = StructType([*[StructField(c, types[c]) for c in PAIR], StructField("side", IntegerType()), StructField("word", StringType()),
                      StructField("first", StringType()), StructField("v", StringType()), StructField("bound", DoubleType())])
    schema = pa.schema([*[(c, pa.int64() if isinstance(types[c], LongType) else pa.int32()) for c in PAIR], ("side", pa.int32()), ("word", pa.string()),
                        ("first", pa.string()), ("v", pa.string()), ("bound", pa.float64())])
    rows = met.select(*PAIR, "word", *[F.col(f"at_{k}").isNotNull().alias(f"has_{k}") for k in (1, 2)], "rows")
    return rows.mapInArrow(_lead_rows(_bounds(joint.sparkSession), schema), out)


def most_similar_word(joint: DataFrame, lemmas: DataFrame, closure: DataFrame) -> DataFrame:
    """``conv_id, turn, side, word, sim_word, similarity`` of every joint word that a side lacks.

    A side without words gives '' and -1; a word similar to none gives the side's first word by spelling and 0.
    Where W9 of the lead reaches its bound, no other word can win; only the other askers are searched on (``_searched``).
    """
    # an ancestor is known by its hash: two of one hash would only loosen a bound, and what a bound proposes is verified
    packed = stored(packed_rows(sense_rows(lemmas, closure)), "packed")
    leads = stored(_leads(joint, packed), "leads")
    led, none = leads.filter("v IS NOT NULL"), leads.filter("v IS NULL")
    pairs = stored(led.groupBy("word", "v").agg(F.count(F.lit(1)).alias("_n")), "pairs")
    known = stored(_known(pairs.select("word", "v"), lemmas, closure), "known")
    met = join_unique(led, known, ["word", "v"], counts=pairs, rows=led.count())
    like = F.col("similarity") > 0
    best = met.select(*ASK, F.when(like, F.col("v")).otherwise(F.col("first")).alias("sim_word"), F.when(like, F.col("similarity")).otherwise(0.0).alias("similarity"),
                      (F.col("similarity") < F.col("bound")).alias("open"))
    best = stored(best.unionByName(none.select(
        *ASK, F.coalesce("first", F.lit("")).alias("sim_word"), F.when(F.col("first").isNull(), F.lit(-1.0)).otherwise(F.lit(0.0)).alias("similarity"),
        F.lit(False).alias("open"))), "best")
    contested = best.filter("open").drop("open")
    if contested.isEmpty():
        return best.drop("open")
    return best.filter("NOT open").drop("open").unionByName(_searched(joint, packed, contested, lemmas, closure))


def _known(pairs: DataFrame, lemmas: DataFrame, closure: DataFrame) -> DataFrame:
    """``word, v, similarity``: W9 of distinct pairs ``word, v``."""
    asked = pairs.select(F.col("word").alias("word_1"), F.col("v").alias("word_2"))
    return W.word_similarity(asked, lemmas, closure).select(F.col("word_1").alias("word"), F.col("word_2").alias("v"), "similarity")


def _searched(joint: DataFrame, packed: DataFrame, best: DataFrame, lemmas: DataFrame, closure: DataFrame) -> DataFrame:
    """``best`` (one row per asker) improved until no group's bound is above it."""
    sides = best.select(*PAIR, "side").distinct()
    has = F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"at_{k}").isNotNull().alias("has")) for k in (1, 2)])
    each = joint.select(*PAIR, "word", F.inline(has)).join(sides, [*PAIR, "side"], "left_semi")
    each = stored(each.filter("has").unionByName(best.select(*PAIR, "word", "side", F.lit(False).alias("has"))), "each")
    under = stored(_unpacked(join_unique(each, packed, ["word"]).select(*ASK, "has", F.explode("rows").alias("code")), *ASK, "has"), "under")
    asked = under.filter(~F.col("has")).drop("has").withColumnsRenamed({"d": "d1", "reach": "reach1"})
    members = stored(under.filter("has").select(*PAIR, "side", "a", "d", "reach", F.col("word").alias("v")).withColumn(
        "rank", F.row_number().over(Window.partitionBy(*PAIR, "side", "a", "d", "reach").orderBy("v"))), "members")
    group = [*PAIR, "side", "a"]
    bound = _bound(F.col("d1"), F.col("d"), F.col("reach1"), F.col("reach")).alias("bound")

    def verified(candidates: DataFrame) -> DataFrame:
        """``ask, v, similarity`` of distinct candidates, W9 on the distinct word pairs."""
        candidates = stored(candidates.select(*ASK, "v").distinct(), "candidates")
        return join_unique(candidates, stored(_known(candidates.select("word", "v").distinct(), lemmas, closure), "known"), ["word", "v"])

    def better(best: DataFrame, new: DataFrame) -> DataFrame:
        both = best.unionByName(new.select(*ASK, F.col("v").alias("sim_word"), "similarity"))
        top = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("sim_word").alias("v"))).alias("m")
        return stored(both.groupBy(*ASK).agg(top).select(*ASK, F.col("m.v").alias("sim_word"), (-F.col("m.s")).alias("similarity")), "best")

    low = 1
    while True:
        can_win = (F.col("bound") > F.col("similarity")) | ((F.col("bound") == F.col("similarity")) & (F.col("v") < F.col("sim_word")))
        ahead = asked.join(members.filter(F.col("rank") == low).drop("rank"), group).select(*asked.columns, "d", "reach", "v", bound)
        ahead = stored(ahead.join(best, ASK).filter(can_win).select(*asked.columns, "d", "reach", "similarity", "sim_word", "bound"), "ahead")
        if ahead.isEmpty():
            return best
        more = members.filter(F.col("rank").between(low, 2 * low - 1)).drop("rank")
        best = better(best, verified(ahead.join(more, [*group, "d", "reach"]).filter(can_win)))
        low *= 2


def _aligned(joint: DataFrame, similar: DataFrame, ic: DataFrame | None = None) -> DataFrame:
    """One row per joint word, ``conv_id, turn, word, at_1, at_2, idx, sim_word, similarity, sim_idx`` and with ``ic`` (``word, ic`` for every
    joint word) ``ic, sim_ic``. It lacks one side at most, and has an answer there: a joint word of the same pair, or '' for an empty side.

    Words and answers are brought to their pair together, once; both lookups and all that is grouped by the pair stay in that partition. Each
    kind goes as one struct, so that plans that need some of its fields only share the exchange.
    """
    n = joint.count()
    looked_up = ["idx"] if ic is None else ["idx", "ic"]
    words = joint if ic is None else join_unique(joint, stored(ic, "ic"), ["word"], rows=n)
    own = words.select(*PAIR, "word", F.struct("at_1", "at_2", *looked_up).alias("own"))
    answers = similar.select(*PAIR, "word", F.struct("sim_word", "similarity").alias("answer"))
    rows = own.unionByName(answers, allowMissingColumns=True).repartition(_pair_partitions(joint, n), *PAIR)
    rows = rows.groupBy(*PAIR, "word").agg(F.max("own").alias("own"), F.max("answer").alias("answer"))
    # a row is known under its word and, if it has an answer, asks under its similar word
    sim = F.col("answer.sim_word")
    keys = F.filter(F.array(F.struct(F.col("word").alias("key"), F.lit(False).alias("asks")), F.struct(sim.alias("key"), F.lit(True).alias("asks"))),
                    lambda k: k["key"].isNotNull())
    found = [F.max(F.when(~F.col("asks"), F.col(f"own.{c}"))).over(Window.partitionBy(*PAIR, "key")).alias(f"sim_{c}") for c in looked_up]
    rows = rows.select(*PAIR, "word", "own", "answer", F.inline(keys)).select(*PAIR, "word", "own", "answer", "asks", *found)
    return rows.filter(F.col("asks") | F.col("answer.sim_word").isNull()).select(*PAIR, "word", "own.*", "answer.*", *[f"sim_{c}" for c in looked_up])


def _both_sides(*values: tuple[str, Column, Column]) -> Column:
    """Rows ``side, <name>...`` of a joint word: of a value's two columns the first holds where the side has the word."""
    return F.inline(F.array(*[F.struct(F.lit(k).alias("side"), *[F.when(F.col(f"at_{k}").isNotNull(), own).otherwise(other).alias(name) for name, own, other in values])
                              for k in (1, 2)]))


def semantic_vector(joint: DataFrame, similar: DataFrame, ic: DataFrame, aligned: DataFrame | None = None) -> DataFrame:
    """``conv_id, turn, side, word, value, value_ic``; ic has ``word, ic`` for every joint word; ``aligned`` if made of them before.

    1 for a word of the side, PHI for one whose most similar word is above PHI, else 0; value_ic is
    times the information content of the word and of the word that stands for it.
    """
    rows = _aligned(joint, similar, ic) if aligned is None else aligned
    other = F.when(F.col("similarity") > W.PHI, F.lit(W.PHI)).otherwise(0.0)
    weight = F.col("ic") * F.coalesce("sim_ic", F.lit(0.0))  # the empty side's '' stands for nothing, and its value is 0
    return rows.select(*PAIR, "word", _both_sides(("value", F.lit(1.0), other), ("value_ic", F.col("ic") * F.col("ic"), other * weight))).select(*ASK, "value", "value_ic")


def word_order_vector(joint: DataFrame, similar: DataFrame, aligned: DataFrame | None = None) -> DataFrame:
    """``conv_id, turn, side, word, value``: the word's index, or that of its most similar word above ETA, or 0."""
    other = F.coalesce(F.when(F.col("similarity") > W.ETA, F.col("sim_idx")), F.lit(0))
    rows = _aligned(joint, similar) if aligned is None else aligned
    return rows.select(*PAIR, "word", _both_sides(("value", F.col("idx"), other))).select(*ASK, F.col("value").cast("int").alias("value"))


def _facing(vectors: DataFrame, *values: str) -> DataFrame:
    """One row per joint word with both sides' values: ``<value>_1, <value>_2``."""
    pick = [F.max(F.when(F.col("side") == k, F.col(v))).alias(f"{v}_{k}") for v in values for k in (1, 2)]
    return vectors.groupBy(*PAIR, "word").agg(*pick)


def semantic_similarity(vectors: DataFrame) -> DataFrame:
    """``conv_id, turn, semantic, semantic_ic``: cosine of the two W11 vectors, 0 if one of them is zero."""
    def cosine(v):
        a, b = F.col(f"{v}_1"), F.col(f"{v}_2")
        return safe_div(F.sum(a * b), F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b)))

    return _facing(vectors, "value", "value_ic").groupBy(*PAIR).agg(
        cosine("value").alias("semantic"), cosine("value_ic").alias("semantic_ic"))


def word_order_similarity(vectors: DataFrame) -> DataFrame:
    """``conv_id, turn, word_order``: 1 - |r1 - r2| / |r1 + r2|, 1 if both are zero."""
    a, b = F.col("value_1").cast("double"), F.col("value_2").cast("double")
    return _facing(vectors, "value").groupBy(*PAIR).agg(
        (1.0 - safe_div(F.sqrt(F.sum((a - b) * (a - b))), F.sqrt(F.sum((a + b) * (a + b))))).alias("word_order"))


def sentence_similarity(pairs: DataFrame, lemmas: DataFrame, closure: DataFrame, freq: DataFrame, total: int) -> DataFrame:
    """``conv_id, turn, semantic, semantic_ic, word_order, similarity, similarity_ic``, one row per pair.

    The joint words are made and searched once for all of it. Pairs without words have no vectors: 0 and 1, as for zero vectors.
    """
    joint = stored(joint_words(pairs), "joint")
    similar = stored(most_similar_word(joint, lemmas, closure), "similar")
    words = stored(joint.select("word").distinct(), "words")
    ic = W.information_content(words, freq, total)
    rows = _aligned(joint, similar, ic)  # for both vectors, so that they share its exchange
    both = semantic_similarity(semantic_vector(joint, similar, ic, rows)).join(word_order_similarity(word_order_vector(joint, similar, rows)), list(PAIR))
    both = pairs.select(*PAIR).join(both, list(PAIR), "left")
    semantic, semantic_ic, order = F.coalesce("semantic", F.lit(0.0)), F.coalesce("semantic_ic", F.lit(0.0)), F.coalesce("word_order", F.lit(1.0))
    return both.select(*PAIR, semantic.alias("semantic"), semantic_ic.alias("semantic_ic"), order.alias("word_order"),
                       (W.DELTA * semantic + (1 - W.DELTA) * order).alias("similarity"),
                       (W.DELTA * semantic_ic + (1 - W.DELTA) * order).alias("similarity_ic"))

"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words. A document of a source is taken
``target / source size`` times: the whole part for certain, the fraction by a
dependent rounding that keeps the source's words exact up to one document.

The pivotal step takes two documents with fractional copies p and words w. It
moves words from one to the other, by a random draw that leaves both
expectations as they are, until one of them is taken wholly or not at all; the
other carries the rest. A block of at most about BLOCK documents of one source is
folded this way and leaves one residual document; the residuals of all blocks
are dealt into blocks again, level by level, until each source has one residual,
which a last draw decides. No level holds more than a block in one group.

Targets: sources in code point order (null last) weigh WEIGHTS in turn and share
100 % of all words; a target stops at CAP times its source's size, and the
excess goes to the others by weight until none is above (one small aggregate of
the source table per step).

Defined cases: null or empty texts have no words; they are taken as often as an
independent draw of the same expectation says. A source without words has target
0. Repeated rows are one entry with a multiplicity until the copies are
decided, so a row that makes up a third of the table is one entry. All draws are
hashes of the row and the seed: reruns agree. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairgram.llm.common import is_empty, keyed, repeated, saved, with_key, words_of
from pairgram.operators.encode import dense_codes

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 128
SEED = 17


def draw(*parts: Column | str, seed: int = SEED) -> Column:
    """A number in [0, 1) from the hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) * F.lit(2.0 ** -53)).cast("double")


def source_targets(sized: DataFrame) -> DataFrame:
    """``source, source_size, entries, target``, one row per source, from ``source, size, n``."""
    sizes = saved(sized.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum((F.col("size") > 0).cast("long")).alias("entries")), "sources")
    ranks = dense_codes(sizes, "source", "rank")
    named = sizes.filter("source IS NOT NULL").count()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]),
                          (F.coalesce("rank", F.lit(named)) % len(WEIGHTS) + 1).cast("int"))
    table = saved(sizes.join(ranks, "source", "left").select("source", "source_size", "entries", weight.alias("w")), "weights")
    limit = F.col("source_size") * float(CAP)
    rate = 0.0
    while True:
        full = limit < F.col("w") * rate
        total, held, free = table.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        new = (total - held) / free if free else rate
        if new <= rate:
            break
        rate = new
    return table.select("source", "source_size", "entries", F.least(limit, F.col("w") * rate).alias("target"))


def _fold(items: str, seed: int) -> str:
    """SQL that folds a sorted array of (id, w, p, u) into (done: array of (id, x), rest: (id, w, p)).

    a, b: the words that can move up to, or down from, the carried document.
    """
    return f"""
      aggregate({items},
        named_struct('done', cast(array() as array<struct<id:struct<k:bigint,d:bigint,s:bigint>,x:int>>),
                     'id', cast(null as struct<k:bigint,d:bigint,s:bigint>), 'w', 0D, 'p', 0D),
        (s, e) -> CASE
          WHEN s.id IS NULL THEN named_struct('done', s.done, 'id', e.id, 'w', e.w, 'p', e.p)
          ELSE aggregate(array(named_struct(
                 'a', least(s.w * (1 - s.p), e.w * e.p), 'b', least(s.w * s.p, e.w * (1 - e.p)))),
               s, (t, m) -> CASE
                 WHEN e.u * (m.a + m.b) < m.b THEN CASE
                   WHEN s.w * (1 - s.p) <= e.w * e.p THEN named_struct(
                     'done', concat(s.done, array(named_struct('id', s.id, 'x', 1))),
                     'id', e.id, 'w', e.w, 'p', (e.w * e.p - m.a) / e.w)
                   ELSE named_struct(
                     'done', concat(s.done, array(named_struct('id', e.id, 'x', 0))),
                     'id', s.id, 'w', s.w, 'p', (s.w * s.p + m.a) / s.w) END
                 ELSE CASE
                   WHEN s.w * s.p <= e.w * (1 - e.p) THEN named_struct(
                     'done', concat(s.done, array(named_struct('id', s.id, 'x', 0))),
                     'id', e.id, 'w', e.w, 'p', (e.w * e.p + m.b) / e.w)
                   ELSE named_struct(
                     'done', concat(s.done, array(named_struct('id', e.id, 'x', 1))),
                     'id', s.id, 'w', s.w, 'p', (s.w * s.p - m.b) / s.w) END END) END)"""


def pivotal(items: DataFrame, largest: int, seed: int = SEED) -> DataFrame:
    """Round ``g, entries, id, w, p`` (0 < p < 1, w > 0) to ``id, x`` with x 0 or 1.

    g is the group, entries how many items it may have, largest the most of any group.
    """
    rows = items.withColumn("_of", F.ceil(F.col("entries") / BLOCK)).select(
        "g", "id", "w", "p", F.expr("pmod(xxhash64(id, 1), _of)").alias("block"), "_of")
    done, level = [], 0
    while True:
        entry = F.struct(draw("id", F.lit(level), seed=seed).alias("u"), "id", "w", "p")
        folded = saved(rows.groupBy("g", "block").agg(F.array_sort(F.collect_list(entry)).alias("items"), F.max("_of").alias("_of"))
                       .select("g", "block", "_of", F.expr(_fold("items", seed)).alias("f")), "rounding")
        done.append(folded.select(F.inline("f.done")))
        rest = folded.select("g", "block", "_of", F.col("f.id").alias("id"), F.col("f.w").alias("w"), F.col("f.p").alias("p"))
        if largest <= BLOCK:
            last = rest.select("id", (draw("id", F.lit(-1), seed=seed) < F.col("p")).cast("int").alias("x"))
            return reduce(DataFrame.unionByName, [*done, last])
        largest = -(-largest // BLOCK)
        rows = rest.select("g", "id", "w", "p", F.expr(f"block div {BLOCK}").alias("block"),
                           F.expr(f"(_of + {BLOCK - 1}) div {BLOCK}").alias("_of"))
        level += 1


def decide(docs: DataFrame, seed: int = SEED) -> tuple[DataFrame, int]:
    """``_key, doc_id, size, source_size, target, n, copies, more``, one row per distinct row of docs, and the largest n.

    n equal rows; each is taken ``copies`` times, ``more`` of them once more.
    """
    sized = saved(keyed(docs, "doc_id", "source", "text").select("_key", "doc_id", "source", F.size(words_of()).cast("long").alias("size"))
                  .groupBy("_key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    targets = source_targets(sized)
    targets = saved(targets.select("source", "source_size", "target", "entries",
                                   F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("ratio"),
                                   F.xxhash64("source", F.col("source").isNull()).alias("g")), "targets")
    largest, most = targets.agg(F.max("entries")).first()[0] or 0, sized.agg(F.max("n")).first()[0] or 0
    rows = sized.join(targets, sized.source.eqNullSafe(targets.source)).drop("source")
    share = F.col("n") * (F.col("ratio") - F.floor("ratio"))
    rows = rows.select("*", F.floor("ratio").alias("copies"), F.floor(share).alias("whole"), (share - F.floor(share)).alias("p"),
                       F.struct(F.col("_key").alias("k"), F.col("doc_id").cast("long").alias("d"), F.col("size").alias("s")).alias("id"))
    open_ = rows.filter("size > 0 AND p > 0").select("g", "entries", "id", F.col("size").cast("double").alias("w"), "p")
    chosen = pivotal(open_, largest, seed).filter("x = 1").select(F.col("id").alias("_id"))
    out = rows.join(chosen, rows.id.eqNullSafe(F.col("_id")), "left")
    extra = F.when(F.col("size") == 0, (draw("id", seed=seed) < F.col("p")).cast("long")).otherwise(
        F.col("_id").isNotNull().cast("long"))
    return out.select("_key", "doc_id", "size", "source_size", "target", "n", "copies", (F.col("whole") + extra).alias("more")), most


def mix_plan(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, copies, taken`` (words taken, repeats counted)."""
    plan, most = decide(docs, seed)
    copies = F.col("copies") + (F.col("i") < F.col("more")).cast("long")
    return repeated(plan, "n", "i", most).select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed documents: the columns of docs, each row as often as the mix takes it."""
    plan, _ = decide(docs, seed)
    plan = saved(plan.select(F.col("_key").alias("_k"), F.col("doc_id").alias("_d"), "n",
                             (F.col("n") * F.col("copies") + F.col("more")).alias("_c")).filter("_c > 0"), "plan")
    most = plan.agg(F.max("_c")).first()[0] or 0
    rows = with_key(docs, "doc_id")

    def taken(plan):
        # the plan has a row per document: a merge join at every size, never a broadcast of it
        return rows.hint("merge").join(plan, (rows["_key"] == F.col("_k")) & rows.doc_id.eqNullSafe(F.col("_d"))).select("_row", "_key", "doc_id", "_c")

    out, many = taken(plan.filter("n = 1")), plan.filter("n > 1")
    if not is_empty(many):
        out = out.unionByName(taken(many).dropDuplicates(["_key", "doc_id"]))
    return repeated(out, "_c", "_i", most).select("_row.*")

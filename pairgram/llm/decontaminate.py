r"""Benchmark decontamination by a hash set of normalised test n-grams.

A text's words are the runs of ASCII letters, digits and non-ASCII characters,
after lower-casing A-Z. A window is WINDOW consecutive words of a benchmark item;
an item with fewer words, but not none, is one window.

The distinct windows, and all their grams of half a window, make two hash sets
that are broadcast if their measured bytes are within BROADCAST_BYTES; beyond it
the same joins shuffle. Half-window grams are looked up at every STEP-th word of
a document, STEP being their length: each window of the document holds one of
them whole, so none is missed and one position in STEP is hashed. A gram that is
found brings the words around it, and each window of those is looked up among
the benchmark's windows. Both joins are on the text itself, so a hit is verified
by equality and a hash collision is never a hit.

The texts are read once; only candidates leave the scan: a passage that a third
of the documents hold costs its hits, spread by document.

Defined cases: a very long text is one row of the scan, and only words around half-window hits leave it;
null and wordless texts have no words and no hits, and a wordless
item has no window; repeated items and windows count once; an item with a null
item_id marks words but is not listed. Repeated documents get equal results.
An empty benchmark leaves all documents clean. Extra columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgram.llm.common import keyed, saved, settled, with_key

WINDOW = 10
BROADCAST_BYTES = 32 << 20
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: str = "text") -> Column:
    """Normalised words. Only the first and the last part of the split can be empty."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR)
    return F.array_remove(parts, "")


def _grams(words: str, length: str, first: str = "1", step: str = "1") -> str:
    return (f"transform(sequence({first}, size({words}) - {length} + 1, {step}), "
            f"i -> array_join(slice({words}, i, {length}), ' '))")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``gram, len, items`` (distinct item_ids as strings): one row per distinct window."""
    items = settled(benchmark.select("item_id", "text"), w=tokens()).filter("size(w) > 0")
    items = items.select(F.col("item_id").cast("string").alias("item"), "w",
                         F.expr(f"least(size(w), {window})").alias("len"))
    grams = items.select("item", "len", F.explode(F.expr(_grams("w", "len"))).alias("gram"))
    return saved(grams.groupBy("gram", "len").agg(F.collect_set("item").alias("items")), "windows")


def step_of(length: int) -> int:
    """Words of the grams looked up for windows of this length: 2 * step - 1 <= length."""
    return (length + 1) // 2


def _bounded(df: DataFrame, size: int) -> DataFrame:
    """df for a join, broadcast if its measured bytes allow it."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_key, doc_id, n_hit, items, runs``: one row per distinct document with a hit; items are sorted as strings."""
    grams = benchmark_windows(benchmark, window)
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect())  # window values at most
    size = grams.agg(F.sum(F.length("gram") * 4 + 8 * F.size("items") + 64)).first()[0] or 0
    step = F.expr("(len + 1) div 2")
    halves = saved(grams.select("len", F.split("gram", " ").alias("w"), step.alias("step")).select(
        "len", F.explode(F.expr(_grams("w", "step"))).alias("half")).distinct(), "halves")
    half_size = halves.agg(F.sum(F.length("half") * 4 + 64)).first()[0] or 0
    words = settled(keyed(docs, "doc_id", "text"), w=tokens()).select("_key", "doc_id", "w")

    def looked_up(n: int) -> Column:
        g = step_of(n)
        row = (f"named_struct('len', {n}, 'half', array_join(slice(w, i, {g}), ' '), 'from', greatest(1, i - {n - g}), "
               f"'around', slice(w, greatest(1, i - {n - g}), i + {n} - greatest(1, i - {n - g})))")
        return F.expr(f"CASE WHEN size(w) >= {n} THEN transform(sequence(1, size(w) - {g - 1}, {g}), i -> {row}) ELSE array() END")

    empty = F.array().cast("array<struct<len:int,half:string,from:int,around:array<string>>>")
    scanned = words.select("_key", "doc_id", F.inline(F.concat(*[looked_up(n) for n in lengths]) if lengths else empty))
    near = scanned.join(_bounded(halves, half_size), ["len", "half"], "left_semi")
    near = near.select("_key", "doc_id", "len", "from", F.posexplode(F.expr(
        "CASE WHEN size(around) >= len THEN " + _grams("around", "len") + " ELSE array() END")).alias("i", "gram"))
    found = near.join(_bounded(grams, size), ["len", "gram"]).select(
        "_key", "doc_id", (F.col("from") + F.col("i")).alias("at"), "len", "items")
    # a document's hits are at most its words times the window lengths
    marked = found.groupBy("_key", "doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("len")).alias("end")))).alias("runs"))
    covered = F.aggregate("runs", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), lambda s, r: F.struct(
        (s["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["at"], s["upto"]))).alias("n"),
        F.greatest(s["upto"], r["end"]).alias("upto")), lambda s: s["n"].cast("long"))
    return marked.select("_key", "doc_id", covered.alias("n_hit"), "items", "runs")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, spans, contaminated``, one row per document.

    spans: word ranges [at, end) of the hit windows, at counted from 1.
    """
    found = hits(docs, benchmark, window).select(F.col("_key").alias("_k"), F.col("doc_id").alias("_d"), "n_hit", "items", "runs")
    counted = keyed(docs, "doc_id", "text").select(
        "_key", "doc_id", F.size(tokens()).cast("long").alias("n_words"))
    out = counted.join(found, (counted["_key"] == F.col("_k")) & counted.doc_id.eqNullSafe(F.col("_d")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.size(items).cast("long").alias("n_items"), items.alias("items"), F.col("runs").alias("spans"),
                      F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with their columns as they are."""
    bad = saved(hits(docs, benchmark, window).select(F.col("_key").alias("_k"), F.col("doc_id").alias("_d")), "contaminated")
    rows = with_key(docs, "doc_id")
    return rows.join(bad, (rows["_key"] == F.col("_k")) & rows.doc_id.eqNullSafe(F.col("_d")), "left_anti").select("_row.*")

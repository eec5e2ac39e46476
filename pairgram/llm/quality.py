r"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are
compared with those of its language by the Jensen-Shannon distance (base 2, so 0
to 1). The references come from all documents of the language: the mean class
shares of those that pass the base rules, and the COMMON most frequent words with
their shares of all words. A distance above its limit rejects the document.

Length guards: the distance of a short clean text from its language is large by
chance and falls with the square root of its length. Documents under MIN_WORDS
words are not judged, and the limits are ``limit + slack / sqrt(words)``.

Base rules and counts are row-local. Words are runs of anything but ASCII white
space. Repeated words: words in windows of WINDOW words that occur twice or more
in the text; windows are compared by a 64-bit hash of their words' hashes.

Defined cases: null and empty texts have no words and fail the base rules; a null
lang is a language of its own; ties among common words go to the smaller word; a
language whose documents all fail the base rules rejects nobody by classes.
Repeated rows get equal results; an empty table gives no rows. Input columns
may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairgram.llm.common import SPACE, saved, settled, words_of

#: Base rules.
WINDOW = 5
MIN_BASE_WORDS = 10
MAX_REPEATED_PERCENT = 20
SYMBOLS = "[#*$%&|<>]"

#: Divergence rules.
COMMON = 20
MIN_WORDS = 30
CLASS_LIMIT, CLASS_SLACK = 0.12, 0.9
WORD_LIMIT, WORD_SLACK = 0.26, 0.8

#: Character classes after lower-case letters and white space; what is left is "other".
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "symbol": SYMBOLS, "punctuation": r"[.,;:!?'\"()\-]"}
#: Lower-case letters of ASCII and Latin-1 and the space: most of a text, dropped in one pass.
PLAIN = r"[a-z\x20ß-öø-ÿ]+"


def _matches(text: str, one: str) -> Column:
    """How often a one-character pattern matches."""
    return (F.size(F.split(text, one)) - 1).cast("long")


def _window_hashes(df: DataFrame) -> DataFrame:
    """``h``: the hash of each window of WINDOW = 5 words of ``w``, by doubling: 1, 2, 4 and 4 + 1 words."""
    pair = lambda a, b: F.xxhash64(a, b)
    after = lambda c, n: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    first = lambda c, n: F.slice(c, 1, F.greatest(n, F.lit(0)))
    df = settled(df, h1=F.transform("w", lambda x: F.xxhash64(x)))
    df = settled(df, h2=F.zip_with(first("h1", F.size("h1") - 1), after("h1", 1), pair))
    df = settled(df, h4=F.zip_with(first("h2", F.size("h2") - 2), after("h2", 2), pair))
    df = settled(df, h=F.zip_with(first("h4", F.size("h4") - 1), after("h1", 4), pair))
    return df.drop("h1", "h2", "h4")


def _repeat_words(df: DataFrame) -> DataFrame:
    """``n_repeat_words`` from ``h``; only texts with a repeated window are sorted."""
    none = F.array().cast("array<struct<h:bigint,at:int>>")
    df = settled(df, s=F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(
        F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))).otherwise(none))
    same = lambda x, i: F.coalesce(x["h"] == F.get("s", i)["h"], F.lit(False))
    twice = F.filter("s", lambda x, i: same(x, i - 1) | same(x, i + 1))
    df = settled(df, at=F.array_sort(F.transform(twice, lambda x: x["at"])))
    n = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), lambda s, p: F.struct(
        (s["n"] + p + WINDOW - F.greatest(p, s["upto"])).alias("n"), (p + WINDOW).alias("upto")), lambda s: s["n"].cast("long"))
    return df.withColumn("n_repeat_words", n).drop("h", "s", "at")


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, common`` (words by falling count) ``, word_shares`` (their shares and the rest's)."""
    counts = (docs.select(F.col(lang).alias("lang"), F.explode(words_of(text)).alias("word"))
              .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    counts = saved(counts, "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("nr", rank).filter(F.col("nr") <= COMMON).groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("nr", "word", "n"))).alias("top"))
    joined = top.join(totals.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")))
    shares = F.transform("top", lambda x: x["n"] / F.col("total"))
    shares = F.concat(shares, F.array(F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)))
    return saved(joined.select("lang", F.col("top.word").alias("common"), shares.alias("word_shares")), "common")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms given as arrays of shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m) / 2).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b), F.lit(0.0)))


def measured(docs: DataFrame, words: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, lang``, the base columns, class shares and common-word shares: one narrow row per document."""
    base = docs.select("doc_id", F.col(lang).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    few = [r[0] for r in words.select(F.explode("common")).distinct().take(20_001)]
    w = words.select(F.col("lang").alias("_l"), "common", "word_shares")
    base = base.join(w, base.lang.eqNullSafe(F.col("_l")), "left").drop("_l")
    df = settled(base, w=words_of("text"), lines=F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))),
                 rest=F.regexp_replace("text", PLAIN, ""))
    length, rest, white = F.length("text"), F.length("rest"), _matches("rest", SPACE.rstrip("+"))
    df = df.select(
        "doc_id", "lang", "common", "word_shares", "w", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"), _matches("rest", SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        length.alias("n_chars"), rest.alias("n_rest"), white.alias("n_rest_white"), _matches("rest", r"\p{Ll}").alias("lower"),
        *[_matches("rest", p).alias(c) for c, p in CLASSES.items()])
    space = F.col("n_chars") - F.col("word_chars")
    df = df.withColumn("space", space).withColumn(
        "lower", F.col("lower") + F.col("n_chars") - F.col("n_rest") - (space - F.col("n_rest_white")))
    names = ["lower", "space", *CLASSES]
    other = F.col("n_chars") - sum((F.col(c) for c in names[1:]), F.col(names[0]))
    classes = F.array(*[F.col(c) for c in names], other)
    # at most 20,000 words are compared as constants first; beyond that the array alone decides
    likely = F.filter("w", lambda x: x.isin(few)) if len(few) <= 20_000 else F.col("w")
    df = settled(df, classes=classes, likely=likely)
    hist = F.transform("common", lambda c: F.size(F.filter("likely", lambda x: x == c)))
    df = settled(df, hist=hist)
    df = _repeat_words(_window_hashes(df))
    n = F.greatest(F.col("n_words"), F.lit(1))
    shares = F.concat(F.transform("hist", lambda c: c / n), F.array(
        1.0 - F.aggregate("hist", F.lit(0), lambda a, b: a + b) / n))
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return df.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                     F.transform("classes", lambda c: c / F.greatest(F.col("n_chars"), F.lit(1))).alias("classes"),
                     F.when(F.col("common").isNotNull(), distance(shares, F.col("word_shares"))).alias("word_distance"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id``, the base columns, ``class_distance, word_distance, base_failed, kept``, one row per document."""
    rows = saved(measured(docs, common_words(docs, text, lang), text, lang), "quality")
    n_classes = len(CLASSES) + 3
    refs = rows.filter(~F.col("base_failed")).groupBy(F.col("lang").alias("_l")).agg(
        *[F.avg(F.col("classes")[i]).alias(f"c{i}") for i in range(n_classes)])
    refs = saved(refs.select("_l", F.array(*[f"c{i}" for i in range(n_classes)]).alias("ref")), "classes")
    out = rows.join(refs, rows.lang.eqNullSafe(F.col("_l")), "left")
    out = out.withColumn("class_distance", F.when(F.col("ref").isNotNull(), distance(F.col("classes"), F.col("ref"))))
    slack = 1 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    far = (F.coalesce(F.col("class_distance"), F.lit(0.0)) > CLASS_LIMIT + CLASS_SLACK * slack) | (
        F.coalesce(F.col("word_distance"), F.lit(0.0)) > WORD_LIMIT + WORD_SLACK * slack)
    kept = ~F.col("base_failed") & ~((F.col("n_words") >= MIN_WORDS) & far)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "class_distance", "word_distance", "base_failed", kept.alias("kept"))

"""The long gram table and the per-pair gram-count table.

``grams(conv_id, turn, family, side, pos, gram)`` is built with ONE generator over
the concatenation of every family's array, so the pair rows are read once.
``gram_counts(conv_id, turn, family, gram, ca, cb)`` is one hash aggregate. Pairs that
come from the join on the pair key (``sources.fixtures.conversation_pairs``) are
partitioned by it, so neither step adds an exchange.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgram.keys import PAIR
from pairgram.functions import ngrams as ng
from pairgram.functions import text as tx
from pairgram.operators.tags import parse_field

WORD_FAMILIES = ("word1", "word2", "word3", "stem1", "stem2", "stem3")
CHAR_FAMILIES = ("char1", "char2", "char3", "cstem1", "cstem2", "cstem3")
POS_FAMILIES = ("pos1", "pos2", "pos3")
TAG_UNIGRAM_FAMILIES = ("ner1", "event1")
ALL_FAMILIES = WORD_FAMILIES + CHAR_FAMILIES + POS_FAMILIES + TAG_UNIGRAM_FAMILIES

# Char "bigram" uses size 2 (the reference used 3 by mistake).
CHAR_SIZES = {"1": 1, "2": 2, "3": 3}


def _base_columns(families: Iterable[str], side: int, text_col: str, tag_col: str | None) -> dict[str, Column]:
    """Per-side base arrays, computed once and shared by the families."""
    fams = set(families)
    text = F.col(text_col)
    base: dict[str, Column] = {}
    if fams & {"word1", "word2", "word3"}:
        base[f"tok_{side}"] = tx.word_punct_tokens(text)
    if fams & {"stem1", "stem2", "stem3", "cstem1", "cstem2", "cstem3"}:
        base[f"stok_{side}"] = tx.stemmed_alpha_tokens(text)
    if fams & set(CHAR_FAMILIES[3:]):
        base[f"schars_{side}"] = ng.characters(tx.stemmed_sentence(text))
    if fams & set(CHAR_FAMILIES[:3]):
        base[f"chars_{side}"] = ng.characters(text)
    if tag_col is not None:
        if fams & set(POS_FAMILIES):
            base[f"pos_{side}"] = parse_field(F.col(tag_col), 2)
        if any(f.startswith("ner") for f in fams):
            base[f"ner_{side}"] = parse_field(F.col(tag_col), 1, drop_o=True)
        if any(f.startswith("event") for f in fams):
            base[f"event_{side}"] = parse_field(F.col(tag_col), 4, drop_o=True)
    return base


def family_array(family: str, side: int) -> Column:
    """The gram list of one family for one side, from the base columns."""
    kind, n = family[:-1], int(family[-1])
    if kind == "word":
        return ng.word_ngrams(F.col(f"tok_{side}"), n)
    if kind == "stem":
        return ng.word_ngrams(F.col(f"stok_{side}"), n)
    if kind == "char":
        return ng.char_windows(F.col(f"chars_{side}"), CHAR_SIZES[str(n)])
    if kind == "cstem":
        return ng.char_windows(F.col(f"schars_{side}"), CHAR_SIZES[str(n)])
    if kind == "pos":
        return ng.word_ngrams(F.col(f"pos_{side}"), n)
    if kind in ("ner", "event"):
        return ng.word_ngrams(F.col(f"{kind}_{side}"), n)
    raise ValueError(f"unknown family {family}")


def with_base_arrays(pairs: DataFrame, families: Iterable[str] = ALL_FAMILIES,
                     text_cols=("sent_1", "sent_2"), tag_cols=("tags_1", "tags_2")) -> DataFrame:
    fams = list(families)
    cols = {}
    for side in (1, 2):
        tag_col = tag_cols[side - 1] if tag_cols and tag_cols[side - 1] in pairs.columns else None
        cols.update(_base_columns(fams, side, text_cols[side - 1], tag_col))
    return pairs.select(*PAIR, *[c.alias(k) for k, c in cols.items()])


#: Kind of a family -> its item list, from the base columns.
LISTS = {"word": "tok", "stem": "stok", "char": "chars", "cstem": "schars", "pos": "pos", "ner": "ner", "event": "event"}


def _item_lists(fams: list[str], sizes: list[int]) -> Column:
    """One struct per (kind, side): its items and the family of each gram size, null for a size that is not asked for."""
    rows = []
    for kind in dict.fromkeys(f[:-1] for f in fams):
        named = [(F.lit(f"{kind}{n}") if f"{kind}{n}" in fams else F.lit(None).cast("string")).alias(f"family{n}") for n in sizes]
        rows += [F.struct(F.lit(side).alias("side"), F.lit(kind in ("char", "cstem")).alias("is_char"),
                          F.col(f"{LISTS[kind]}_{side}").alias("lst"), *named) for side in (1, 2)]
    return F.array(*rows)


def _under(items: list[Column]) -> Column:
    """Items joined by ``_``."""
    return F.concat(items[0], *[c for item in items[1:] for c in (F.lit("_"), item)])


def gram_table(pairs: DataFrame, families: Iterable[str] = ALL_FAMILIES,
               text_cols=("sent_1", "sent_2"), tag_cols=("tags_1", "tags_2"), keep_empty: bool = False) -> DataFrame:
    """Pair key, ``family, side, pos, gram``: one row per gram occurrence (pos 1-based).

    ``keep_empty`` adds one row without a gram for a family and side that has none.

    An item list is exploded once for all its families: each row carries an item with
    the next ones (not the whole text), and a second generator gives the grams that
    begin there, without a lambda. Character grams concatenate characters; word grams
    join with ``_`` and keep the reference fallback: a list shorter than n yields its
    (n-1)-grams, down to unigrams, i.e. the window is least(n, max(size, 1)).
    """
    fams = list(families)
    sizes = sorted({int(f[-1]) for f in fams})
    base = with_base_arrays(pairs, fams, text_cols, tag_cols)
    rows = base.select(*PAIR, F.inline(_item_lists(fams, sizes)))
    size = F.coalesce(F.size("lst"), F.lit(0))
    fields = "abc"[:sizes[-1]]
    ahead = F.arrays_zip(*[F.slice("lst", k, F.greatest(size, F.lit(0))) for k in range(1, len(fields) + 1)])
    ahead = ahead.cast("array<struct<" + ",".join(f"{c}:string" for c in fields) + ">>")
    # posexplode_outer: a plain explode makes the optimizer infer size(array) > 0 and push it below the projection
    items = rows.select(*PAIR, "side", "is_char", *[f"family{n}" for n in sizes], size.alias("size"),
                        F.posexplode_outer(ahead).alias("p0", "x"))
    at = F.coalesce("p0", F.lit(0))
    grams = []
    for n in sizes:
        window = F.when(F.col("is_char"), F.lit(n)).otherwise(F.least(F.lit(n), F.greatest("size", F.lit(1))))
        there = at + window <= F.col("size")
        first = [F.col(f"x.{c}") for c in fields[:n]]
        gram = F.when(F.col("is_char"), F.concat(*first))
        for m in range(1, n):
            gram = gram.when(window == m, _under(first[:m]))
        gram = gram.otherwise(_under(first))
        none = (at == 0) & (F.col("size") < window) if keep_empty else F.lit(False)
        grams.append(F.struct(F.col(f"family{n}").alias("family"), F.when(there, at + 1).alias("pos"),
                              F.when(there, gram).alias("gram"), (there | none).alias("kept")))
    out = items.select(*PAIR, "side", F.inline(F.array(*grams))).filter("kept AND family IS NOT NULL")
    return out.select(*PAIR, "family", "side", "pos", "gram")


def gram_counts(grams: DataFrame) -> DataFrame:
    """``conv_id, turn, family, gram, ca, cb``: occurrences of each gram on each side."""
    return grams.groupBy(*PAIR, "family", "gram").agg(
        F.count_if((F.col("side") == 1) & F.col("gram").isNotNull()).alias("ca"),
        F.count_if((F.col("side") == 2) & F.col("gram").isNotNull()).alias("cb"),
    )

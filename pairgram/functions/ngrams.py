"""N-gram generators as higher-order array expressions.

Every range is guarded: Spark's ``sequence(1, 0)`` counts down, so a
window larger than the list must produce an empty array explicitly.
"""

from __future__ import annotations

from itertools import accumulate, product

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def patterns(n: int, skip: int) -> list[tuple[int, ...]]:
    """Places of a gram's n items from its first: neighbouring items are 1 to skip + 1 apart."""
    return [tuple(accumulate((0, *steps))) for steps in product(range(1, skip + 2), repeat=n - 1)]


def _laid(arr: Column, places: tuple[int, ...], join: str) -> Column:
    """The grams of one pattern at each place where it fits: slices shifted by the pattern, side by side."""
    fits = F.greatest(F.size(arr) - places[-1], F.lit(0))
    names = [f"x{k}" for k in range(len(places))]
    shifted = F.arrays_zip(*[F.slice(arr, F.lit(at + 1), fits) for at in places])
    shifted = shifted.cast("array<struct<" + ", ".join(f"{x}: string" for x in names) + ">>")
    return F.transform(shifted, lambda z: F.concat_ws(join, *[z[x] for x in names]))


def spread_grams(arr: Column, n: int, join: str = "_", skip: int = 0) -> Column:
    """All patterns of n items, in order of the first item, then of the pattern."""
    laid = [_laid(arr, places, join) for places in patterns(n, skip)]
    if len(laid) == 1:
        return laid[0]
    names = [f"p{k}" for k in range(len(laid))]
    # a wider pattern fits in fewer places and leaves nulls at the end
    side_by_side = F.arrays_zip(*laid).cast("array<struct<" + ", ".join(f"{x}: string" for x in names) + ">>")
    return F.array_compact(F.flatten(F.transform(side_by_side, lambda z: F.array(*[z[x] for x in names]))))


def bigrams(arr: Column, join: str = "_", skip: int = 0) -> Column:
    """Pairs up to skip + 1 apart; a list shorter than 2 falls back to itself."""
    return F.when(F.size(arr) < 2, arr).otherwise(spread_grams(arr, 2, join, skip))


def trigrams(arr: Column, join: str = "_", skip: int = 0) -> Column:
    """Triples with skips; a list shorter than 3 falls back to ``bigrams``."""
    return F.when(F.size(arr) < 3, bigrams(arr, join, skip)).otherwise(spread_grams(arr, 3, join, skip))


def word_ngrams(arr: Column, n: int, join: str = "_", skip: int = 0) -> Column:
    if n == 1:
        return arr
    if n == 2:
        return bigrams(arr, join, skip)
    if n == 3:
        return trigrams(arr, join, skip)
    raise ValueError(f"word n-grams of size {n} are not defined")


def char_ngrams(text: Column, n: int) -> Column:
    """Every substring of ``n`` characters, spaces included; empty if shorter."""
    return char_windows(characters(text), n)


def characters(text: Column) -> Column:
    """The code points of a text, in one pass."""
    s = F.coalesce(text, F.lit(""))
    return F.when(s == "", empty_strings()).otherwise(F.split(s, ""))


def char_windows(chars: Column, n: int) -> Column:
    """Windows of ``n`` characters from shifted slices: linear in the text."""
    if n == 1:
        return chars
    m = F.greatest(F.size(chars) - n + 1, F.lit(0))
    fields = ", ".join(f"c{k}: string" for k in range(n))
    zipped = F.arrays_zip(*[F.slice(chars, k + 1, m) for k in range(n)]).cast(f"array<struct<{fields}>>")
    return F.transform(zipped, lambda z: F.concat(*[z[f"c{k}"] for k in range(n)]))


def windows(arr: Column, n: int, join: str = " ") -> Column:
    """Contiguous windows of ``n`` items joined by ``join``; empty if shorter (no fallback)."""
    size = F.size(arr)
    if n == 1:
        return arr
    return F.when(size >= n,
                  F.transform(F.sequence(F.lit(0), size - n),
                              lambda i: F.concat_ws(join, *[F.get(arr, i + k) for k in range(n)]))
                  ).otherwise(empty_strings())


def word_ngram_set(words: Column, n: int) -> Column:
    """Distinct windows of ``n`` tweet words (a short list gives the empty set)."""
    return F.array_distinct(windows(words, n))


def char_ngram_set(words: Column, n: int) -> Column:
    """Distinct character windows inside each word, united over the words."""
    return F.array_distinct(F.flatten(F.transform(words, lambda w: char_ngrams(w, n))))

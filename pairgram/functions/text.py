"""Text scalars as Catalyst expressions: tokenisers, stemming, accent stripping.

All functions take and return ``Column`` objects, so they run inside the JVM
(no Python UDF) and work on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must stay identical to the SQL oracle).
# Word characters: letters, digits, underscore (Python's unicode \w).
WORD_RE = r"[\p{L}\p{N}_]+"
# Explicit whitespace set, so that Java regex and RE2 agree.
SPACE_CHARS = " \\t\\n\\r\\f\\x0B"
PUNCT_RE = r"[^\p{L}\p{N}_" + SPACE_CHARS + r"]+"
NON_SPACE_RE = r"[^" + SPACE_CHARS + r"]+"
WORD_PUNCT_RE = WORD_RE + "|" + PUNCT_RE
ALPHA_RE = r"^\p{L}+$"
DIGIT_RE = r"^[0-9]+$"

# Accent folding table (strip_accents for Latin letters).
ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ"
UNACCENTED = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_text(c) -> Column:
    """Null text behaves as the empty string."""
    return F.coalesce(_col(c), F.lit(""))


def word_punct_tokens(c, lower: bool = True) -> Column:
    """Runs of word characters or of punctuation, optionally lower-cased."""
    s = safe_text(c)
    if lower:
        s = F.lower(s)
    return F.regexp_extract_all(s, F.lit(WORD_PUNCT_RE), 0)


def word_tokens(c) -> Column:
    """Runs of word characters only, case kept (used to build clean sentences)."""
    return F.regexp_extract_all(safe_text(c), F.lit(WORD_RE), 0)


def clean_sentence(c) -> Column:
    """Word tokens joined by one space: a sentence without punctuation."""
    return F.array_join(word_tokens(c), " ")


def alpha_tokens(c) -> Column:
    """Lower-cased word-punct tokens made of letters only."""
    return F.filter(word_punct_tokens(c, lower=True), lambda t: t.rlike(ALPHA_RE))


def s_stem(w: Column) -> Column:
    """T5: the S-stemmer as one CASE expression.

    ies -> y (not after e/a), es -> e (not after a/e/o), s -> '' (not after
    u/s). Words shorter than three letters are left alone.
    """
    long_enough = F.length(w) >= 3
    return (
        F.when(long_enough & w.endswith("ies") & ~w.endswith("eies") & ~w.endswith("aies"),
               F.regexp_replace(w, "ies$", "y"))
        .when(long_enough & w.endswith("es") & ~w.endswith("aes") & ~w.endswith("ees") & ~w.endswith("oes"),
              F.regexp_replace(w, "es$", "e"))
        .when(long_enough & w.endswith("s") & ~w.endswith("us") & ~w.endswith("ss"),
              F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def stem_tokens(arr: Column) -> Column:
    return F.transform(arr, s_stem)


def stemmed_alpha_tokens(c) -> Column:
    """Alphabetic tokens, lower-cased and stemmed."""
    return stem_tokens(alpha_tokens(c))


def stemmed_sentence(c) -> Column:
    """T4: T3 joined by one space."""
    return F.array_join(stemmed_alpha_tokens(c), " ")


def tweet_words(c) -> Column:
    """Whitespace split, lower-cased, non-word characters removed.

    A word made only of punctuation becomes the empty string, as in the
    reference helper.
    """
    pieces = F.regexp_extract_all(safe_text(c), F.lit(NON_SPACE_RE), 0)
    return F.transform(pieces, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}_]", ""))


def is_digit_token(c) -> Column:
    """The token is made of ASCII digits only."""
    return _col(c).rlike(DIGIT_RE)


def strip_accents(c) -> Column:
    """F8: fold accented Latin letters to their base letter."""
    return F.translate(_col(c), ACCENTED, UNACCENTED)

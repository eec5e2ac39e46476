"""The English (Porter2) stemmer, applied to the distinct words of a corpus (T5, as an option).

The rules are those published for the English stemmer of the Snowball family: a word's
regions R1 and R2 (what follows the first consonant after a vowel, once and twice), then
endings taken off or exchanged in steps, the longest ending of a step first.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published word lists and endings of the English stemmer.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
         "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
         "bias": "bias", "andes": "andes"}
AFTER_S = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
R1_HEADS = ("gener", "commun", "arsen")
STEP_2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
          "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
          "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
LI_AFTER = "cdeghkmnrt"

VOWEL = re.compile("[aeiouy]")
REGION = re.compile("[aeiouy][^aeiouy]")
DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _short_end(w: str) -> bool:
    """The word ends in a short syllable."""
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch("[aeiouy][^aeiouy]", w))


def _after(w: str, at: int) -> int:
    found = REGION.search(w, at)
    return found.end() if found else len(w)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.lstrip("'") if word.startswith("'") else word
    # a y that is a consonant is written Y
    w = re.sub("^y", "Y", w)
    w = re.sub("([aeiouy])y", r"\1Y", w)
    r1 = next((len(h) for h in R1_HEADS if w.startswith(h)), None) or _after(w, 0)
    r2 = _after(w, r1)
    for tail in ("'s'", "'s", "'"):
        if w.endswith(tail):
            w = w[:-len(tail)]
            break
    # plural endings
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in AFTER_S:
        return w
    # past and continuous forms
    tail = next((t for t in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(t)), None)
    if tail in ("eed", "eedly"):
        w = w[:-len(tail)] + "ee" if len(w) - len(tail) >= r1 else w
    elif tail and VOWEL.search(w[:-len(tail)]):
        w = w[:-len(tail)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLE):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # derived endings, the longest that fits; it changes only inside its region
    tail = next((t for t in STEP_2 if w.endswith(t)), None)
    if tail and len(w) - len(tail) >= r1:
        before = w[:-len(tail)]
        if not (tail == "ogi" and not before.endswith("l")) and not (tail == "li" and before[-1:] not in tuple(LI_AFTER)):
            w = before + STEP_2[tail]
    tail = next((t for t in STEP_3 if w.endswith(t)), None)
    if tail and len(w) - len(tail) >= (r2 if tail == "ative" else r1):
        w = w[:-len(tail)] + STEP_3[tail]
    tail = next((t for t in STEP_4 if w.endswith(t)), None)
    if tail and len(w) - len(tail) >= r2 and (tail != "ion" or w[-4:-3] in ("s", "t")):
        w = w[:-len(tail)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


def stem_table(words: DataFrame) -> DataFrame:
    """``token, stem``: each distinct ``token`` once, so that Python sees the vocabulary and never the text."""

    @F.pandas_udf("string")
    def stems(tokens: pd.Series) -> pd.Series:
        return tokens.map(stem, na_action="ignore")

    return words.select("token").filter("token IS NOT NULL").distinct().select("token", stems("token").alias("stem"))

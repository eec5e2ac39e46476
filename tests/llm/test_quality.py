import math
import random
import re
from collections import Counter

import pytest
from pairgram.llm import quality

from helpers import awkward, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again),
            len(w) < 10 or 100 * len(again) > 20 * len(w))


def columns(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def prose(n, seed):
    random.seed(seed)
    common = ["the", "of", "and", "to", "in", "is"]
    words = [random.choice(common) if random.random() < 0.4 else "".join(random.choice("aeinrstlo") for _ in range(random.randint(3, 8))) for _ in range(n)]
    return " ".join(words).capitalize() + ".\n"


def test_base_columns_and_awkward_rows(spark):
    random.seed(4)
    odd = ["a b c d e " * 3, "a b c d e f a b c d e", "x\n\nx\n x\nx", "A#b |c <d> \t&\x0b%$*", "é É ß 漢\n1 2"]
    odd += [" ".join(random.choice("abc") for _ in range(n)) + random.choice(["", "\n", " | "]) for n in range(0, 60, 3)]
    rows = awkward(3_000) + [(100 + i, t, random.choice(["en", None])) for i, t in enumerate(odd)]
    out = quality.judge(documents(spark, rows)).collect()
    assert sorted(str((r.doc_id, columns(r))) for r in out) == sorted(str((r[0], base(r[1]))) for r in rows)
    assert not any(r.kept and r.base_failed for r in out)
    assert quality.judge(documents(spark, [])).count() == 0


def test_junk_goes_and_prose_stays(spark):
    rows = [(i, prose(60 + 3 * i, i), "en") for i in range(120)]
    rows += [(1000, prose(200, 500).upper(), "en"), (1001, "".join(w + "&%# " for w in prose(200, 501).split()), "en"),
             (1002, " ".join(f"{i}7{i * 31}" for i in range(200)), "en"), (1003, " ".join("zxqvkj"[i % 5:] + "wpm" * (i % 7) + str(i % 3) for i in range(211)), "en"),
             (1004, "SHORT LOUD TEXT OF TEN OR MORE WORDS IS NOT JUDGED HERE", "en"), (1005, prose(300, 502), None)]
    kept = {r.doc_id: r.kept for r in quality.judge(documents(spark, rows)).collect()}
    assert all(kept[i] for i in range(120)) and kept[1004] and kept[1005]
    assert not any(kept[i] for i in (1000, 1001, 1002, 1003))


def test_distance_is_jensen_shannon(spark):
    def js(p, q):
        half = lambda a: sum(x * math.log2(2 * x / (x + y)) / 2 for x, y in a if x)
        return math.sqrt(max(0.0, half(zip(p, q)) + half(zip(q, p))))

    cases = [([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.2, 0.3, 0.5], [0.1, 0.9, 0.0])]
    df = spark.createDataFrame(cases, "p array<double>, q array<double>")
    for (p, q), r in zip(cases, df.select(quality.distance(df.p, df.q).alias("d")).collect()):
        assert r.d == pytest.approx(js(p, q), abs=1e-12)

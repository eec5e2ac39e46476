from pyspark.sql import functions as F

from pairgram.functions import ngrams as ng


def ref_bigram(words, skip=0):
    L = len(words)
    if L <= 1:
        return list(words)
    return [words[i] + "_" + words[i + k] for i in range(L - 1) for k in range(1, skip + 2) if i + k < L]


def ref_trigram(words, skip=0):
    L = len(words)
    if L <= 2:
        return ref_bigram(words, skip)
    return [f"{words[i]}_{words[i + a]}_{words[i + a + b]}" for i in range(L - 2)
            for a in range(1, skip + 2) for b in range(1, skip + 2) if i + a < L and i + a + b < L]


LISTS = [[], ["a"], ["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d", "e"], ["x", "x", "x", "x"]]


def test_word_ngrams_with_fallback(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(LISTS)], "id int, w array<string>")
    for skip in (0, 1, 2):
        rows = df.select("w", ng.bigrams(F.col("w"), skip=skip).alias("b"),
                         ng.trigrams(F.col("w"), skip=skip).alias("t")).collect()
        for r in rows:
            assert r.b == ref_bigram(r.w, skip)
            assert r.t == ref_trigram(r.w, skip)


def test_char_ngrams_and_sets(spark):
    df = spark.createDataFrame([("",), ("ab",), ("abcd",)], "s string")
    rows = df.select("s", ng.char_ngrams(F.col("s"), 3).alias("c3"), ng.char_ngrams(F.col("s"), 1).alias("c1")).collect()
    for r in rows:
        assert r.c3 == [r.s[i:i + 3] for i in range(len(r.s) - 2)]
        assert r.c1 == list(r.s)
    words = spark.createDataFrame([(["ab", "ba", "ab"],)], "w array<string>")
    r = words.select(ng.char_ngram_set(F.col("w"), 1).alias("c"), ng.word_ngram_set(F.col("w"), 2).alias("v")).first()
    assert sorted(r.c) == ["a", "b"]
    assert sorted(r.v) == ["ab ba", "ba ab"]
    # a short list gives the empty set (no fallback for the set features)
    r = words.select(ng.word_ngram_set(F.array(F.lit("a")), 2).alias("v")).first()
    assert r.v == []

import re

from pyspark.sql import functions as F

from pairgram.functions import text as tx

WP = re.compile(r"\w+|[^\w\s]+")


def ref_tokens(s):
    return [t.lower() for t in WP.findall(s or "")]


def ref_stem(w):
    if len(w) >= 3 and w.endswith("ies") and not (w.endswith("eies") or w.endswith("aies")):
        return w[:-3] + "y"
    if len(w) >= 3 and w.endswith("es") and not (w.endswith("aes") or w.endswith("ees") or w.endswith("oes")):
        return w[:-2] + "e"
    if len(w) >= 3 and w.endswith("s") and not (w.endswith("us") or w.endswith("ss")):
        return w[:-1]
    return w


def test_tokenizers_match_python(spark, edge_pairs):
    rows = edge_pairs.select("sent_1", tx.word_punct_tokens("sent_1").alias("t"),
                             tx.alpha_tokens("sent_1").alias("a"),
                             tx.stemmed_alpha_tokens("sent_1").alias("s"),
                             tx.tweet_words("sent_1").alias("w")).collect()
    for r in rows:
        toks = ref_tokens(r.sent_1)
        assert r.t == toks
        assert r.a == [t for t in toks if t.isalpha()]
        assert r.s == [ref_stem(t) for t in toks if t.isalpha()]
        assert r.w == [re.sub(r"\W", "", w.lower()) for w in (r.sent_1 or "").split()]


def test_null_text_is_empty(spark, edge_pairs):
    r = edge_pairs.filter("conv_id = 8").select(tx.word_punct_tokens("sent_1").alias("t")).first()
    assert r.t == []


def test_digits_and_accents(spark):
    df = spark.createDataFrame([("123", "Éléphant"), ("12a", "ça")], "a string, b string")
    out = df.select(tx.is_digit_token(F.col("a")).alias("d"), tx.strip_accents(F.col("b")).alias("s")).collect()
    assert [r.d for r in out] == [True, False]
    assert [r.s for r in out] == ["Elephant", "ca"]

import math
from collections import Counter

from pyspark.sql import functions as F

from pairgram.joins import hot_keys, join_hot
from pairgram.operators import encode as ENC
from pairgram.operators import lexnet as W
from pairgram.operators import tfidf as TF
from pairgram.operators.metrics import binary_metrics


def test_tfidf_against_manual(spark):
    docs = ["a b c", "a b", "a c d", "b c a", "the a"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    model = TF.TfidfModel(["the"], min_df=2, max_n=2).fit(df)
    got = {(r.doc_id, r.term): r.weight for r in model.transform(df).collect()}
    toks = [[t for t in d.split() if t != "the"] for d in docs]
    terms = [t + [" ".join(t[i:i + 2]) for i in range(len(t) - 1)] for t in toks]
    dfreq = Counter(x for ts in terms for x in set(ts))
    vocab = {t for t, c in dfreq.items() if c >= 2}
    idf = {t: math.log((1 + len(docs)) / (1 + dfreq[t])) + 1 for t in vocab}
    for i, ts in enumerate(terms):
        tf = Counter(t for t in ts if t in vocab)
        w = {t: (1 + math.log(c)) * idf[t] for t, c in tf.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            assert abs(got[(i, t)] - round(v / norm, 6)) < 1e-9
    assert len(got) == sum(len(Counter(t for t in ts if t in vocab)) for ts in terms)


def test_dense_codes(spark):
    vals = ["pear", "apple", "fig", "apple", "zebra", "kiwi"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = {r.v: r.code for r in ENC.dense_codes(df, "v", num_partitions=3).collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(vals)))}
    enc = ENC.LabelEncoder("v").fit(df)
    unseen = spark.createDataFrame([("plum",)], "v string")
    assert enc.transform(unseen).first().v_code == 5


def test_closure_and_similarity(spark):
    edges = spark.createDataFrame([("cat", "feline"), ("feline", "animal"), ("dog", "canine"),
                                   ("canine", "animal"), ("animal", "root")], "child string, parent string")
    clo = {(r.node, r.ancestor): r.dist for r in W.hypernym_closure(edges).collect()}
    assert clo[("cat", "cat")] == 0 and clo[("cat", "animal")] == 2 and clo[("cat", "root")] == 3
    assert ("cat", "dog") not in clo
    lemmas = spark.createDataFrame([("cat", "cat", 1), ("dog", "dog", 1), ("kitty", "cat", 1)],
                                   "word string, synset string, rank int")
    pairs = spark.createDataFrame([("cat", "dog"), ("cat", "kitty"), ("cat", "nothing")], "word_1 string, word_2 string")
    sim = {(r.word_1, r.word_2): r for r in W.word_similarity(pairs, lemmas, W.hypernym_closure(edges)).collect()}
    # cat-dog: path 4 via animal, h = max over shared ancestors (animal, root) of max(d1, d2) = 3
    assert abs(sim[("cat", "dog")].similarity - round(math.exp(-0.2 * 4) * math.tanh(0.45 * 3), 6)) < 1e-9
    # same synset: l = 0, h = depth of cat = 3
    assert abs(sim[("cat", "kitty")].similarity - round(math.tanh(0.45 * 3), 6)) < 1e-9
    assert sim[("cat", "nothing")].similarity == 0.0


def test_binary_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "label int, prediction int")
    r = binary_metrics(df).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 1)
    assert r.precision == round(2 / 3, 6) and r.recall == round(2 / 3, 6) and r.accuracy == 0.6


def test_closure_follows_chains_and_cycles_to_their_end(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(70)] + [("x", "y"), ("y", "x")]
    got = {(r.node, r.ancestor): r.dist for r in W.hypernym_closure(spark.createDataFrame(chain, "child string, parent string")).collect()}
    assert got[("n0", "n70")] == 70 and got[("x", "y")] == 1 and got[("x", "x")] == 0
    assert len(got) == 71 * 72 // 2 + 4


def test_hot_keys_are_divided_without_loss(spark):
    many = spark.range(4000).selectExpr("id", "if(id % 2 = 0, 'hot', concat('k', id % 700)) AS k")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4)], "k string, v int")
    want = sorted((r.k, r.id, r.v) for r in many.join(few, "k").collect())
    hot = hot_keys(many, "k", harmless=100)
    assert [r.k for r in hot.collect()] == ["hot"]
    assert hot_keys(many, "k") is None
    for most in (10, 1):  # by broadcast, by salts
        assert sorted((r.k, r.id, r.v) for r in join_hot(many, few, "k", hot, most).collect()) == want
    assert sorted((r.k, r.id, r.v) for r in join_hot(many, few, "k", None).collect()) == want


def test_fit_transform_reads_the_documents_as_fit_and_transform_do(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a c"), (3, None), (4, "the the")], "doc_id long, text string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    one = TF.TfidfModel(["the"], min_df=1, max_n=2)
    two = TF.TfidfModel(["the"], min_df=1, max_n=2).fit(docs)
    assert rows(one.fit_transform(docs)) == rows(two.transform(docs))
    stop = spark.createDataFrame([("the",)], "word string")
    assert rows(TF.TfidfModel(stop, min_df=1, max_n=2).fit_transform(docs)) == rows(two.transform(docs))


def test_terms_that_the_vocabulary_lacks_are_sifted_out(spark):
    """All terms of the vocabulary pass, and few of the others, before anything is counted or exchanged."""
    vocab = spark.range(3000).selectExpr("concat('in ', id) AS term")
    rows = spark.range(60000).selectExpr("id % 7 AS doc_id", "concat(if(id < 3000, 'in ', 'out '), id) AS term")
    kept = [(r.doc_id, r.term) for r in TF.sifted(rows, vocab).collect()]
    inside = [k for k in kept if k[1].startswith("in ")]
    assert len(inside) == len(set(inside)) == 3000 and all(d == int(t[3:]) % 7 for d, t in kept if t.startswith("in "))
    assert len(kept) - 3000 < 57000 / 8
    assert TF.sifted(rows, vocab.limit(0)).count() == 0
    terms = rows.groupBy("doc_id").agg(F.collect_list("term").alias("terms"))
    assert {(r.doc_id, r.term) for r in TF.tfidf_weights(terms, vocab.withColumn("idf", F.lit(1.0))).collect()} == set(inside)


def test_documents_are_weighed_in_partitions_of_bounded_text(spark, monkeypatch):
    """The text of a partition does not grow with the table, however few the shuffle partitions are."""
    monkeypatch.setattr(TF, "PART_BYTES", 1000)
    docs = spark.range(100).selectExpr("id AS doc_id", "repeat('aa bb cc dd ', 50) AS text")
    assert TF.text_partitions(docs) == 60
    model = TF.TfidfModel([], min_df=1, max_n=1).fit(docs)
    seen = []
    plain = TF.tfidf_weights
    monkeypatch.setattr(TF, "tfidf_weights", lambda terms, idf: (seen.append(terms.rdd.getNumPartitions()), plain(terms, idf))[1])
    assert model.transform(docs).count() == TF.TfidfModel([], min_df=1, max_n=1).fit_transform(docs).count() == 400
    assert seen == [60, 60]

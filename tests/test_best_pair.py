"""W6 on packed senses: the same pair as over all sense pairs and ancestors, without a row for either."""

import random

from pairgram.operators import lexnet as W


def _brute(words, lemmas, closure):
    up = {}
    for node, a, d in closure:
        up.setdefault(node, {})[a] = d
    out = set()
    for v, w in words:
        found = []
        for a, s1, r1 in lemmas:
            for b, s2, r2 in lemmas:
                if a == v and b == w and a and b and s1 in up and s2 in up and (met := up[s1].keys() & up[s2].keys()):
                    found.append((min(up[s1][x] + up[s2][x] for x in met), r1, r2, s1, s2, max(max(up[s1][x], up[s2][x]) for x in met)))
        best = min(found, default=None)
        out.add((v, w, best[3], best[4], best[0], best[5]) if best else (v, w, None, None, None, None))
    return out


def test_best_pair_is_found_without_rows_of_sense_pairs(spark, monkeypatch):
    rng = random.Random(11)
    nodes = [f"n{i}" for i in range(14)]
    edges = [(nodes[i], nodes[rng.randrange(i + 1, 14)]) for i in range(12) for _ in range(rng.choice([1, 2]))] + [("lone", "top")]
    words = [f"v{i}" for i in range(9)]
    lemmas = [(w, rng.choice([*nodes, "lone"]), r) for w in words[:7] for r in range(1, rng.choice([2, 4, 5]))]
    lemmas += [("v7", "unknown", 1), ("v0", lemmas[0][1], 1), (None, "n3", 1)]
    pairs = [(a, b) for a in words for b in words] + [("v1", "v2"), (None, "v1"), ("v1", None)]
    closure = W.hypernym_closure(spark.createDataFrame(edges, "child string, parent string"))
    wanted = _brute(pairs, lemmas, [tuple(r) for r in closure.select("node", "ancestor", "dist").collect()])
    for step in ("sense_pairs", "synset_path"):
        monkeypatch.setattr(W, step, lambda *a: 1 / 0)
    found = W.best_synset_pair(spark.createDataFrame(pairs, "word_1 string, word_2 string"),
                               spark.createDataFrame(lemmas, "word string, synset string, rank int"), closure).collect()
    assert {(r.word_1, r.word_2, r.s1, r.s2, r.path, r.h) for r in found} == wanted and len(found) == len(wanted) == 83
    assert all(r.path is None or r.path_similarity == 1 / (1 + r.path) for r in found)


def test_hot_words_meet_their_senses_by_broadcast(spark):
    edges = spark.createDataFrame([("w", "top"), ("x", "top")], "child string, parent string")
    lemmas = spark.createDataFrame([("the", "w", 1), ("a", "x", 1)], "word string, synset string, rank int")
    pairs = spark.range(3000).selectExpr("'the' AS word_1", "concat('q', id) AS word_2").union(
        spark.range(3000).selectExpr("concat('q', id) AS word_1", "'the' AS word_2")).union(spark.sql("SELECT 'the', 'a'"))
    found = W.best_synset_pair(pairs, lemmas, W.hypernym_closure(edges))
    assert found.count() == 6001
    assert [tuple(r)[:6] for r in found.filter("s1 IS NOT NULL").collect()] == [("the", "a", "w", "x", 2, 1)]

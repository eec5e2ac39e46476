import math
import random

import pytest

from pairgram.operators import lexnet as W
from pairgram.operators import sentsim as SS


class Net:
    """Word similarity by definition, one word pair at a time."""

    def __init__(self, edges, lemmas):
        self.up = {}
        for c, p in edges:
            self.up.setdefault(c, set()).add(p)
            self.up.setdefault(p, set())
        self.senses, self.words = {}, {}
        for w, s, r in lemmas:
            self.senses.setdefault(w, []).append((r, s))
            self.words.setdefault(s, set()).add(w)

    def above(self, s):
        if s not in self.up:
            return {}
        dist, layer, d = {s: 0}, {s}, 0
        while layer:
            d += 1
            layer = {p for x in layer for p in self.up[x]} - set(dist)
            dist |= {p: d for p in layer}
        return dist

    def similarity(self, w, v):
        best = None
        for r1, s1 in self.senses.get(w, []):
            for r2, s2 in self.senses.get(v, []):
                a, b = self.above(s1), self.above(s2)
                if both := set(a) & set(b):
                    key = (min(a[x] + b[x] for x in both), r1, r2, s1, s2)
                    found = (key, max(max(a[x], b[x]) for x in both))
                    best = found if best is None else min(best, found)
        if best is None:
            return 0.0
        (path, _, _, s1, s2), h = best
        length = 0 if s1 == s2 else 1 if self.words[s1] & self.words[s2] else path
        return round(math.exp(-0.2 * length) * math.tanh(0.45 * h), 6)

    def most_similar(self, w, words):
        return min(((-self.similarity(w, v), v) for v in words), default=(1.0, ""))


def tables(spark, edges, lemmas):
    return (spark.createDataFrame(lemmas, "word string, synset string, rank int"),
            W.hypernym_closure(spark.createDataFrame(edges, "child string, parent string")))


def sentences(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, sent_1 string, sent_2 string")


def check(spark, edges, lemmas, rows):
    net = Net(edges, lemmas)
    joint = SS.joint_words(sentences(spark, rows))
    got = {(r.conv_id, r.turn, r.side, r.word): (r.sim_word, round(r.similarity, 6))
           for r in SS.most_similar_word(joint, *tables(spark, edges, lemmas)).collect()}
    want = {}
    for c, t, *sents in rows:
        own = [list(dict.fromkeys((s or "").lower().split())) for s in sents]
        for side in (0, 1):
            for w in set(own[1 - side]) - set(own[side]):
                s, v = net.most_similar(w, own[side])
                want[(c, t, side + 1, w)] = (v, round(-s, 6))
    assert got == want


def test_a_nearer_pair_of_shallow_senses_hides_deeper_ones(spark):
    # w and v meet nearer at 'top' (path 2, depth 1) than at 'deep' (path 3, depth 6): the deep senses are not chosen
    edges = [("w1", "top"), ("v1", "top"), ("u1", "mid"), ("mid", "top")]
    chain = ["deep", "d5", "d4", "d3", "d2", "d1", "base"]
    edges += list(zip(chain, chain[1:])) + [("w2", "deep"), ("v2x", "deep"), ("v2", "v2x"), ("x9", "d3")]
    lemmas = [("w", "w1", 1), ("w", "w2", 2), ("v", "v1", 1), ("v", "v2", 2), ("u", "u1", 1), ("x", "x9", 1)]
    rows = [(1, 1, "w", "v u x"), (2, 1, "v", "w"), (3, 1, "x u", "w v"), (4, 1, "w", "v")]
    check(spark, edges, lemmas, rows)
    net = Net(edges, lemmas)
    assert net.similarity("w", "v") == round(math.exp(-0.4) * math.tanh(0.45), 6) < net.similarity("w", "x")


def test_shared_lemmas_and_words_without_senses(spark):
    edges = [("a", "r"), ("b", "c"), ("c", "d"), ("d", "r"), ("e", "r"), ("lone", "other")]
    lemmas = [("x", "a", 1), ("y", "b", 1), ("both", "a", 2), ("both", "b", 1), ("z", "e", 1), ("q", "lone", 1), ("nowhere", "missing", 1)]
    check(spark, edges, lemmas, [(1, 1, "x z", "y q none"), (2, 1, "", "x y"), (3, 1, None, None), (4, 1, "both", "z nowhere"), (5, 1, "none", "nothing at all")])


@pytest.mark.parametrize("seed", range(3))
def test_random_nets_with_many_parents_and_senses(spark, seed):
    draw = random.Random(seed)
    synsets = [f"s{i:02d}" for i in range(40)]
    edges = {(synsets[i], synsets[draw.randrange(max(0, i - 12), i)]) for i in range(1, 40) for _ in range(draw.choice((1, 1, 2, 3)))}
    words = [f"w{i:02d}" for i in range(45)]
    lemmas = sorted({(w, draw.choice(synsets[5:]), r) for w in words[:42] for r in range(1, draw.randrange(1, 5))})
    rows = [(c, t, " ".join(draw.choices(words, k=draw.randrange(30))), " ".join(draw.choices(words, k=draw.randrange(30))))
            for c in range(6) for t in range(1, 3)]
    check(spark, sorted(edges), lemmas, rows)


def test_vectors_and_similarities(spark):
    edges = [("cat", "feline"), ("feline", "animal"), ("dog", "canine"), ("canine", "animal"), ("animal", "root"), ("car", "root")]
    lemmas = [(w, w, 1) for w in ("cat", "dog", "car", "feline")]
    rows = [(1, 1, "cat sat cat", "dog sat"), (2, 1, "cat", "cat"), (3, 1, "one", "two"), (4, 1, "", None), (5, 1, "feline car", "cat car")]
    pairs = sentences(spark, rows)
    freq = spark.createDataFrame([("sat", 3), ("cat", 1)], "word string, n long")
    lem, closure = tables(spark, edges, lemmas)
    joint = SS.joint_words(pairs)
    similar = SS.most_similar_word(joint, lem, closure)
    words = joint.select("word").distinct()
    ic = {w: 1 - math.log(n + 1) / math.log(5) for w, n in (("sat", 3), ("cat", 1), ("dog", 0))}
    sem = {(r.conv_id, r.side, r.word): (r.value, round(r.value_ic, 6)) for r in SS.semantic_vector(
        joint, similar, W.information_content(words, freq, 4)).collect()}
    # cat against {dog, sat}: path 4, depth 3
    assert math.exp(-0.8) * math.tanh(1.35) > 0.2
    assert sem[(1, 2, "cat")] == (0.2, round(0.2 * ic["cat"] * ic["dog"], 6)) and sem[(1, 1, "sat")] == (1.0, round(ic["sat"] ** 2, 6))
    assert sem[(3, 1, "two")] == (0.0, 0.0) and sem[(2, 1, "cat")][0] == 1.0
    order = {(r.conv_id, r.side, r.word): r.value for r in SS.word_order_vector(joint, similar).collect()}
    # 0.3926 is not above 0.4; feline and cat are one step apart at depth 3
    assert [order[(1, k, w)] for k in (1, 2) for w in ("cat", "sat", "dog")] == [1, 2, 0, 0, 2, 3]
    assert order[(5, 2, "feline")] == 3 and order[(5, 1, "cat")] == 1
    got = {r.conv_id: r for r in SS.sentence_similarity(pairs, lem, closure, freq, 4).collect()}
    assert len(got) == 5
    assert got[2].similarity == pytest.approx(1.0) and got[2].similarity_ic == pytest.approx(1.0)
    assert (got[3].semantic, got[3].word_order) == (0.0, pytest.approx(1 - math.sqrt(5) / math.sqrt(5)))
    assert (got[4].semantic, got[4].word_order, got[4].similarity) == (0.0, 1.0, pytest.approx(0.15))
    a, b = (1.0, 1.0, 0.2), (0.2, 1.0, 1.0)
    assert got[1].semantic == pytest.approx(sum(x * y for x, y in zip(a, b)) / sum(x * x for x in a))
    assert got[1].word_order == pytest.approx(1 - math.sqrt(1 + 0 + 9) / math.sqrt(1 + 16 + 9))
    assert all(0 <= r.semantic <= 1 + 1e-9 and 0 <= r.semantic_ic <= 1 + 1e-9 for r in got.values())
    assert all(r.similarity == pytest.approx(0.85 * r.semantic + 0.15 * r.word_order) for r in got.values())


def test_no_group_pairs_all_words(spark, monkeypatch):
    """Long sides under one common root: verified pairs stay near the number of words, not its square."""
    words = [f"{chr(97 + i % 20)}{i}" for i in range(400)]
    edges = [(w, w[0]) for w in words] + [(x, "root") for x in {w[0] for w in words}]
    lemmas = [(w, w, 1) for w in words]
    seen = []
    plain = W.word_similarity
    monkeypatch.setattr(W, "word_similarity", lambda p, *rest: (seen.append(p.count()), plain(p, *rest))[1])
    joint = SS.joint_words(sentences(spark, [(1, 1, " ".join(words[:200]), " ".join(words[200:]))]))
    assert SS.most_similar_word(joint, *tables(spark, edges, lemmas)).count() == 400
    assert sum(seen) <= 2 * 400


def test_no_row_of_a_word_and_an_ancestor_is_written(spark, monkeypatch):
    """Deep chains above every word: the tables of the pairs have a row per joint word and side at most, however many ancestors there are."""
    chain = [f"up{i:02d}" for i in range(30)]
    words = [f"w{i:02d}" for i in range(20)]
    edges = list(zip(chain, chain[1:])) + [(w, "up00") for w in words]
    written = []
    plain = SS.stored
    monkeypatch.setattr(SS, "stored", lambda df, name: (written.append((name, df.count())) if "conv_id" in df.columns else None, plain(df, name))[1])
    joint = SS.joint_words(sentences(spark, [(1, 1, " ".join(words[:10]), " ".join(words[10:]))]))
    found = SS.most_similar_word(joint, *tables(spark, edges, [(w, w, 1) for w in words])).collect()
    assert len(found) == 20 and {r.sim_word for r in found if r.side == 1} == {"w00"}
    assert written and max(n for _, n in written) <= 2 * len(words), written


def _exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return [line for line in plan.splitlines() if "Exchange hash" in line and "Reused" not in line]


def test_words_and_answers_are_brought_to_their_pair_once(spark):
    """Everything after the search is grouped by the pair: one exchange of joint words and answers, none of vectors or of words facing each other."""
    joint = SS.stored(spark.createDataFrame([(1, 1, "cat", 0, None, 1), (1, 1, "dog", None, 0, 2), (1, 1, "sat", 1, 1, 3)],
                                            "conv_id long, turn long, word string, at_1 int, at_2 int, idx int"), "joint")
    similar = SS.stored(spark.createDataFrame([(1, 1, 2, "cat", "dog", 0.9), (1, 1, 1, "dog", "cat", 0.9)],
                                              "conv_id long, turn long, side int, word string, sim_word string, similarity double"), "similar")
    ic = spark.createDataFrame([("cat", 0.5), ("dog", 0.25), ("sat", 1.0)], "word string, ic double")
    rows = SS._aligned(joint, similar, ic)
    vectors, order = SS.semantic_vector(joint, similar, ic, rows), SS.word_order_vector(joint, similar, rows)
    assert {(r.side, r.word): (r.value, r.value_ic) for r in vectors.collect()} == {
        (1, "cat"): (1.0, 0.25), (2, "cat"): (0.2, 0.025), (1, "dog"): (0.2, 0.025), (2, "dog"): (1.0, 0.0625), (1, "sat"): (1.0, 1.0), (2, "sat"): (1.0, 1.0)}
    assert {(r.side, r.word): r.value for r in order.collect()} == {
        (1, "cat"): 1, (2, "cat"): 2, (1, "dog"): 1, (2, "dog"): 2, (1, "sat"): 3, (2, "sat"): 3}
    a, b = SS.semantic_similarity(vectors), SS.word_order_similarity(order)
    assert [len(_exchanges(found)) for found in (a, b, a.join(b, ["conv_id", "turn"]))] == [1, 1, 1]


def test_far_ancestors_pack_to_the_same_bounds(spark):
    """Distances and reaches beyond what a packed row holds leave every bound as it is; nulls stay null."""
    rows = spark.createDataFrame([("w", "a", d, reach) for d, reach in ((0, 0), (3, 7), (255, 255), (256, 300), (5000, 70000))], "word string, a string, d int, reach int")
    got = SS._unpacked(SS.packed_rows(rows).selectExpr("explode(rows) AS code"))
    assert {tuple(r) for r in got.select("d", "reach").collect()} == {(0, 0), (3, 7), (255, 255)} and got.select("a").distinct().count() == 1
    bound = lambda t: sorted(r[0] for r in t.selectExpr("d AS d1", "d AS d2", "reach AS r").select(SS._bound(*[SS.F.col(c) for c in ("d1", "d2", "r", "r")])).collect())
    assert bound(rows) == bound(got)
    assert [tuple(r) for r in SS._unpacked(spark.sql("SELECT CAST(NULL AS bigint) AS code")).collect()] == [(None, None, None)]


def test_leads_are_found_without_rows_of_words_and_ancestors(spark, monkeypatch):
    """Each asker's lead is the first word of the best group by a search over all groups, in slices of any size; nothing is exploded or windowed."""
    draw = random.Random(8)
    names = [f"w{i}" for i in range(14)] + ["é", "Z", "zz"]
    sense = {w: [(f"a{draw.randrange(4)}", draw.randrange(4), draw.randrange(1, 4)) for _ in range(draw.randrange(1, 4))] for w in names[:-2]}
    sense = {w: sorted(set(r)) for w, r in sense.items()}
    joint = []
    for conv in range(6):
        for i, w in enumerate(draw.sample(names, 12)):
            side = draw.choice([1, 2, 3]) if conv else 1
            joint.append((conv, 1 << 40, w, i if side & 1 else None, i if side & 2 else None, i))
    df = spark.createDataFrame(joint, "conv_id long, turn long, word string, at_1 int, at_2 int, idx int").repartition(3)
    packed = SS.packed_rows(spark.createDataFrame([(w, *r) for w, rows in sense.items() for r in rows], "word string, a string, d int, reach int"))
    bound = lambda x, y: round(math.exp(-W.ALPHA * (x[1] + y[1])) * math.tanh(W.BETA * max(x[2], y[2])), 6)
    want = set()
    for conv, turn, word, at_1, at_2, _ in joint:
        for side in (1, 2):
            if (at_1, at_2)[side - 1] is None:
                there = sorted((r[2] for r in joint if r[0] == conv and r[2 + side] is not None), key=str.encode)
                met = [(-bound(x, y), v) for v in there for x in sense.get(word, []) for y in sense.get(v, []) if x[0] == y[0]]
                b, v = min(met, key=lambda m: (m[0], m[1].encode())) if met else (None, None)
                want.add((conv, turn, side, word, there[0] if there else None, v, None if b is None else -b))
    for most in (SS.BOUNDS, 3):
        monkeypatch.setattr(SS, "BOUNDS", most)
        leads = SS._leads(df, packed)
        assert {tuple(r) for r in leads.collect()} == want and leads.count() == len(want)
    plan = leads._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan

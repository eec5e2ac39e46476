import random
from collections import defaultdict

from pairgram.llm import mixing

from helpers import awkward, documents


def targets(sizes):
    """Cap, reshare the excess by weight, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        rest = total - sum(held.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return held | share
        held |= {s: 3.0 * sizes[s] for s in above}


def many(n, seed=1):
    random.seed(seed)
    names = ["a", "b", "B", "é", "\U0001f600", "￿", None]
    return [(i, "w " * random.choice([0, 1, 3, 10, 40]), None, random.choices(names, [40, 20, 1, 10, 5, 5, 5])[0]) for i in range(n)]


def test_targets_and_taken_words(spark):
    rows = many(3000)
    out = mixing.mix_plan(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    source = {r[0]: r[3] for r in rows}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += r[1].count("w")
    want, taken = targets(dict(sizes)), defaultdict(int)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        assert r.taken == r.size * r.copies and r.taken <= 3 * r.size
        assert r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1)
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 40 + 1e-6, (s, taken[s], t)
    again = mixing.mix_plan(documents(spark, rows).repartition(3)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_levels_of_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    rows = many(500, 2)
    taken, target, source = defaultdict(int), {}, {r[0]: r[3] for r in rows}
    for r in mixing.mix_plan(documents(spark, rows)).collect():
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(v - target[s]) <= 40 + 1e-6 for s, v in taken.items())


def test_expectations_hold(spark):
    """Each document is taken its share on average over seeds."""
    rows = [(i, "w " * (i % 5 + 1), None, "ab"[i % 2]) for i in range(12)]
    docs = documents(spark, rows).cache()
    total, runs = defaultdict(int), 6
    for seed in range(runs):
        for r in mixing.mix_plan(docs, seed).collect():
            total[r.doc_id] += r.copies
    shares = {r.doc_id: r.target / r.source_size for r in mixing.mix_plan(docs).collect()}
    assert all(abs(total[d] / runs - s) < 0.9 for d, s in shares.items())


def test_repeated_rows_are_one_entry(spark):
    rows = [(1, "one two three", None, "a")] * 400 + [(2, "x y", None, "b"), (3, "x", None, "b")]
    out = mixing.mix_plan(documents(spark, rows)).collect()
    assert len(out) == 402
    per = [r.copies for r in out if r.doc_id == 1]
    want = next(r.target for r in out if r.doc_id == 1)
    assert max(per) - min(per) <= 1 and abs(3 * sum(per) - want) <= 3
    mixed = mixing.mix(documents(spark, rows))
    assert mixed.filter("doc_id = 1").count() == sum(per)


def test_awkward_rows(spark):
    rows = awkward(500)
    docs = documents(spark, rows)
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(rows) and all(r.taken <= 3 * r.size for r in plan)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in plan)
    assert mixing.mix_plan(documents(spark, [])).count() == 0 and mixing.mix(documents(spark, [])).count() == 0
    blank = mixing.mix_plan(documents(spark, [(1, "", None, "a"), (2, None, None, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2

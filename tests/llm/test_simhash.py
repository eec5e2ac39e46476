import random

import numpy as np
import xxhash
from pairgram.llm import simhash

from helpers import awkward, documents


def naive(text, k=3):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, bits=2):
    """(smallest id reachable) per row, all pairs."""
    fps = sorted(set(f for _, f in prints))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if bin(a ^ b).count("1") <= bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [least.get(find(f)) for _, f in prints]


def test_fingerprint_is_the_definition():
    for t in ["", None, "One", "a B", "a b c", "A b c d a b c", "é É ü\x0bq\x1fz w", " \t", "the " * 9000 + "end"]:
        assert simhash.fingerprint(t) == naive(t), t


def test_golay_words_within_two_bits_share_an_index():
    random.seed(5)
    golay = simhash.Golay()
    assert len(set(golay.code.tolist())) == 4096
    words = np.array([random.getrandbits(23) for _ in range(3000)], dtype=np.int64)
    for w, own in zip(words.tolist(), golay.indices(words)):
        assert len(own) in (1, 6)
        a, b = random.sample(range(23), 2)
        for other in golay.indices(np.array([w ^ 1 << a, w ^ 1 << a ^ 1 << b])):
            assert set(own.tolist()) & set(other.tolist())


def near_prints(spark, n=400):
    random.seed(11)
    seeds = [random.getrandbits(64) for _ in range(25)]
    out = []
    for i in range(n):
        f = random.choice(seeds)
        for _ in range(random.choice([0, 1, 1, 2, 3, 4])):
            f ^= 1 << random.randrange(64)
        out.append((i, f))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in out]
    return out, spark.createDataFrame(signed, "doc_id long, fp long")


def check_classes(spark, bits=2):
    out, df = near_prints(spark)
    found = {r.fp % (1 << 64): r.component_id for r in simhash.classes(df, bits).collect()}
    assert [found[f] for _, f in out] == classes(out, bits)


def test_classes_from_pairs(spark):
    check_classes(spark)


def test_classes_from_full_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 1)
    check_classes(spark)
    check_classes(spark, 1)


def test_refined_keys_lose_no_pair(spark, monkeypatch):
    random.seed(12)
    # all equal in the first segment: its keys fill up, the refined ones hardly do
    tops = [random.getrandbits(40) << 23 for _ in range(60)]
    prints = [(i, random.choice(tops) ^ (1 << random.randrange(23, 63)) ^ random.choice((0, 1 << random.randrange(23, 63)))) for i in range(300)]
    df = spark.createDataFrame(prints, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "BUCKET", 8)
    found = {r.fp: r.component_id for r in simhash.classes(df).collect()}
    assert [found[f] for _, f in prints] == classes(prints)
    keys = simhash.refined_keys(simhash.fuzzy_keys(df.select("fp").distinct()))
    held = {}
    for r in keys.collect():
        held.setdefault(r.key, set()).add(r.fp)
    together = {(a, b) for fps in held.values() for a in fps for b in fps if a < b}
    fps = sorted({f for _, f in prints})
    assert all((a, b) in together for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 2)


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_awkward_rows(spark):
    rows = awkward(3_000)
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = [(r[0], naive(r[1])) for r in rows]
    want = [(d, f"{f:016x}", c) for (d, f), c in zip(prints, classes(prints))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_one_document_of_each_component_stays(spark):
    rows = awkward(3_000)
    docs = documents(spark, rows)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    prints = {naive(r[1]) for r in rows}
    assert len(out) == len(set(classes([(i, f) for i, f in enumerate(sorted(prints))])))
    assert [r.doc_id for r in out if r.text and r.text.startswith("The quick")] == [1]
    assert simhash.deduplicate(documents(spark, [])).count() == 0


def test_null_ids_do_not_merge_components(spark):
    rows = [(None, "alpha beta gamma delta"), (None, "one two three four five six"), (None, "alpha beta gamma delta")]
    assert simhash.deduplicate(documents(spark, rows)).count() == 2

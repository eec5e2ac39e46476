import random

import numpy as np
import pytest
from pairgram.llm import suffixes

from helpers import awkward, documents


def brute(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def run(spark, rows, **named):
    out = suffixes.remove_duplicates(documents(spark, rows).repartition(3), **named).collect()
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in out)


def want(rows, length):
    return sorted(str((r[0], *b)) for r, b in zip(rows, brute([(r[1] or "").encode() for r in rows], length)))


def corpus(seed=3):
    random.seed(seed)
    text = lambda n: "".join(random.choice("abcdefgh é") for _ in range(n))
    shared = [text(random.randint(15, 90)) for _ in range(6)]
    out = ["".join(text(random.randint(0, 40)) + (random.choice(shared) if random.random() < 0.6 else "") for _ in range(random.randint(1, 5))) for _ in range(60)]
    return list(enumerate(out + ["a" * 100, "ab" * 60, "", "x", out[0], out[5] + "é", text(30)]))


def test_loser_tree_merges_with_prefixes():
    random.seed(3)
    for _ in range(200):
        runs = [sorted(bytes(random.choice(b"ab") for _ in range(random.randint(0, 9))) for _ in range(random.randint(0, 12))) for _ in range(random.randint(1, 7))]
        got = [(x, n) for _, _, x, n in suffixes.LoserTree([suffixes.front_code(r) for r in runs])]
        assert [x for x, _ in got] == sorted(sum(runs, []))
        for (a, _), (b, n) in zip([(b"", 0), *got], got):
            assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("length, gram, crowd", [(24, 6, 1000), (24, 6, 2), (30, 8, 5)])
def test_against_all_windows(spark, length, gram, crowd):
    rows = corpus()
    assert run(spark, rows, length=length, gram=gram, crowd=crowd) == want(rows, length)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 64)
    rows = corpus(8)[:25]
    got = []
    for r, t in zip(rows, brute([x[1].encode() for x in rows], 24)):
        got.append(t)
    hasher, texts = suffixes.Hasher(4096), [r[1].encode() for r in rows]
    seen = {}
    for size in (64, 4000):
        monkeypatch.setattr(suffixes, "PIECE", size)
        starts = set()
        for d, t in enumerate(texts):
            for at in range(0, len(t) - 23, size):
                found = suffixes.runs([t[at:at + size + 23]], hasher, 24, 6)
                for b, n in zip(found["begin"], found["n"]) if found else ():
                    starts |= {(d, at + b + i) for i in range(n)}
        seen[size] = starts
    assert seen[64] == seen[4000] == {(d, i) for d, t in enumerate(texts) for i in range(len(t) - 23)}


def test_equal_windows_have_equal_anchors():
    random.seed(6)
    shared = bytes(random.choice(b"abcd") for _ in range(300))
    a, b = b"xyz" * 50 + shared + b"q" * 90, b"klm" * 70 + shared
    anchors = []
    for t in (a, b):
        found = suffixes.runs([t], suffixes.Hasher(4096))
        at = {}
        for begin, n, lead, h in zip(found["begin"], found["n"], found["lead"], found["anchor"]):
            for i in range(n):
                at[t[begin + i:begin + i + 200]] = (h, begin + lead - begin - i)
        anchors.append(at)
    both = set(anchors[0]) & set(anchors[1])
    assert len(both) >= 101 and all(anchors[0][w] == anchors[1][w] for w in both)


def test_awkward_rows(spark):
    rows = awkward(4_000)
    assert run(spark, rows) == want(rows, 200)
    assert run(spark, rows, length=40, gram=8) == want(rows, 40)
    assert suffixes.remove_duplicates(documents(spark, [])).count() == 0


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = suffixes.remove_duplicates(docs).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in out) == want(rows, 200)


def test_sliding_min():
    x = np.random.default_rng(2).integers(0, 50, 300)
    assert suffixes.sliding_min(x, 7).tolist() == [int(x[i:i + 7].min()) for i in range(294)]

import hashlib
import math
import random
import zlib

import pyarrow as pa
from pairgram.llm import resample
from pairgram.llm.common import slices

from helpers import awkward, documents
from test_decontaminate import norm


def grams(text, longest):
    w = norm(text)
    return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    at = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for g in grams(text, longest):
            s[at(g)] += 1
    for text in target:
        for g in grams(text, longest):
            t[at(g)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for d, text in docs:
        f = grams(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[at(g)] for g in f)
        out.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(norm(text)) >= least, None])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(([*r[:4], r[5]] for r in out), key=str)


def run(spark, docs, target, **how):
    df = resample.resample(documents(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), **how)
    return sorted(([r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in df.collect()), key=str)


def corpus(n=300):
    draw = random.Random(1)
    words = [f"w{i}" for i in range(200)] + ["Über", "漢字", "UPPER"]
    docs = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 60)))) for i in range(n)]
    return docs, [" ".join(draw.choices(words[:50], k=30)) for _ in range(20)]


def test_unigrams_and_longer_grams(spark):
    docs, target = corpus()
    for longest, buckets in ((1, 10_000), (2, 10_000), (3, 97)):
        assert run(spark, docs, target, longest=longest, buckets=buckets, percent=25) == brute(docs, target, longest, buckets, percent=25)


def test_target_like_documents_are_drawn_more_often(spark):
    docs, target = corpus()
    draw = random.Random(2)
    docs += [(1000 + i, " ".join(draw.choices(target, k=1))) for i in range(30)]
    drawn = [d for d, *_, rank in run(spark, docs, target) if rank]
    assert sum(d >= 1000 for d in drawn) > len(drawn) * 0.8


def test_slices_hold_whole_texts():
    texts = pa.array(["a" * 10, None, "", "b" * 100, "c", "d"])
    parts = [p.to_pylist() for p in slices(texts, 12)]
    assert parts == [["a" * 10, None, ""], ["b" * 100], ["c", "d"]]
    assert sum(map(len, slices(pa.array([], pa.string())))) == 0


def test_awkward_documents(spark):
    docs = [(r[0], r[1]) for r in awkward()]
    got, want = run(spark, docs, ["the quick brown fox", None, ""], percent=100), brute(docs, ["the quick brown fox"], percent=100)
    assert got == want
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], ["x"]) == []
    copies = [(9, " ".join(f"w{i}" for i in range(20)))] * 50 + [(None, " ".join(f"v{i}" for i in range(30)))]
    got = run(spark, copies, ["w1"], percent=100)
    assert sorted(r[4] for r in got) == list(range(1, 52))
    kept = resample.resample(documents(spark, docs), documents(spark, docs[:2]).select("text"))
    assert {"text", "lang", "fp", "score", "rank"} <= set(kept.columns)

import numpy as np

from pairgram.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, extra string, h string"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", "y") for i, v in rows],
                                 SCHEMA.replace("float", kind))


def brute(rows, k, every=20):
    ok = [(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ok = list(dict.fromkeys((i, tuple(np.float32(v).tolist())) for i, v in ok))
    out = {}
    for i, v in ok:
        if i % every == 0:
            near = sorted((-float(np.dot(np.float64(v), np.float64(w))), j) for j, w in ok if len(w) == len(v) and (j, w) != (i, v))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def run(spark, rows, k=20, **how):
    df = table(spark, rows)
    return found(hnsw.search(hnsw.build_index(df, k, **how), df.filter("vec_id % 20 = 0"), k))


def recall(got, want):
    hits = sum(len({j for j, _ in want[q]} & {j for j, _ in got.get(q, [])}) for q in want)
    return hits / sum(map(len, want.values()))


def test_recall_and_scores_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(4000, 32)).astype(np.float32).tolist())]
    want, got = brute(rows, 20), run(spark, rows, shards=2)
    assert recall(got, want) >= 0.95
    exact = {i: np.float64(np.float32(v)) for i, v in rows}
    for q, near in got.items():
        assert len(near) == 20 and q not in dict(near)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - exact[q] @ exact[j]) < 1e-9 for j, s in near)


def test_clusters_of_near_copies_and_norms_of_all_sizes(spark):
    rng = np.random.default_rng(4)
    far = rng.normal(size=(1500, 16)) * np.exp(rng.normal(size=(1500, 1)))
    near = rng.normal(size=(1, 16)) + 1e-3 * rng.normal(size=(1500, 16))
    rows = [(i, v) for i, v in enumerate(np.concatenate([far, near]).astype(np.float32).tolist())]
    assert recall(run(spark, rows, shards=1), brute(rows, 20)) >= 0.9


def test_a_vector_of_a_third_of_the_rows(spark):
    rng = np.random.default_rng(5)
    hot = [1.0, 0.5, -0.5, 0.25]
    rows = [(i, hot if i % 3 == 0 else v) for i, v in enumerate(rng.normal(size=(600, 4)).astype(np.float32).tolist())]
    df = table(spark, rows)
    assert max(len(r.ids) for r in hnsw.build_index(df).collect()) == 21
    rounded = lambda x: {q: [(j, round(s, 9)) for j, s in near] for q, near in x.items()}
    assert rounded(run(spark, rows)) == rounded(brute(rows, 20))


def test_awkward_rows(spark):
    rows = [(0, [1, 0]), (0, [1, 0]), (20, [0, 2]), (1, [1, 1]), (2, [1, 1]), (3, [0, 0]), (4, None), (5, []), (6, [float("nan"), 1]),
            (7, [float("inf"), 1]), (8, [None, 1]), (None, [5, 5]), (40, [1, 2, 3]), (60, [-1, 0, 0, 0]), (80, [1, 1, 1, 1]), (-20, [3, 3]), (1, [0, 1])]
    got = run(spark, rows)
    assert got[0] == [(-20, 3.0), (1, 1.0), (2, 1.0), (1, 0.0), (20, 0.0)]
    assert got[-20] == [(1, 6.0), (2, 6.0), (20, 6.0), (0, 3.0), (1, 3.0)]
    assert 40 not in got and got[60] == [(80, -1.0)] and got[80] == [(60, -1.0)]
    assert run(spark, []) == {}
    assert run(spark, rows, k=1)[0] == [(-20, 3.0)]


def test_doubles_and_blocks_of_queries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate((1e200 * rng.normal(size=(300, 5))).tolist())]
    df = table(spark, [(i, [x * 1e-120 for x in v]) for i, v in rows], "double")
    index = hnsw.build_index(df, 5, shard_bytes=2000)
    assert index.select("shard").distinct().count() == 8
    got = found(hnsw.search(index, df.filter("vec_id % 20 = 0"), 5, block=4))
    exact = np.array([v for _, v in rows]) * 1e-120
    for q, near in got.items():
        s = exact @ exact[q]
        s[q] = -np.inf
        assert [j for j, _ in near] == np.argsort(-s, kind="stable")[:5].tolist()


def test_index_is_flat_and_links_are_near(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(500, 8)).astype(np.float32).tolist())]
    index = hnsw.build_index(table(spark, rows), shards=1, m=8).orderBy("node").collect()
    assert [r.node for r in index] == list(range(500)) and max(r.level for r in index) >= 1
    assert all(len(r.links) == (2 + r.level) * 8 for r in index)
    top = {r.node: r.level for r in index}
    for r in index:
        assert all(j == -1 or top[j] >= 1 for j in r.links[16:]) and r.node not in r.links
        assert len({j for j in r.links[:16] if j >= 0}) == sum(j >= 0 for j in r.links[:16]) > 0

import random

from pyspark.sql import functions as F

from pairgram.functions import editdist
from pairgram.functions.editdist import nlevenshtein, nlevenshtein_many


def brute(s1, s2):
    """Textbook DP carrying (distance, longest alignment among optimal ones)."""
    if s1 == s2:
        return 0.0
    if not s1 or not s2:
        return 1.0
    n, m = len(s1), len(s2)
    D = [[0] * (m + 1) for _ in range(n + 1)]
    L = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        D[i][0] = L[i][0] = i
    for j in range(m + 1):
        D[0][j] = L[0][j] = j
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            c = [(D[i - 1][j] + 1, L[i - 1][j] + 1), (D[i][j - 1] + 1, L[i][j - 1] + 1),
                 (D[i - 1][j - 1] + (s1[i - 1] != s2[j - 1]), L[i - 1][j - 1] + 1)]
            d = min(x[0] for x in c)
            D[i][j] = d
            L[i][j] = max(x[1] for x in c if x[0] == d)
    return D[n][m] / L[n][m]


def test_matches_brute_force_and_properties():
    rng = random.Random(7)
    A = [[rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(300)]
    B = [[rng.choice("abc") for _ in range(rng.randint(0, 11))] for _ in range(300)]
    got = nlevenshtein_many(A, B)
    back = nlevenshtein_many(B, A)
    for a, b, g, h in zip(A, B, got, back):
        assert abs(g - brute(a, b)) < 1e-12
        assert abs(g - h) < 1e-12
        assert 0.0 <= g <= 1.0
    assert list(nlevenshtein_many([["x", "y"]], [["x", "y"]])) == [0.0]


def test_udf_on_spark(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), ([], ["a"]), ([], [])], "a array<string>, b array<string>")
    got = [r.d for r in df.select(nlevenshtein(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [brute(["a", "b", "c"], ["a", "c"]), 1.0, 0.0]


def test_operator_on_fixture_matches_brute_force(spark):
    """Whole conversation turns of sf0.001, word and POS families, against the brute-force DP."""
    from pairgram.operators import grams as G
    from pairgram.operators.distance import edit_distance
    from pairgram.plans.features import tagged_pairs

    pairs = tagged_pairs(spark, "/root/testdata/sf0.001")
    fams = ["word1", "word2", "pos1", "char1"]
    got = {(r.conv_id, r.turn, r.family): r.levenshtein for r in edit_distance(pairs, fams).collect()}
    base = G.with_base_arrays(pairs, fams)
    arrays = base.select("conv_id", "turn", *[G.family_array(f, s).alias(f"{f}_{s}") for f in fams for s in (1, 2)]).collect()
    assert len(got) == len(arrays) * len(fams)
    for r in arrays:
        for f in fams:
            a, b = r[f"{f}_1"], r[f"{f}_2"]
            if f == "char1" and len(a) * len(b) > 40000:
                continue  # keep the pure-Python reference quick
            assert abs(got[(r.conv_id, r.turn, f)] - round(brute(a, b), 6)) < 1e-9


def test_stacks_do_not_pad_to_the_longest(monkeypatch):
    """The cells that are swept stay near those asked for, whatever lengths share a batch; nulls, ties and long lists included."""
    draw = random.Random(5)
    swept = []
    plain = editdist._sweep
    monkeypatch.setattr(editdist, "_sweep", lambda g: (swept.append(len(g) * max(len(a) for a, _ in g) * max(len(b) for _, b in g)), plain(g))[1])
    pairs = [(draw.choices("abcd", k=draw.choice((3, 40, 400))), draw.choices("abcd", k=draw.choice((5, 60, 900)))) for _ in range(300)]
    got = nlevenshtein_many(*map(list, zip(*pairs)))
    assert sum(swept) <= 2 * sum(len(a) * len(b) for a, b in pairs)
    assert all(abs(g - brute(a, b)) < 1e-12 for g, (a, b) in list(zip(got, pairs))[:25])
    assert list(nlevenshtein_many([None, [], None, ["a", None]], [None, ["x"], ["y"], ["a", None]])) == [0.0, 1.0, 1.0, 0.0]

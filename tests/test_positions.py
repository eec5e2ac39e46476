import statistics

from pairgram.operators import grams as G
from pairgram.operators.positions import position_stats

# 1-based positions of the tokens that the other side also has, per edge row and side; the token count.
EXPECTED = {
    (1, 1): ([], 0), (1, 2): ([], 0), (2, 1): ([], 1), (2, 2): ([], 0), (3, 1): ([1, 2, 3], 3), (3, 2): ([1, 2], 2),
    (4, 1): ([1, 2, 3], 3), (4, 2): ([1, 2, 3], 3), (5, 1): ([], 2), (5, 2): ([], 2), (6, 1): ([], 2), (6, 2): ([], 1),
    (7, 1): ([1, 2], 3), (7, 2): ([1, 2], 2), (8, 1): ([], 0), (8, 2): ([], 2), (9, 1): ([1, 2], 2), (9, 2): ([1, 2], 2),
    (10, 1): ([], 6), (10, 2): ([], 6),
}


def test_position_stats_of_the_edge_rows(spark, edge_pairs):
    rows = position_stats(G.gram_table(edge_pairs, ["word1"], tag_cols=None, keep_empty=True)).collect()
    got = {(r.conv_id, r.side): r for r in rows}
    assert len(rows) == len(got) and set(got) == set(EXPECTED)
    for key, (where, n) in EXPECTED.items():
        at = where or [0]
        want = {"min": min(at), "max": max(at), "mean": statistics.mean(at), "median": statistics.median(at), "std": statistics.pstdev(at)}
        for name, v in want.items():
            assert abs(getattr(got[key], f"pos_{name}") - round(v, 6)) < 1e-6, (key, name)
            assert abs(getattr(got[key], f"norm_pos_{name}") - round(v / n if n else 0.0, 6)) < 1e-6, (key, name)

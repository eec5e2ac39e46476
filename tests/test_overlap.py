from collections import Counter
import math

from pyspark.sql import functions as F

from pairgram.operators import grams as G
from pairgram.operators.overlap import overlap_metrics, pair_gram_stats
from tests.test_text import ref_tokens


def metrics_for(spark, edge_pairs, family="word1"):
    gc = G.gram_counts(G.gram_table(edge_pairs.repartition(4, "conv_id", "turn"), [family], tag_cols=None, keep_empty=True))
    return {r.conv_id: r for r in overlap_metrics(pair_gram_stats(gc)).collect()}


def test_word_unigram_metrics_match_python(spark, edge_pairs):
    got = metrics_for(spark, edge_pairs)
    for pid, _, s1, s2 in [tuple(r) for r in edge_pairs.collect()]:
        a, b = ref_tokens(s1), ref_tokens(s2)
        m = got[pid]
        A, B = set(a), set(b)
        ca, cb = Counter(a), Counter(b)
        assert m.count_1 == len(a) and m.count_2 == len(b)
        assert m.unique_1 == len(A) and m.unique_2 == len(B)
        assert m.common == sum((ca & cb).values())
        assert m.count_1_in_2 == sum(1 for w in a if w in B)
        assert abs(m.jaccard - round(len(A & B) / max(1, len(A | B)), 6)) < 1e-9
        dice = 2 * len(A & B) / max(1, len(A) + len(B))
        assert abs(m.dice - round(dice, 6)) < 1e-9
        assert abs(m.sorensen - (round(1 - dice, 6) if A or B else 0.0)) < 1e-6
        norm = math.sqrt(sum(v * v for v in ca.values())) * math.sqrt(sum(v * v for v in cb.values()))
        cos = sum(ca[w] * cb[w] for w in ca) / norm if norm else 0.0
        assert abs(m.cosine - round(cos, 6)) < 1e-9
        p = len(A & B) / len(A) if A else 0.0
        r = len(A & B) / len(B) if B else 0.0
        assert abs(m.precision - round(p, 6)) < 1e-9 and abs(m.recall - round(r, 6)) < 1e-9
        assert m.jaccard <= m.dice + 1e-12


def test_identical_sides(spark, edge_pairs):
    m = metrics_for(spark, edge_pairs)[4]
    assert m.jaccard == 1.0 and m.dice == 1.0 and m.sorensen == 0.0 and m.cosine == 1.0 and m.f1 == 1.0


def test_gram_table_is_partition_local(spark, edge_pairs):
    """After a repartition by the pair key the gram and pair aggregates add no exchange."""
    pairs = edge_pairs.repartition(4, "conv_id", "turn")
    plan = overlap_metrics(pair_gram_stats(G.gram_counts(G.gram_table(pairs, ["word1", "char2"], tag_cols=None))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1


def test_pairs_without_grams_are_zero_rows(spark, edge_pairs):
    m = metrics_for(spark, edge_pairs)[1]
    assert (m.count_1, m.count_2, m.common, m.jaccard, m.sorensen, m.cosine, m.f1) == (0, 0, 0, 0.0, 0.0, 0.0, 0.0)


def turns(spark, folder, n=251):
    rows = [(c, t, "user", f"word{t} and {'x' if t % 2 else 'y'}{c}") for c in (1, 2) for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{folder}/conversations.parquet")


def test_long_conversations_keep_their_pairs_apart(spark, tmp_path):
    from pairgram.plans.registry import QUERIES
    turns(spark, str(tmp_path))
    rows = QUERIES["common_grams"](spark, str(tmp_path)).filter("family = 'word1'").collect()
    assert len(rows) == len({(r.conv_id, r.turn) for r in rows}) == 500 and all(r.common == 1 for r in rows)


def test_pair_queries_shuffle_the_turns_only(spark, tmp_path):
    from pairgram.plans.registry import QUERIES
    turns(spark, str(tmp_path), 5)
    for name in ("jaccard", "tokenize", "position_stats"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "SinglePartition" not in plan, name


def test_six_number_set_vector_properties(spark):
    from pairgram.plans.registry import QUERIES
    rows = QUERIES["ngram_set_features"](spark, "/root/testdata/sf0.001").collect()
    assert rows
    for r in rows:
        assert r.size_small <= r.size_large
        assert r.n_union == r.n_inter + r.n_small_only + r.n_large_only
        assert r.n_small_only == r.size_small - r.n_inter and r.n_large_only == r.size_large - r.n_inter

from pairgram.plans import features as FP
from pairgram.plans import model_plan as MP
from pairgram.sources import fixtures as fx


def written(spark, tmp_path, turns, size=400):
    rows = [(c, t, "user", f"word{c} of turn {t} " * (size // 20)) for c in range(20) for t in range(turns)] + [(None, 0, "user", "x"), (0, None, "user", "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(c, c % 2) for c in range(0, 20, 2)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def parts(df):
    return df.select("conv_id").rdd.getNumPartitions()


def test_pairs_have_bounded_partitions(spark, tmp_path, monkeypatch):
    """Partitions follow the bytes of text, not the few bytes that leave the join, and the grams need no other exchange."""
    monkeypatch.setattr(fx, "PAIR_BYTES", 2000)
    data = written(spark, tmp_path, 20)
    pairs = fx.conversation_pairs(spark, data)
    size = sum(len(r.text.encode()) for r in spark.read.parquet(data + "/conversations.parquet").collect() if r.conv_id is not None and r.turn is not None)
    assert parts(pairs) == -(-size // 2000) > 50
    assert pairs.count() == 20 * 19
    metrics = FP.family_metrics(spark, data, ("word1", "char3"))
    assert parts(metrics) == parts(pairs) and metrics.count() == 2 * 20 * 19
    assert metrics._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_the_wide_frame_writes_no_grams(spark, tmp_path, monkeypatch):
    """Gram rows are neither written nor exchanged: only the labelled pairs are kept."""
    monkeypatch.setattr(fx, "PAIR_BYTES", 4000)
    data = written(spark, tmp_path, 4)
    kept = []
    for name in ("checkpointed", "stored"):
        monkeypatch.setattr(MP, name, lambda d, *rest, f=getattr(MP, name): (kept.append(d.columns), f(d, *rest))[1])
    wide = MP.features_wide(spark, data)
    assert wide.count() == 10 * 3 and len(wide.columns) == 3 + len(MP.dense_feature_names())
    assert kept == [["conv_id", "turn", "trend_id", "raw_1", "raw_2", "sent_1", "sent_2", "tags_1", "tags_2", "label"]]
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Exchange" in line and ("gram" in line or "family" in line)]
    assert wide.filter("word1_jaccard > 0 AND char1_levenshtein > 0 AND word1_1_pos_max > 0").count() == 30

from pairgram.sources.tables import read_table
from pairgram.streaming.turns import stream_turn_features, turn_features


def test_stream_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    streamed = stream_turn_features(spark, sf)
    batch = turn_features(read_table(spark, sf, "conversations"))
    key = ["conv_id", "turn"]
    assert sorted(map(tuple, streamed.orderBy(key).collect())) == sorted(map(tuple, batch.orderBy(key).collect()))
    assert streamed.count() == read_table(spark, sf, "conversations").count()

from pyspark.sql import functions as F

from pairgram.operators import tags as T


def test_parse_and_context(spark):
    df = spark.createDataFrame(
        [(1, 1, "I/O/PRP/B-NP/O ran/O/VBD/B-VP/B-EVENT home/B-geo-loc/NN/B-NP/O", ["i", "ran", "home"]),
         (2, 1, "a/O/DT/B-NP/O", ["a", "b"])],
        "conv_id long, turn long, tags_1 string, tok_1 array<string>")
    df = df.withColumn("tags_2", F.col("tags_1")).withColumn("tok_2", F.col("tok_1"))
    r = df.filter("conv_id = 1").select(T.parse_field(F.col("tags_1"), 2).alias("p"),
                                        T.parse_field(F.col("tags_1"), 1, drop_o=True).alias("n"),
                                        T.parse_field(F.col("tags_1"), 4, drop_o=True).alias("e")).first()
    assert r.p == ["prp", "vbd", "nn"] and r.n == ["b-geo-loc"] and r.e == ["b-event"]
    ctx = T.tag_context(df).filter("side = 1").orderBy("conv_id", "pos").collect()
    # pair 2 has 2 tokens but 1 tag: no rows
    assert [(c.conv_id, c.token, c.left_tag, c.right_tag) for c in ctx] == [
        (1, "i", "phi", "vbd"), (1, "ran", "prp", "nn"), (1, "home", "vbd", "phi")]

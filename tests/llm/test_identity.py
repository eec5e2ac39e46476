"""Rows that differ only in which column is null, and rows with columns that cannot be compared."""

from pyspark.sql import functions as F

from pairgram.llm import decontaminate, mixing, sharding, simhash
from pairgram.llm.common import row_hash

from helpers import documents

TEXT = "one two three four five six seven eight nine ten eleven twelve"
SWAPPED = [(1, TEXT, "x", None), (1, TEXT, None, "x")]


def rows(df):
    return sorted(str((r.doc_id, r.lang, r.source)) for r in df.collect())


def test_swapped_nulls_have_two_keys(spark):
    df = documents(spark, SWAPPED + [(1, TEXT, "x", None)])
    assert df.select(row_hash(df).alias("k")).distinct().count() == 2
    nested = spark.createDataFrame([(1, (None, "x"), [None, "y"]), (1, ("x", None), [None, "y"]), (1, ("x", None), ["y", None])],
                                   "doc_id long, s struct<a:string,b:string>, l array<string>")
    assert nested.select(row_hash(nested).alias("k")).distinct().count() == 3


def test_deduplicate_keeps_one_of_swapped_nulls(spark):
    assert simhash.deduplicate(documents(spark, SWAPPED)).count() == 1
    assert simhash.deduplicate(documents(spark, SWAPPED * 3)).count() == 1


def test_mix_takes_each_as_often_as_planned(spark):
    # null last weighs 2 of 7, the source x 5 of 7; each stops at its target
    docs = documents(spark, SWAPPED)
    plan = {r.target: r.copies for r in mixing.mix_plan(docs).collect()}
    assert mixing.mix(docs).count() == sum(plan.values())
    again = documents(spark, SWAPPED * 2)
    assert mixing.mix(again).count() == sum(r.copies for r in mixing.mix_plan(again).collect())


def test_decontamination_and_shards_tell_them_apart(spark):
    bench = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    docs = documents(spark, [*SWAPPED, (1, None, "x", None), (1, None, None, "x")])
    assert rows(decontaminate.remove_documents(docs, bench)) == rows(documents(spark, [(1, None, "x", None), (1, None, None, "x")]))
    assert decontaminate.report(docs, bench).filter("contaminated").count() == 2
    paged = sharding.shard_rows(documents(spark, SWAPPED * 4), limit=len(TEXT) * 2 + 4)
    assert paged.count() == 8 and paged.groupBy("shard").agg(F.sum("n_bytes").alias("b")).agg(F.max("b")).first()[0] <= len(TEXT) * 2 + 4


def test_map_columns_with_repeated_rows(spark):
    docs = documents(spark, [(1, TEXT, "x", "a")] * 3 + [(2, "other words in here", "x", "a")]).withColumn("m", F.create_map(F.lit("k"), F.col("text")))
    assert simhash.deduplicate(docs).count() == 2
    copies = {}
    for r in mixing.mix_plan(docs).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    got = [r.doc_id for r in mixing.mix(docs).collect()]
    assert {d: got.count(d) for d in copies} == copies
    differ = documents(spark, [(1, TEXT, "x", "a")] * 2).withColumn("m", F.create_map(F.lit("k"), F.monotonically_increasing_id()))
    assert mixing.mix(differ).count() == sum(r.copies for r in mixing.mix_plan(differ).collect())

"""Tab-separated pair files in the reference layout (S1-S3), and the writer used to
produce them from Spark-derived pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from pairgram.session import checkpointed

_TEXT = ["trendname", "origsent", "candsent"]

TRAIN_SCHEMA = StructType(
    [StructField("trendid", LongType())] + [StructField(c, StringType()) for c in _TEXT]
    + [StructField("judge", StringType()), StructField("origsenttag", StringType()),
       StructField("candsenttag", StringType())])

TEST_SCHEMA = StructType(
    [StructField("trendid", LongType())] + [StructField(c, StringType()) for c in _TEXT]
    + [StructField("label", IntegerType()), StructField("origsenttag", StringType()),
       StructField("candsenttag", StringType())])

GOLD_SCHEMA = StructType([StructField("ans", StringType()), StructField("prob", DoubleType())])


def read_tsv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """No header, explicit schema, quoting off (a quote is an ordinary character)."""
    return (spark.read.option("sep", "\t").option("header", "false").option("quote", "")
            .option("escape", "").option("mode", "FAILFAST").schema(schema).csv(path))


def read_train_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, TRAIN_SCHEMA)


def read_test_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, TEST_SCHEMA)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, GOLD_SCHEMA)


def write_tsv(df: DataFrame, path: str) -> None:
    """Write rows as TSV without quoting; text must hold no tab or newline."""
    (df.write.mode("overwrite").option("sep", "\t").option("header", "false")
     .option("quote", "").option("escape", "").option("emptyValue", "").option("nullValue", "")
     .csv(path))


def read_indexed(spark: SparkSession, path: str, schema: StructType, name: str = "row_idx") -> DataFrame:
    """``read_tsv`` plus the 0-based line number over all files of the path.

    Files are taken in the order of their names and their blocks in the order of
    their offsets, however Spark packs them into tasks. Blocks are counted (one small
    row each), the counts' running sum gives each block's first number, and a
    row number inside the block does the rest. Aligns positional files such as the
    gold labels, whose only key is the line number.
    """
    block = (F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    tagged = checkpointed(read_tsv(spark, path, schema).select("*", *block, F.monotonically_increasing_id().alias("_m")))
    counts = tagged.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_f", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_m"))
    return (tagged.join(offsets, ["_f", "_b"]).withColumn(name, F.col("_off") + place - 1)
            .drop("_f", "_b", "_m", "_off"))


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """A stop list with one word per line as a table ``word``: trimmed, lower-cased, distinct, blank lines left out."""
    word = F.lower(F.trim("value")).alias("word")
    return spark.read.text(path).select(word).filter("word != ''").distinct()

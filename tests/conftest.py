import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("pairgram-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pairgram-test-ckpt-"))
    yield s


EDGE_PAIRS = [
    # conv_id, sent_1, sent_2 (turn is 1)
    (1, "", ""),
    (2, "one", ""),
    (3, "a a a", "a a"),
    (4, "the cat sat", "the cat sat"),
    (5, "red blue", "green yellow"),
    (6, "!!! ...", "?"),
    (7, "12 345 6", "345 12"),
    (8, None, "x y"),
    (9, "two words", "words two"),
    (10, "Flies tries bosses running jumped station", "fly tried boss runs jumps stations"),
]


@pytest.fixture(scope="session")
def edge_pairs(spark):
    return spark.createDataFrame([(i, 1, a, b) for i, a, b in EDGE_PAIRS], "conv_id long, turn long, sent_1 string, sent_2 string")

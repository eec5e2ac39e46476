from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pairgram.operators import model as M


def test_grid_search_does_not_depend_on_partitions(spark):
    rows = spark.range(240).select((F.col("id") % 80).alias("conv_id"), F.col("id").alias("turn"),
                                   (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 80 % 2).cast("double").alias("b"),
                                   (F.col("id") % 80 % 2).cast("int").alias("label"))
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    grid = {"maxDepth": [1, 2], "maxIter": [2]}
    found = [sorted(tuple(r) for r in M.grid_search(rows.repartition(n), grid=grid, folds=2).collect()) for n in (1, 5)]
    assert found[0] == found[1]
    assert [r[:4] for r in found[0]] == [(1, 2, 0.01, 2), (2, 2, 0.01, 2)]
    assert all(r[4] == 1.0 for r in found[0]) and [r[5] for r in found[0]] == [True, False]

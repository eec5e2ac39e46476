"""Trees fitted on sparse columns are MLlib's, whatever the blocks and the partitions."""

import random

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import GBTRegressor
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from pairgram.operators import model as M
from pairgram.operators import trees as T

PARAMS = dict(maxIter=5, maxDepth=3, stepSize=0.3)
SCHEMA = StructType([StructField("id", LongType()), StructField("label", DoubleType()), StructField("features", VectorUDT())])


def _rows(spark, classes):
    """Dense and sparse rows; slots of many values, of few, of both signs, mostly zero, of one value and never set."""
    rng, rows = random.Random(3), []
    for i in range(400):
        values = [rng.gauss(0, 1), float(rng.randrange(1, 50)), rng.choice([0, 0, 0, 1, -2]), rng.choice([0] * 9 + [rng.random()]), 7.0, 0.0, rng.choice([0, -rng.random()])]
        y = values[0] + values[2] - 9 * values[3] + values[6] + rng.gauss(0, 0.3)
        v = Vectors.dense(values) if i % 2 else Vectors.sparse(len(values), [(k, x) for k, x in enumerate(values) if x])
        rows.append((i, float(y > 0) if classes else y, v))
    return spark.createDataFrame(rows, SCHEMA)


def _outputs(model, df, *columns):
    return np.array([[x for c in columns for x in np.ravel(np.array(r[c]))] for r in model.transform(df).orderBy("id").select(*columns).collect()], float)


def test_trees_are_those_of_mllib(spark, monkeypatch):
    for classes, kind, fit in ((False, GBTRegressor, M.fit_regressor), (True, GBTClassifier, M.fit_classifier)):
        df = _rows(spark, classes)
        columns = ["prediction", *(["probability", "rawPrediction"] if classes else [])]
        theirs = kind(labelCol="label", featuresCol="features", seed=42, **PARAMS).fit(df.coalesce(1))
        want = _outputs(theirs, df, *columns)
        for block, asked in ((T.BLOCK, T.ROWS_BYTES), (100, T.ROWS_BYTES), (100, 0)):  # on the driver, in jobs, rows asked for
            monkeypatch.setattr(T, "BLOCK", block)
            monkeypatch.setattr(T, "ROWS_BYTES", asked)
            monkeypatch.setattr(T, "SUMS", 1 if block == 100 else T.SUMS)
            ours = fit(df.repartition(3, "id"), **PARAMS)
            assert type(ours) is type(theirs) and ours.numFeatures == theirs.numFeatures and ours.treeWeights == theirs.treeWeights
            assert np.allclose(_outputs(ours, df, *columns), want, rtol=0, atol=1e-9)
            counts = [sorted((r.idx, r.splits) for r in M.split_counts(m, spark).collect()) for m in (ours, theirs)]
            assert counts[0] == counts[1]
            monkeypatch.undo()


def test_of_equal_splits_the_first_slot_wins(spark):
    """Slots that part the rows alike through different values, dealt to partitions in any way."""
    rows = [(i, float(i % 3 == 0), Vectors.dense([0.0, float(i % 3 == 0), -float(i % 3 == 0) * (i + 1), (i % 3 > 0) * 0.1])) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 7):
        model = M.fit_regressor(df.repartition(n, "id"), maxIter=3, maxDepth=2, stepSize=0.1)
        assert [(r.idx, r.splits) for r in M.split_counts(model, spark).collect()] == [(1, 1)]
        assert sorted({r.prediction for r in model.transform(df).collect()}) == [0.0, 1.0]


def test_thresholds_are_candidates_between_neighbours():
    assert T.thresholds(np.array([-1.0, 2.0, 2.0]), 5, 32).tolist() == [-0.5, 1.0]
    assert T.thresholds(np.array([3.0, 3.0]), 2, 32).tolist() == []
    many = T.thresholds(np.arange(1, 6401) / 2, 6400, 32)
    assert len(many) == 31 and np.allclose(np.diff(many), 100)

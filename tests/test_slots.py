"""Slots that trees cannot tell apart are left out of the training rows without a change of the trees."""

import random

import numpy as np
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pairgram.operators import model as M

PARAMS = dict(maxIter=6, maxDepth=3, stepSize=0.3)


def _rows(spark, dense):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        a, b = rng.choice([0, 0, 1, 2, 3]), rng.choice([0, 1, -1])
        # 0 never set, 1 constant, 3 orders the rows as 2, 5 as 4 but for the sign, 7 as 6
        values = [0, 4, a, a * a / 7, b, b + 2 if b else 0, float(i == 9), 5 * float(i == 9), rng.random()]
        v = Vectors.dense(values) if dense else Vectors.sparse(len(values), [(k, x) for k, x in enumerate(values) if x])
        rows.append((i // 2, 1, int(a + b > 1), v))  # keys repeat
    schema = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("label", IntegerType()),
                         StructField("features", VectorUDT())])
    return spark.createDataFrame(rows, schema).coalesce(2)


def test_trees_on_telling_slots_are_those_on_all_slots(spark):
    for dense in (True, False):
        df = _rows(spark, dense)
        slots = M.telling_slots(df)
        assert slots.tolist() == [2, 4, 5, 6, 8]
        few = M.narrowed(df, slots)
        assert few.first().features.size == 5
        for fit in (M.fit_regressor, M.fit_classifier):
            whole, part = fit(df, **PARAMS), fit(few, **PARAMS)
            get = lambda m, rows: [r.prediction for r in m.transform(rows).select("prediction").collect()]
            assert get(whole, df) == get(part, few)
            named = lambda counts: sorted(map(tuple, counts.collect()))
            assert named(M.split_counts(whole, spark)) == named(M.split_counts(part, spark, slots))


def test_rows_without_a_telling_slot_keep_one(spark):
    df = _rows(spark, True).limit(1)
    slots = M.telling_slots(df)
    assert np.array_equal(slots, [0]) and M.narrowed(df, slots).first().features.size == 1

"""Wide feature frame, vector assembly, boosted trees and split importance
(P6, S7, S8, F6, M1-M4, M7).

MLlib's gradient-boosted trees stand in for the reference's booster: same task
and hyper-parameters (depth 4, step 0.01, 100 trees), first-order boosting. They
are fitted by ``operators.trees`` on the slots that are not zero.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pairgram.keys import PAIR
from pairgram.operators import trees
from pairgram.operators.encode import dense_codes
from pairgram.session import checkpointed, shared_dir

GBT_PARAMS = dict(maxDepth=4, stepSize=0.01, maxIter=100, seed=42)


def numeric_columns(df: DataFrame, exclude=(*PAIR, "label")) -> list[str]:
    from pyspark.sql.types import NumericType
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


#: How a vector column is stored: type 0 is sparse.
SPARSE = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def tfidf_blocks(weights: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Index terms by sorted order (distributed dense codes) and gather each
    document's weights into one sparse vector. Returns (doc vectors, term index, size)."""
    index = checkpointed(dense_codes(vocab, "term", "term_idx"))
    size = index.count()
    indexed = weights.join(index, "term")
    per_doc = indexed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term_idx", "weight"))).alias("e"))
    return per_doc.select("doc_id", sparse(size, F.col("e.term_idx"), F.col("e.weight")).alias("tfidf")), index, size


def sparse(size: int, indices, values) -> Column:
    """A sparse vector in its stored form, from arrays sorted by index."""
    return F.struct(F.lit(0).alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values")).cast(SPARSE)


def as_vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    """Stored-form columns as vectors: written, and read back under the vector type.

    The stored form is the vector type's own SQL type (SPARSE); a test holds it against the type, on a full and an empty row.
    """
    path = shared_dir(df.sparkSession, "vectors")
    df.write.parquet(path)
    schema = StructType([StructField(f.name, VectorUDT() if f.name in columns else f.dataType) for f in df.schema.fields])
    return df.sparkSession.read.schema(schema).parquet(path)


def in_stored_form(df: DataFrame, column: str, keys) -> DataFrame:
    """``keys`` (numbers) and the vector column as ``v`` in its stored form: written, and read back."""
    path = shared_dir(df.sparkSession, "stored")
    df.select(*keys, F.col(column).alias("v")).write.parquet(path)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.sparkSession.read.schema(StructType.fromDDL(", ".join([*[f"{k} {types[k]}" for k in keys], f"v {SPARSE}"]))).parquet(path)


def slot_rows(stored: DataFrame, keys) -> DataFrame:
    """``keys, idx, value``: the slots that are not zero of vectors ``v`` in their stored form, one row each."""
    places = F.when(F.col("v.type") == 0, F.col("v.indices")).otherwise(F.sequence(F.lit(0), F.size("v.values") - 1))
    slots = stored.select(*keys, F.explode_outer(F.arrays_zip(places.alias("idx"), F.col("v.values").alias("value"))).alias("s"))
    return slots.select(*keys, F.col("s.idx").cast("long").alias("idx"), F.col("s.value").alias("value")).filter("value != 0")


def matrix_entries(df: DataFrame, column: str = "features", keys=PAIR) -> DataFrame:
    """``conv_id, turn`` (or other keys)``, idx, value``: the slots of a vector column that are not zero, one row each.

    Vectors are read in their stored form: a sparse one (type 0) lists its slots, a dense one (type 1) its values.
    """
    return slot_rows(in_stored_form(df.withColumns({k: F.col(k).cast("long") for k in keys}), column, keys), keys)


def telling_slots(train: DataFrame) -> np.ndarray:
    """The slots that a tree can tell apart on the training rows, ascending.

    MLlib keeps a training row as a dense array of 4 bytes a slot. A slot of one value is never split, and slots that order the rows
    alike (the same rows not zero, the same ranks of their values) get the same bins, so the same gains, of which the first slot
    wins: only that one is kept, and the trees are those of all slots. Ranks are compared by two 64-bit hashes and two counts.
    """
    rows = train.select(F.monotonically_increasing_id().alias("row"), "features")
    ranked = matrix_entries(rows, keys=("row",)).withColumn("rank", F.dense_rank().over(Window.partitionBy("idx").orderBy("value")))
    place = [F.col("row"), F.col("rank"), F.col("value") > 0]
    slots = ranked.groupBy("idx").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("most"), F.bit_xor(F.xxhash64(*place)).alias("a"),
                                      F.bit_xor(F.xxhash64(F.lit("again"), *place)).alias("b"))
    first = slots.filter((F.col("n") < train.count()) | (F.col("most") > 1)).groupBy("n", "most", "a", "b").agg(F.min("idx").alias("idx"))
    kept = np.sort(first.select("idx").toArrow()["idx"].to_numpy())
    return kept if len(kept) else np.zeros(1, np.int64)


def narrowed(df: DataFrame, slots: np.ndarray) -> DataFrame:
    """The rows with these slots of their features only, in their partitions."""
    def take(v):
        at, values = (v.indices, v.values) if isinstance(v, SparseVector) else (np.arange(len(v)), v.toArray())
        to = np.searchsorted(slots, at)
        there = slots[np.minimum(to, len(slots) - 1)] == at
        return SparseVector(len(slots), to[there], values[there])

    return checkpointed(df.withColumn("features", F.udf(take, VectorUDT())("features")))


def assemble(wide: DataFrame, doc_vectors: DataFrame | None, size: int) -> DataFrame:
    """[tfidf(side 1) | tfidf(side 2) | dense features] as one vector column,
    with ``n_features`` and ``nnz`` (slots that are not zero); the columns that became slots are left out. Written once.

    The vector is put together in its stored form. VectorAssembler would name every slot in the column's metadata: an object a slot
    on the driver, and all names again in each file that is written. The names are a table (``feature_names``).
    """
    dense_cols = numeric_columns(wide)
    df = wide.fillna(0.0, subset=dense_cols)
    entry = lambda at, value: F.struct(at.cast("int").alias("idx"), value.cast("double").alias("value"))
    blocks, offset = [], 0
    if doc_vectors is not None:
        for side in (1, 2):
            own = doc_vectors.filter(F.col("doc_id.side") == side).select(
                *[F.col(f"doc_id.{c}").alias(c) for c in PAIR], F.col("tfidf").alias(f"tfidf_{side}"))
            df = df.join(own, list(PAIR), "left")
            v = F.col(f"tfidf_{side}")
            slots = F.zip_with(v["indices"], v["values"], lambda at, value: entry(at + F.lit(offset), value))
            blocks.append(F.coalesce(slots, F.array().cast("array<struct<idx:int,value:double>>")))
            offset += size
    blocks.append(F.array(*[entry(F.lit(offset + i), F.col(c)) for i, c in enumerate(dense_cols)]))
    entries = F.filter(F.concat(*blocks), lambda e: e["value"] != 0)
    n_features = offset + len(dense_cols)
    df = df.withColumn("_entries", entries).withColumn("n_features", F.lit(n_features)).withColumn("nnz", F.size("_entries"))
    df = df.withColumn("features", sparse(n_features, F.col("_entries.idx"), F.col("_entries.value")))
    return as_vectors(df.drop("_entries", "tfidf_1", "tfidf_2", *dense_cols), ["features"])


def feature_names(index: DataFrame | None, size: int, dense_cols: list[str]) -> DataFrame:
    """``idx, name``: offset-correct names for every slot of the assembled vector."""
    spark = (index.sparkSession if index is not None else None)
    parts = []
    if index is not None:
        for side, off in ((1, 0), (2, size)):
            parts.append(index.select((F.col("term_idx") + off).alias("idx"),
                                      F.concat(F.lit(f"tfidf_{side}:"), "term").alias("name")))
    base = 2 * size if index is not None else 0
    dense = spark.createDataFrame([(base + i, n) for i, n in enumerate(dense_cols)], "idx long, name string")
    out = dense
    for p in parts:
        out = p.unionByName(out)
    return out


def write_feature_map(fmap: DataFrame, path: str) -> None:
    """``idx \\t name \\t q`` lines, the booster's feature-map layout."""
    from pairgram.sources.tsv import write_tsv
    write_tsv(fmap.select("idx", "name", F.lit("q").alias("q")), path)


def _fit(estimator, train: DataFrame, label: str, params: dict) -> object:
    """The estimator's model, its trees fitted on the slots that are not zero (``operators.trees``)."""
    if other := set(params) - {"maxDepth", "stepSize", "maxIter", "maxBins", "seed"}:
        raise ValueError(f"not supported: {sorted(other)}")
    numbered = train.select(F.monotonically_increasing_id().alias("row"), F.col(label).cast("double").alias("label"), "features")
    held = in_stored_form(numbered, "features", ("row", "label"))
    size = held.agg(F.max(F.coalesce("v.size", F.size("v.values")))).first()[0]
    rows = held.select("row", "label", F.size("v.values").alias("n"))
    get = estimator.getOrDefault
    found = trees.boosted(rows, slot_rows(held, ("row",)), isinstance(estimator, GBTClassifier), get("maxIter"), get("maxDepth"), get("stepSize"), get("maxBins"))
    return trees.as_model(train.sparkSession, estimator, *found, size)


def fit_classifier(train: DataFrame, label: str = "label", **params) -> object:
    p = dict(GBT_PARAMS)
    p.update(params)
    return _fit(GBTClassifier(labelCol=label, featuresCol="features", **p), train, label, p)


def fit_regressor(train: DataFrame, label: str = "label", **params) -> object:
    p = dict(GBT_PARAMS)
    p.update(params)
    return _fit(GBTRegressor(labelCol=label, featuresCol="features", lossType="squared", **p), train, label, p)


def split_counts(model, spark, slots: np.ndarray | None = None) -> DataFrame:
    """M4: splits per feature index over all trees, read from the saved model's
    node table (internal nodes only), normalised to sum 1, ascending. ``slots`` are
    those of a model on ``narrowed`` rows."""
    path = shared_dir(spark, "gbt-model")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    internal = nodes.filter(F.col("nodeData.leftChild") >= 0)
    counts = internal.groupBy(F.col("nodeData.split.featureIndex").alias("idx")).agg(
        F.count(F.lit(1)).alias("splits"))
    if slots is not None:
        used = [(int(i), int(slots[i])) for i, in counts.select("idx").collect()]
        counts = counts.join(spark.createDataFrame(used, "idx int, slot int"), "idx").select(F.col("slot").alias("idx"), "splits")
    total = counts.agg(F.sum("splits")).first()[0] or 1
    return counts.select("idx", "splits", (F.col("splits") / F.lit(float(total))).alias("fscore"))


#: The reference's grid: one point.
GRID = {"maxDepth": [4], "maxIter": [100], "stepSize": [0.01]}


def grid_search(rows: DataFrame, label: str = "label", folds: int = 3, grid: dict[str, list] | None = None,
                parallelism: int = 2) -> DataFrame:
    """M7: ``maxDepth, maxIter, stepSize, folds, area_under_roc, best``, one row per point of the grid.

    A row's fold is a hash of its conversation, so neither the partitions nor the order of the rows decide it, and
    pairs of one conversation, which share its label, are never on both sides. ``best`` marks the first point of the highest mean.
    """
    grid = GRID | (grid or {})
    gbt = GBTClassifier(labelCol=label, featuresCol="features", seed=42)
    points = ParamGridBuilder()
    for name, values in grid.items():
        points = points.addGrid(gbt.getParam(name), values)
    points = points.build()
    folded = checkpointed(rows.select("features", label, F.pmod(F.xxhash64("conv_id"), F.lit(folds)).cast("int").alias("fold")))
    found = CrossValidator(estimator=gbt, estimatorParamMaps=points, numFolds=folds, foldCol="fold", parallelism=parallelism,
                           evaluator=BinaryClassificationEvaluator(labelCol=label)).fit(folded)
    means = [float(m) for m in found.avgMetrics]
    best = means.index(max(means))
    out = [(*[point[gbt.getParam(name)] for name in grid], folds, mean, i == best) for i, (point, mean) in enumerate(zip(points, means))]
    return rows.sparkSession.createDataFrame(out, "maxDepth int, maxIter int, stepSize double, folds int, area_under_roc double, best boolean")

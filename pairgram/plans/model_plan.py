"""The supervised path: wide features -> assembled vectors -> boosted trees ->
evaluation and split-count importance (reference sections 3.1/3.2)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairgram.keys import PAIR
from pairgram.functions import text as tx
from pairgram.operators import grams as G
from pairgram.operators import labels as L
from pairgram.operators import model as M
from pairgram.operators.distance import edit_distance
from pairgram.operators.overlap import overlap_metrics, pair_gram_stats
from pairgram.operators.positions import STATS, position_stats
from pairgram.plans.features import tagged_pairs
from pairgram.session import checkpointed, shared_dir, stored
from pairgram.sources import tsv
from pairgram.sources.fixtures import pair_partitions
from pairgram.sources.tables import read_table

OVERLAP_FAMILIES = G.WORD_FAMILIES + G.CHAR_FAMILIES + G.POS_FAMILIES
OVERLAP_METRICS = ["count_1", "count_2", "unique_1", "unique_2", "unique_ratio_1", "unique_ratio_2",
                   "count_1_in_2", "count_2_in_1", "ratio_1_in_2", "ratio_2_in_1", "common",
                   "jaccard", "dice", "sorensen", "cosine", "precision", "recall", "f1"]
DIGIT_FAMILIES = ("word1", "stem1")
DIGIT_METRICS = ["digit_count_1", "digit_count_2", "digit_ratio_1", "digit_ratio_2"]
POSITION_METRICS = [f"{p}{s}" for s in STATS for p in ("pos_", "norm_pos_")]
EDIT_FAMILIES = G.WORD_FAMILIES + G.CHAR_FAMILIES + G.POS_FAMILIES
TAG_COMMON = ("event1", "ner1")


def dense_feature_names() -> list[str]:
    """Column order of the wide frame (a fixed spec, also used by the oracle)."""
    names = [f"{f}_{m}" for f in OVERLAP_FAMILIES for m in OVERLAP_METRICS]
    names += [f"{f}_{m}" for f in DIGIT_FAMILIES for m in DIGIT_METRICS]
    names += [f"{f}_{m}" for f in TAG_COMMON for m in ["common"]]
    names += [f"{f}_{s}_{m}" for f in G.WORD_FAMILIES for s in (1, 2) for m in POSITION_METRICS]
    names += [f"{f}_levenshtein" for f in EDIT_FAMILIES]
    names += ["missing_1", "missing_2"]
    return names


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged pairs whose conversation has a row in ``labels``: the target is its quality, which no feature
    is made from. Written once, so the feature branches below do not recompute the pairing, and dealt by the pair key
    before any text is taken apart, so that they stay in their partitions."""
    n = pair_partitions(read_table(spark, sf_dir, "conversations", ["text"]))
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality"]).filter("quality IS NOT NULL")
    labels = labels.groupBy(F.col("doc_id").alias("conv_id")).agg(F.max("quality").cast("int").alias("label"))
    return stored(tagged_pairs(spark, sf_dir).join(labels, "conv_id"), "labelled_pairs").repartition(n, *PAIR)


def _cells(df: DataFrame, prefix: list[str], metrics: list[str]) -> DataFrame:
    """``conv_id, turn, name, value``: one row per metric, named as the wide frame's column."""
    name = lambda m: F.concat_ws("_", *[F.col(c).cast("string") for c in prefix], F.lit(m))
    return df.select(*PAIR, F.inline(F.array(*[F.struct(name(m).alias("name"), F.col(m).cast("double").alias("value")) for m in metrics])))


def features_wide(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    """The gram table feeds the overlap and the position features; it is many times the texts, so each makes it again from
    the pairs in their partitions and none writes or exchanges it. A block's features are rows until its pivot, and the
    blocks meet on the pair key, all in the partitions of the pairs."""
    pairs = pairs if pairs is not None else labelled_pairs(spark, sf_dir)
    met = overlap_metrics(pair_gram_stats(G.gram_counts(G.gram_table(pairs, OVERLAP_FAMILIES + TAG_COMMON, keep_empty=True))))
    positions = position_stats(G.gram_table(pairs, G.WORD_FAMILIES, keep_empty=True))
    missing = pairs.select(*PAIR, *L.missing_flags(tx.word_punct_tokens("sent_1"), tx.word_punct_tokens("sent_2")))
    names = dense_feature_names()
    of = lambda *families, ends: [n for n in names if n.startswith(tuple(f"{f}_" for f in families)) and n.endswith(ends)]
    placed = of(*G.WORD_FAMILIES, ends=tuple(f"_{k}_{m}" for k in (1, 2) for m in POSITION_METRICS))
    edits = of(*EDIT_FAMILIES, ends="_levenshtein")
    flags = ["missing_1", "missing_2"]
    blocks = [(_cells(met, ["family"], OVERLAP_METRICS + DIGIT_METRICS), [n for n in names if n not in {*placed, *edits, *flags}]),
              (_cells(positions, ["family", "side"], POSITION_METRICS), placed),
              (_cells(edit_distance(pairs, EDIT_FAMILIES), ["family"], ["levenshtein"]), edits),
              (_cells(missing, [], flags), flags)]
    wide = pairs.select(*PAIR, "label")
    for cells, own in blocks:
        wide = wide.join(cells.groupBy(*PAIR).pivot("name", own).agg(F.first("value")).hint("merge"), list(PAIR), "left")
    return wide.select(*PAIR, "label", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names])


def assembled(spark: SparkSession, sf_dir: str):
    """Returns (assembled frame, feature-name table)."""
    from pairgram.plans.registry import fit_documents, tfidf_model
    pairs = labelled_pairs(spark, sf_dir)
    wide = features_wide(spark, sf_dir, pairs)
    model = tfidf_model()
    weights = model.fit_transform(fit_documents(spark, sf_dir))
    vectors, index, size = M.tfidf_blocks(weights, model.vocab)
    out = M.assemble(wide, vectors, size).select(*PAIR, "label", "features", "n_features", "nnz")
    return out, M.feature_names(index, size, dense_feature_names())


def _split(df: DataFrame):
    """Four fifths and one fifth by the pair key, whatever the partitions (the dense slots of the vectors are row-local)."""
    part = F.pmod(F.col("conv_id") * 31 + F.col("turn") * 17, F.lit(5))
    return df.filter(part != 0), df.filter(part == 0)


def q_features_wide(spark, sf_dir):
    return features_wide(spark, sf_dir)


def q_assemble(spark, sf_dir):
    df, _ = assembled(spark, sf_dir)
    return df.select(*PAIR, "label", "n_features", "nnz")


def q_feature_matrix(spark, sf_dir):
    """The sparse matrix read from the assembled vectors: ``conv_id, turn, idx, value`` of every slot
    that is not zero, but for the edit distances (queries of their own; characters are beyond SQL)."""
    df, names = assembled(spark, sf_dir)
    kept = names.filter(~F.col("name").endswith("_levenshtein")).select("idx")
    return M.matrix_entries(df).join(kept, "idx").select(*PAIR, "idx", "value")


def q_feature_map(spark, sf_dir):
    """The offset-correct feature map, written to the shared folder as
    ``idx \t name \t q`` and read back."""
    from pairgram.operators.encode import dense_codes
    from pairgram.plans.registry import fitted_tfidf
    index = checkpointed(dense_codes(fitted_tfidf(spark, sf_dir).vocab, "term", "term_idx"))
    names = M.feature_names(index, index.count(), dense_feature_names())
    path = shared_dir(spark, "feature-map")
    M.write_feature_map(names, path)
    return tsv.read_tsv(spark, path, StructType.fromDDL("idx long, name string, q string"))


def q_gbt_predict(spark, sf_dir):
    df, _ = assembled(spark, sf_dir)
    train, test = _split(df)
    slots = M.telling_slots(train)
    model = M.fit_classifier(M.narrowed(train, slots))
    p1 = vector_to_array("probability")[1]
    return model.transform(M.narrowed(test, slots)).select(*PAIR, "label", F.col("prediction").cast("int").alias("prediction"),
                                        p1.alias("probability_1"))


def q_gbt_regress(spark, sf_dir):
    df, _ = assembled(spark, sf_dir)
    train, test = _split(df)
    slots = M.telling_slots(train)
    model = M.fit_regressor(M.narrowed(train, slots))
    return model.transform(M.narrowed(test, slots)).select(*PAIR, "label", "prediction")


def q_grid_search(spark, sf_dir):
    """M7: mean area under the ROC of each point of the grid over three folds of the training pairs."""
    df, _ = assembled(spark, sf_dir)
    train = _split(df)[0]
    return M.grid_search(M.narrowed(train, M.telling_slots(train)))


def q_split_importance(spark, sf_dir):
    df, names = assembled(spark, sf_dir)
    train, _ = _split(df)
    slots = M.telling_slots(train)
    counts = M.split_counts(M.fit_regressor(M.narrowed(train, slots)), spark, slots)
    return counts.join(names, "idx", "left").select("idx", "name", "splits", "fscore").orderBy("fscore", "idx")

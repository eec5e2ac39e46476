r"""Target-distribution importance resampling with Arrow kernels.

Each text is lower-cased (A-Z only) and cut into words by Arrow's string kernels;
the words of a batch are dictionary-encoded, so that an n-gram is a tuple of
shifted dictionary indices. CRC-32 is taken once per distinct n-gram of a batch (a
gram's CRC continues that of its first n-1 words) and gives the feature's bucket.

Counts of all raw and all target features per bucket are summed in the tasks and
then per bucket. A bucket's gain is the smoothed log ratio of its target to its raw
share; a document's weight is the sum of the gains over its features, taken by
index and summed per document. Gumbel noise, a hash of seed and doc_id, is added to
the weight, so that the highest scores are a draw without replacement in
proportion to the weights' exponentials.

Batches are handled in slices of bounded bytes of text (a longer text is a
slice of its own), so memory does not grow with a batch. The gain table has one
number per bucket, a parameter, and is sent to the tasks. Ranks come from a range
partitioning of the scores, not from one sorted task.

Defined cases: null and empty texts have no features and weight 0; documents with
fewer than ``least_words`` words get a score but are not drawn; a null doc_id is
noised as the empty string and comes last among ties; equal rows get consecutive
ranks. An empty target or document table leaves smoothed gains. Input columns
may have any name; result columns replace those of the same names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgram.llm.common import numbered, saved, slices

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
RESULT = ("n_words", "n_features", "weight", "score", "rank")


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, and for each n up to ``longest`` (bucket of each n-gram, text it is in), in text order."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATOR)
    words, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    real = pc.greater(pc.binary_length(words), 0)
    coded = pc.dictionary_encode(words.filter(real))
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = owner.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
    names = [w.encode() for w in coded.dictionary.to_pylist()]
    crc = np.array([zlib.crc32(w) for w in names], dtype=np.int64)
    gram, out = index, [(crc[index] % buckets, owner)]
    for n in range(2, longest + 1):
        last = index[n - 1:]
        inside = owner[:len(last)] == owner[n - 1:]
        pair = gram[:len(last)] * max(len(names), 1) + last
        # pairs of (n-1)-gram and next word, numbered anew, so that codes stay small
        distinct, gram = np.unique(pair, return_inverse=True)
        crc = np.array([zlib.crc32(b" " + names[p % len(names)], int(crc[p // len(names)])) for p in distinct.tolist()], dtype=np.int64)
        out.append(((crc[gram] % buckets)[inside], owner[:len(last)][inside]))
    return np.bincount(owner, minlength=len(texts)), out


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features of all texts per bucket, summed within each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                for found, _ in features(part, longest, buckets)[1]:
                    total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """One gain per bucket: 1000 times the log of the smoothed target share over the raw share, rounded down."""
    both = bucket_counts(docs, longest, buckets).withColumnRenamed("n", "s").join(
        bucket_counts(target, longest, buckets).withColumnRenamed("n", "t"), "bucket", "full").fillna(0)
    raw, aim = np.zeros(buckets), np.zeros(buckets)
    for row in both.collect():  # a row per bucket at most
        raw[row.bucket], aim[row.bucket] = row.s, row.t
    n_raw, n_aim = raw.sum(), aim.sum()
    return np.array([math.floor(1000 * math.log(((t + 1) * (n_raw + buckets)) / ((s + 1) * (n_aim + buckets))))
                     for s, t in zip(raw.tolist(), aim.tolist())], dtype=np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def score(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """The columns of docs plus ``n_words, n_features, weight, score`` (long)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    @F.arrow_udf("struct<n_words: long, n_features: long, weight: long>")
    def weigh(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = shared.value
        for whole in parts:
            columns = [[], [], []]
            for part in slices(whole):
                n_words, grams = features(part, longest, len(table))
                n_features, weight = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
                for found, owner in grams:
                    per_text = np.bincount(owner, minlength=len(part))
                    sums = np.concatenate(([0], np.cumsum(table.take(found))))
                    ends = np.cumsum(per_text)
                    weight += sums[ends] - sums[ends - per_text]
                    n_features += per_text
                for c, x in zip(columns, (n_words, n_features, weight)):
                    c.append(x.astype(np.int64))
            empty = np.zeros(0, dtype=np.int64)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([empty, *c])) for c in columns], names=list(RESULT[:3]))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in RESULT]
    weighed = docs.select(*kept, weigh(F.col("text").cast("string")).alias("_w"))
    return weighed.select(*kept, "_w.*", (F.col("_w.weight") + noise(F.col("doc_id"), seed)).alias("score"))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
             percent: int = PERCENT, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """The columns of docs plus ``n_words, n_features, weight, score, rank``; rank is null for documents not drawn."""
    scored = score(docs, gains(docs, target, longest, buckets), longest, seed)
    scored = scored if with_text else scored.drop("text")
    scored = saved(scored.withColumn("_tie", F.monotonically_increasing_id()), "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    # equal rows are interchangeable; their numbers only let a range partitioning divide them
    ranked = numbered(able, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_tie")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))).drop("_tie")

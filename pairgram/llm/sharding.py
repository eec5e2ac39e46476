"""Sharding by extendible hashing.

A row's hash is read as a string of bits. A bucket is a hash prefix; a bucket
whose rows weigh more than the byte limit splits on the next bit, others stay
whole. The shards are the leaves of that directory: the shortest prefixes whose
rows fit the limit.

The directory is found from byte sums, not by moving rows. One pass sums bytes
per cell (a prefix STRIDE bits longer than the bucket looked at; partial sums
before the shuffle), the sums of all shorter prefixes follow from the cells, and
each cell takes the shortest prefix that fits. Only rows of cells that are still
too heavy enter the next pass, STRIDE bits deeper. A row finds its shard by a
join on its cell, so rows are dealt by cell, never by shard or source.

Defined cases: a row weighs the UTF-8 bytes of its text plus one (null text: one).
Rows with equal doc_id and text have equal hashes, so no bit separates them; if
they weigh more than the limit together, they fill numbered overflow pages of
the bucket, each within the limit. A single row heavier than the limit has a
shard of its own. An empty table has no shards. Input columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgram.llm.common import is_empty, repeated, saved, with_key

HASH_BITS = 60
STRIDE = 12
#: Bytes of text that a shard may hold.
SHARD_BYTES = 64 << 20

RESULT = ("n_bytes", "shard", "depth", "shard_bytes", "shard_rows")


def _hashed(docs: DataFrame) -> DataFrame:
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\x1f"),
                    F.coalesce("text", F.lit("")))
    return (with_key(docs, "doc_id", "text")
            .withColumn("_h", F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long"))
            .withColumn("_b", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
            .drop("doc_id", "text"))


def _prefix(bits: int | str) -> F.Column:
    return F.expr(f"shiftright(_h, {HASH_BITS} - {bits})")


def _round(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Cells of ``high`` bits with their shard, or with a null ``depth`` if they must split on."""
    cells = saved(rows.groupBy(_prefix(high).alias("cell")).agg(
        F.sum("_b").alias("b"), F.count(F.lit(1)).alias("n"), F.min("_h").alias("h0"), F.max("_h").alias("h1")),
        "cells")
    per_level = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    fits = per_level.groupBy("depth", "prefix").agg(
        F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"),
        F.min("h0").alias("h0"), F.max("h1").alias("h1")).filter(
        (F.col("shard_bytes") <= limit) | (F.col("h0") == F.col("h1")))
    found = per_level.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(
        F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("s"))
    return saved(cells.select("cell").join(found, "cell", "left").select("cell", "s.*"), "directory")


def directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """(bits, cells) of each pass; cells left open in one pass are refined in the next."""
    passes, low = [], 0
    while low < HASH_BITS:
        high = low + STRIDE
        cells = _round(rows, low + (low > 0), high, limit)
        passes.append((high, cells))
        still = cells.filter("depth IS NULL").select("cell")
        if is_empty(still):
            break
        rows = rows.withColumn("cell", _prefix(high)).join(still, "cell", "left_semi").drop("cell")
        low = high
    return passes


def shard_rows(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """All input columns plus ``n_bytes, shard, depth, shard_bytes, shard_rows``.

    ``shard`` is the bucket's bit string; pages of an overfull bucket of equal
    rows add ``-row hash-page``. Columns of the result replace input columns of
    the same names.
    """
    if limit < 1:
        raise ValueError("the byte limit must be positive")
    rows = _hashed(docs)
    passes = directory(rows.select("_h", "_b"), limit)
    names, found = ("depth", "prefix", "shard_bytes", "shard_rows"), rows
    for i, (bits, cells) in enumerate(passes):
        cells = cells.select(F.col("cell").alias("_cell"), F.struct(*names).alias(f"_s{i}")).filter(f"_s{i}.depth IS NOT NULL")
        found = found.withColumn("_cell", _prefix(bits)).join(cells, "_cell", "left").drop("_cell")
    found = found.withColumn("_s", F.coalesce(*[F.col(f"_s{i}") for i in range(len(passes))]))
    bits = F.expr("lpad(bin(_s.prefix), _s.depth, '0')")
    over = (F.col("_s.shard_bytes") > limit) & (F.col("_s.shard_rows") > 1)
    kept = [c for c in docs.columns if c not in RESULT]

    def result(df, shard, size, count):
        return df.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], F.col("_b").alias("n_bytes"),
                         shard.alias("shard"), F.col("_s.depth").alias("depth"),
                         size.alias("shard_bytes"), count.alias("shard_rows"))

    out = result(found.filter(~over), bits, F.col("_s.shard_bytes"), F.col("_s.shard_rows"))
    heavy = reduce(DataFrame.unionByName, [c for _, c in passes]).filter(
        (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1))
    if is_empty(heavy):
        return out
    pages = (found.filter(over).groupBy("_row", "_key", "_b", "_s").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_per", F.greatest(F.lit(1), F.expr(f"{limit}L div _b"))))
    most = heavy.agg(F.max("shard_rows")).first()[0]
    pages = repeated(pages, "_n", "_i", most).withColumn("_page", F.expr("_i div _per")).withColumn(
        "_in", F.least("_per", F.expr("_n - _page * _per")))
    label = F.concat(bits, F.lit("-"), F.lower(F.hex("_key")), F.lit("-"), F.col("_page").cast("string"))
    return out.unionByName(result(pages, label, F.expr("_in * _b"), F.col("_in")))

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from pairgram.joins import join_unique  # noqa: F401  (for the operators)
from pairgram.session import shared_dir

#: ASCII white space, as the operators that count words define it.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows that one copy-expanding row may produce in one task.
CHUNK = 4096
#: Bytes of text that a task's Arrow kernels work on at once.
SLICE_BYTES = 4 << 20


def words_of(text: str = "text") -> Column:
    """The runs of characters other than SPACE; null texts have none. Splitting is far cheaper than matching words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def settled(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A one-element generator stands between the expression and its users, so the
    optimiser cannot copy the expression into a lambda that runs per element.
    """
    row = F.struct(*[e.alias(n) for n, e in exprs.items()])
    return df.select("*", F.inline(F.array(row)))


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row. Rows that agree in all columns agree in it.

    The hash passes over nulls, so each column goes in behind its null flag, and nested ones as JSON, which names its fields.
    """
    parts = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        nested = isinstance(field.dataType, (ArrayType, MapType, StructType, VariantType))
        parts += [c.isNull(), F.to_json(F.struct(c)) if nested else c]
    return F.xxhash64(*parts)


def with_key(df: DataFrame, *needed: str) -> DataFrame:
    """``_row`` (the whole input row as a struct), ``_key`` (its hash) and the needed columns.

    Operators work on these names alone, so input columns may have any name.
    """
    whole = F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("_row")
    return df.select(whole, row_hash(df).alias("_key"), *[F.col(n).alias(n) for n in needed])


def keyed(df: DataFrame, *needed: str) -> DataFrame:
    """``_key`` and the needed columns only: a narrow table with one row per input row."""
    return df.select(row_hash(df).alias("_key"), *[F.col(n).alias(n) for n in needed])


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the session's shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def repeated(df: DataFrame, copies: str, index: str, most: int) -> DataFrame:
    """Each row ``copies`` times, with ``index`` 0, 1, ...; rows with no copies go.

    ``most`` is the largest number of copies. Above CHUNK, rows are first dealt
    out in chunks over the cluster, so no task makes more than CHUNK rows from a
    row it reads.
    """
    df = df.filter(F.col(copies) > 0)
    if most <= CHUNK:
        return df.withColumn(index, F.explode(F.expr(f"sequence(0L, `{copies}` - 1)")))
    return (df.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (`{copies}` - 1) div {CHUNK})")))
            .repartition("_chunk", "_key")
            .withColumn("_in", F.explode(F.expr(f"sequence(0L, least({CHUNK}L, `{copies}` - _chunk * {CHUNK}) - 1)")))
            .withColumn(index, F.expr(f"_chunk * {CHUNK} + _in")).drop("_chunk", "_in"))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of at most ``most`` bytes of text or of one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, upto - at)
        at = upto


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number the rows from 1 in the given order, without sorting them in one task.

    Rows are range partitioned and sorted; a row's place in its partition is written
    with it, and each partition (one row) adds the rows of those before it.
    """
    placed = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return (placed.withColumn("_part", part).join(F.broadcast(before), "_part")
            .withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before"))

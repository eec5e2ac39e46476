"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: 64 bits over a text's word shingles (repeats included); a bit is set
if it is set in over half of the shingle hashes (XXH64, seed 42).

Fuzzy keys: the fingerprint is cut into segments of 23, 23 and 18 bits (the last
padded with zeros). The perfect binary Golay code covers 23-bit words: a word at
distance 2 or less from its codeword gets that codeword's index, a word at
distance 3 also those of the five codewords at distance 4. Two words that differ in at
most two bits share one of these 1 or 6 indices. With at most MAX_BITS = 2
differing bits in all, one segment of the three is equal (pigeonhole) and both
others share an index. So each pair within the limit meets under a key made of one
whole segment and an index of the next one.

Join: distinct fingerprints only, so exact copies never meet. A key with at most
BUCKET fingerprints joins its pairs and verifies the bit distance. A fuller key is refined
by the index of the third segment, which a pair within the limit shares as well: keys of
42 to 47 bits, that fill up only where fingerprints truly crowd. Fingerprints of a refined key that is still
full are linked exactly without pairs: two fingerprints differ in at most two bits
if and only if both are within one bit of a third word, so each emits itself and
its 64 one-bit neighbours, and all that meet in a word are linked to the smallest of them. A
pair all of whose keys are full has both ends among those, so no link is lost.

Components: alternating large-star and small-star steps over links of
distinct fingerprints, each written to the shared folder, until nothing changes.

Defined cases: null, empty and wordless texts have fingerprint zero and are linked
like any other. Texts with fewer words than a shingle have one shingle. Repeated
rows each get a row. A component's id is its smallest doc_id; null doc_ids are
passed over unless there are no others. A very long text is hashed in one pass, its shingles in parts. Input columns may have any name. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgram.llm.common import is_empty, join_unique, keyed, saved, with_key

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BUCKET = 32
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b101011100011


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint. bytes.lower and bytes.split know ASCII letters and white space only."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist())]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):  # bounded memory for any length
        part = np.array(hashes[at:at + 4096], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``_key, doc_id, fp`` (fp: the bits as a signed long), one row per document."""

    @F.pandas_udf("long")
    def bits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in part], dtype=np.uint64).view(np.int64))

    return keyed(docs, "doc_id", "text").select("_key", "doc_id", bits("text").alias("fp"))


class Golay:
    """Codeword indices of 23-bit words: tables of 2048 syndromes and 4096 codewords."""

    def __init__(self):
        self.code = np.array([self._encode(i) for i in range(4096)], dtype=np.int64)
        self.index = {int(c): i for i, c in enumerate(self.code)}
        #: the lightest error of each syndrome: the code is perfect, so these are all words of weight 3 or less
        self.error = np.zeros(2048, dtype=np.int64)
        bit = [1 << i for i in range(23)]
        errors = bit + [a | b for i, a in enumerate(bit) for b in bit[:i]] + [
            a | b | c for i, a in enumerate(bit) for j, b in enumerate(bit[:i]) for c in bit[:j]]
        weights = np.array(errors, dtype=np.int64)
        self.error[self.syndrome(weights)] = weights
        #: the codewords of weight 7 that cover an error of weight 3
        seven = self.code[np.bitwise_count(self.code) == 7]
        self.around = {int(e): seven[(seven & e) == e] for e in weights if bin(e).count("1") == 3}

    @staticmethod
    def _encode(i: int) -> int:
        word = i << 11
        rest = word
        for b in range(22, 10, -1):
            if rest >> b & 1:
                rest ^= GOLAY << (b - 11)
        return word | rest

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        rest = words.copy()
        for b in range(22, 10, -1):
            rest ^= np.where(rest >> b & 1, GOLAY << (b - 11), 0)
        return rest

    def indices(self, words: np.ndarray) -> list[np.ndarray]:
        """For each word the codeword indices (the upper 12 bits) within distance 4 that make its keys."""
        errors = self.error[self.syndrome(words)]
        out = []
        for w, e in zip(words.tolist(), errors.tolist()):
            near = w ^ e
            more = self.around.get(e)
            out.append(np.array([near >> 11]) if more is None else np.concatenate(([near >> 11], (near ^ more) >> 11)))
        return out


SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """``key, fp``: every fingerprint under its keys, 3 to 18 of them."""

    def keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        golay = Golay()
        for part in parts:
            fp = part["fp"].to_numpy().view(np.uint64)
            cut = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
            near = [golay.indices(c) for c in cut]
            out_key, out_fp = [], []
            for s in range(3):
                fuzzy = near[(s + 1) % 3]
                many = np.array([len(x) for x in fuzzy])
                if len(many):
                    whole = np.repeat(cut[s], many)
                    out_key.append((np.concatenate(fuzzy) | whole << 12) << 2 | s)
                    out_fp.append(np.repeat(part["fp"].to_numpy(), many))
            if out_key:
                yield pd.DataFrame({"key": np.concatenate(out_key), "fp": np.concatenate(out_fp)})

    return fps.select("fp").mapInPandas(keys, "key long, fp long")


def refined_keys(keys: DataFrame) -> DataFrame:
    """``key, fp``: rows of fuzzy_keys under their key and each index of the segment that it does not hold."""

    def finer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        golay = Golay()
        for part in parts:
            key, fp = part["key"].to_numpy(), part["fp"].to_numpy()
            for s in range(3):
                own = key & 3 == s
                if own.any():
                    at, n = SEGMENTS[(s + 2) % 3]
                    third = golay.indices(((fp[own].view(np.uint64) >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64))
                    many = [len(x) for x in third]
                    yield pd.DataFrame({"key": np.repeat(key[own], many) | np.concatenate(third) << 37, "fp": np.repeat(fp[own], many)})

    return keys.mapInPandas(finer, "key long, fp long")


def _near_pairs(keys: DataFrame, sizes: DataFrame, bits: int) -> DataFrame:
    """``a, b`` of keys with at most BUCKET fingerprints, verified."""
    few = keys.join(sizes.filter(F.col("n") <= BUCKET).select("key"), "key")
    left, right = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    return left.join(right, "key").filter("a < b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b").distinct()


def _full(keys: DataFrame, sizes: DataFrame) -> DataFrame:
    return join_unique(keys, sizes.filter(F.col("n") > BUCKET).select("key"), ["key"], "left_semi", counts=sizes.withColumnRenamed("n", "_n"))


def _sizes(keys: DataFrame) -> DataFrame:
    return saved(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``a, b`` (a < b): links that connect all distinct fingerprints ``fp`` at most ``bits`` (0 to 2) apart.

    From keys of at most BUCKET fingerprints come all their links, from fuller
    ones links that connect the same fingerprints.
    """
    if not 0 <= bits <= MAX_BITS:
        raise ValueError("the keys hold for at most two differing bits")
    keys = saved(fuzzy_keys(fps), "keys")
    sizes = _sizes(keys)
    pairs = _near_pairs(keys, sizes, bits)
    if bits < 1 or is_empty(sizes.filter(F.col("n") > BUCKET)):
        return saved(pairs, "links")
    keys = saved(refined_keys(_full(keys, sizes)), "refined")
    sizes = _sizes(keys)
    pairs = pairs.union(_near_pairs(keys, sizes, bits))
    if is_empty(sizes.filter(F.col("n") > BUCKET)):
        return saved(pairs.distinct(), "links")
    crowd = saved(_full(keys, sizes).select("fp").distinct(), "crowd")
    ones = F.array(*[F.lit(0), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]]).cast("array<bigint>")
    words = crowd.select("fp", F.explode(ones).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("word"))
    if bits == 1:  # one bit apart: only a word that is itself a fingerprint links
        words = words.join(crowd.select(F.col("fp").alias("word")), "word", "left_semi")
    words = saved(words, "neighbours")
    least = words.groupBy("word").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = join_unique(words, saved(least, "centres"), ["word"]).filter("a < fp").select("a", F.col("fp").alias("b"))
    return saved(pairs.union(stars).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node reachable) of every node on an edge ``a, b``."""

    def star(pairs: DataFrame) -> DataFrame:
        """For each node u: its neighbours v, linked to the least m of u and them, where v may be linked."""
        least = saved(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("_n")), "least")
        return join_unique(pairs, least.drop("_n"), ["u"], counts=least.select("u", "_n"))  # a centre may have all links

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 1_000_033)).first())

    edges, before = edges.select("a", "b"), None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both).filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        large = saved(large, "large")
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = star(down)
        edges = saved(small.select(F.col("m").alias("a"), F.col("v").alias("b")).union(small.select(F.col("m").alias("a"), F.col("u").alias("b")))
                      .filter("a < b").distinct(), "small")
        now = sign(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def classes(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``fp, root, component_id``: one row per distinct fingerprint; root is the smallest fingerprint of the component."""
    reps = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = saved(components(links(reps.select("fp"), bits)), "components")
    labelled = reps.join(roots, reps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return labelled.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id``, one row per document."""
    prints = saved(fingerprints(docs, shingle), "prints")
    found = saved(classes(prints, bits), "classes").select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """One document of each component: the row with the smallest (doc_id, row hash); equal rows leave one."""
    prints = saved(fingerprints(docs, shingle), "prints")
    found = saved(classes(prints, bits), "classes").select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("_d"), F.col("_key").alias("_k")))
    per_print = prints.groupBy("fp").agg(first.alias("f"))
    kept = per_print.join(found, "fp").groupBy("root").agg(F.min("f").alias("f")).select("f._d", "f._k")
    kept = saved(kept, "kept")
    rows = with_key(docs, "doc_id")
    out = rows.join(kept, (rows["_key"] == F.col("_k")) & rows.doc_id.eqNullSafe(F.col("_d")), "left_semi")
    copies = prints.groupBy("_key", "doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.col("_key").alias("_k2"), F.col("doc_id").alias("_d2"))
    copies = saved(copies, "copies")
    if is_empty(copies):
        return out.select("_row.*")
    same = (F.col("_key") == F.col("_k2")) & F.col("doc_id").eqNullSafe(F.col("_d2"))
    once = out.join(copies, same, "left_anti").select("_row")
    return once.unionByName(out.join(copies, same, "left_semi").dropDuplicates(["_key", "doc_id"]).select("_row")).select("_row.*")

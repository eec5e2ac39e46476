"""Toxicity by class-conditional Kneser-Ney models.

Two models of ORDER-grams of code points, one of toxic and one of ordinary documents,
score a text; the difference of their log-likelihoods per symbol is the evidence.
Symbols are the code points of the lower-cased text, runs of white space and control
signs being one, so grams hold any script, span words and catch inflected and
compounded expressions.

Each class's model has its own counts at the highest order and its own continuation
counts (how many symbols precede a gram) down to OWN symbols, each discounted and
interpolated with the next one. The last of them is interpolated with the
distribution of the corpus: continuation counts of all documents, labelled or not, of
ORDER - 1 symbols down to one. What neither class has seen thus gets the same
probability from both, and says nothing.

Evidence: log P_toxic - log P_ordinary of each symbol, summed and divided by the
text's length, and beside it the same sum with each symbol's difference less MARGIN
towards zero. The first counts every sign, the second the few that say much and
that many small ones would drown; the fitted curve weighs the two, neither below 0.

Counting: a task sums up the grams of a run of rows of one block and writes them; a groupBy adds them
with partial sums, so that a common gram is one row a task.
Counts, continuation counts, backoff and evidence are written tables of one row per
gram that grow with the corpus, made by groupBy on contexts and joins. For scoring, the
grams of each block are joined to the evidence and written by block; a task reads the
rows of its own blocks only. No text is shuffled, no gram goes to the driver.

Learning: a labelled document may be learned from if crc32(doc_id as text) mod 4
is not HELD_OUT. Remainder CALIBRATE sets the parameters of the logistic
curve that turns evidence into a score, by one mean per doc_id; the others give counts.
Labelled rows are a hash sample of at most LABELLED rows, so they can be sent to all
tasks; corpus counts and scores cover every document.

Defined cases: null and empty texts have no evidence and score as the curve says
for none; rows without doc_id are scored, not learned from, and not held out; a
doc_id with several labels is toxic if one says so. Without labels of both
classes all scores are the share of toxic labels (0 without any). Repeated rows get equal
scores; long texts are read in pieces of PIECE characters. Input columns may
have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgram.llm.common import saved
from pairgram.session import shared_dir

ORDER = 5
DISCOUNT = 0.75
#: Grams of fewer symbols have only counts that both classes share.
OWN = 3
#: What a symbol's evidence is above, in size, to count among the strong.
MARGIN = 1.5
#: Symbols that count as no evidence beside a text's own, so that a few symbols do not decide alone.
PRIOR_LENGTH = 60
HELD_OUT, CALIBRATE = 2, 3
#: Most labelled rows that are learned from.
LABELLED = 200_000
THRESHOLD = 0.3
PIECE = 1 << 20
#: Grams that a counting task holds before it sums them up.
HOLD = 1 << 21
#: Grams of a block up to which they are looked up by table; more are searched in order, in a fifth of the memory.
TABLED = 1 << 22
#: Bytes of text of a block, about: its distinct grams are joined to the evidence once, and held by the task that scores it.
BLOCK = 40 << 20
SPACE = 32


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _space_table() -> np.ndarray:
    """Code points up to U+3000 -> themselves, white space and control signs -> SPACE. There is no white space above."""
    return np.array([SPACE if chr(cp).isspace() or cp < 32 or 0x7F <= cp < 0xA0 else cp for cp in range(0x3001)], dtype=np.uint32)


TABLE = _space_table()
#: Odd multipliers of a gram's symbols in its 64-bit key.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def symbols(text: str, last: int = SPACE) -> np.ndarray:
    """Symbols of a text; runs of SPACE are one. ``last`` is the symbol before it."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.where(cp < len(TABLE), TABLE[np.minimum(cp, len(TABLE) - 1)], cp)
    space = out == SPACE
    twice = space.copy()
    twice[1:] &= space[:-1]
    twice[:1] &= last == SPACE
    return out[~twice] if twice.any() else out


def runs(text: str) -> Iterator[np.ndarray]:
    """Symbols of a text that begins and ends with SPACE, piece by piece; each run begins with the last ORDER - 1 of the one before."""
    tail = np.full(1, SPACE, dtype=np.uint32)
    for at in range(0, len(text), PIECE):
        end = at + PIECE >= len(text)
        got = np.concatenate((tail, symbols(text[at:at + PIECE] + (" " if end else ""), int(tail[-1]))))
        if len(got) >= ORDER:
            yield got
        tail = got[1 - ORDER:]


def keys_of(run: np.ndarray) -> np.ndarray:
    """64-bit keys of the grams of a run."""
    wide, n = run.astype(np.uint64), len(run) - ORDER + 1
    out = wide[:n] * FACTORS[0]
    for k in range(1, ORDER):
        out += wide[k:k + n] * FACTORS[k]
    out ^= out >> np.uint64(32)
    out *= FACTORS[0]
    out ^= out >> np.uint64(29)
    return out.view(np.int64)


def grams(text: str) -> Iterator[np.ndarray]:
    """Keys of the grams of a text that begins and ends with SPACE, piece by piece."""
    return map(keys_of, runs(text))


def gram_strings(codes: np.ndarray) -> pa.Array:
    """Rows of ORDER code points as strings."""
    sizes = 1 + (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
    offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum(sizes.sum(axis=1), dtype=np.int32)))
    data = np.ascontiguousarray(codes, dtype="<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets), pa.py_buffer(data))


def string_keys(strings: pa.StringArray) -> np.ndarray:
    """Keys of grams given as strings without nulls; their characters are read at once, no string is made of each."""
    if not len(strings):
        return np.zeros(0, np.int64)
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[strings.offset:strings.offset + len(strings) + 1]
    codes = data[int(ends[0]):int(ends[-1])].to_pybytes().decode().encode("utf-32-le")
    return keys_of(np.frombuffer(codes, dtype=np.uint32))[::ORDER]


class _Sums:
    """Sums per gram of one class, in memory that follows the number of distinct grams."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.codes = np.zeros((0, ORDER), dtype=np.uint32)
        self.held: list[np.ndarray] = []
        self.runs: list[np.ndarray] = []
        self.size = 0

    def add(self, part: np.ndarray, run: np.ndarray | None = None) -> None:
        """Keys, and the run that they are of."""
        self.held.append(part)
        self.runs.append(np.zeros(len(part) + ORDER - 1, dtype=np.uint32) if run is None else run)
        self.size += len(part)
        if self.size >= HOLD:
            self.flush()

    def flush(self) -> None:
        if self.held:
            keys, first, counts = np.unique(np.concatenate(self.held), return_index=True, return_counts=True)
            # a run is ORDER - 1 symbols longer than its keys
            ends = np.cumsum([len(h) for h in self.held])
            first = first + (ORDER - 1) * np.searchsorted(ends, first, side="right")
            codes = np.concatenate(self.runs)[first[:, None] + np.arange(ORDER)]
            self.held, self.runs, self.size = [], [], 0
            both = np.concatenate((self.keys, keys))
            self.keys, first, where = np.unique(both, return_index=True, return_inverse=True)
            self.sums = np.bincount(where, np.concatenate((self.sums, counts)), len(self.keys)).astype(np.int64)
            self.codes = np.concatenate((self.codes, codes))[first]


def block_grams(docs: DataFrame) -> DataFrame:
    """``block, gram, toxic, ordinary`` over all rows of ``block, text, label`` (1, 0 or null for neither class), summed per task."""
    schema = pa.schema([("block", pa.int64()), ("gram", pa.string()), ("toxic", pa.int64()), ("ordinary", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, block = {1: _Sums(), 0: _Sums(), -1: _Sums()}, None

        def done(least: int) -> Iterator[pa.RecordBatch]:
            for label, s in sums.items():
                if len(s.keys) + s.size >= least:
                    s.flush()
                    for at in range(0, len(s.keys), 1 << 18):
                        strings, own = gram_strings(s.codes[at:at + (1 << 18)]), pa.array(s.sums[at:at + (1 << 18)])
                        zero = pa.array(np.zeros(len(strings), dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(strings), block)), strings, own if label == 1 else zero,
                                                          own if label == 0 else zero], schema=schema)
                    s.clear()

        for batch in batches:
            for b, label, text in zip(*(batch.column(c).to_pylist() for c in ("block", "label", "text"))):
                if b != block:
                    yield from done(1)
                    block = b
                for run in runs(text or ""):
                    sums[label].add(keys_of(run), run)
                yield from done(2 * HOLD)
        yield from done(1)

    rows = docs.select("block", "text", F.coalesce("label", F.lit(-1)).cast("int").alias("label"))
    return rows.mapInArrow(count, "block long, gram string, toxic long, ordinary long")


def count_grams(docs: DataFrame) -> DataFrame:
    """``gram, toxic, ordinary`` over all rows of ``text, label`` (1, 0 or null for neither class)."""
    return _added(block_grams(docs.select(F.lit(0).cast("long").alias("block"), "text", "label")))


def _added(parts: DataFrame) -> DataFrame:
    return parts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _context(order: int) -> Column:
    return F.substring("gram", 1, order - 1)


def _suffix(order: int) -> Column:
    return F.substring("gram", 2, order - 1)


def discounted(table: DataFrame, order: int, names: tuple[str, ...]) -> DataFrame:
    """``gram`` and, for each count c, ``m_c`` and ``g_c``: P(last symbol | the others) = m_c + g_c * P(last symbol | fewer)."""
    of = table.groupBy(_context(order).alias("_c")).agg(*[x for c in names for x in (
        F.sum(c).alias(f"total_{c}"), F.sum((F.col(c) > 0).cast("long")).alias(f"types_{c}"))])
    columns = [x for c in names for x in (
        (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"total_{c}"), F.lit(1))).alias(f"m_{c}"),
        F.when(F.col(f"total_{c}") > 0, DISCOUNT * F.col(f"types_{c}") / F.col(f"total_{c}")).otherwise(1.0).alias(f"g_{c}"))]
    return table.join(of, _context(order) == F.col("_c")).select("gram", *columns)


def continuations(counts: DataFrame) -> dict[int, DataFrame]:
    """For ORDER - 1, ..., 1 symbols: ``gram`` and how many symbols precede it in each class (``toxic, ordinary``) and in all documents (``shared``)."""
    out, seen = {}, counts
    for order in range(ORDER - 1, 0, -1):
        seen = saved(seen.groupBy(F.substring("gram", 2, order).alias("gram")).agg(
            *[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("toxic", "ordinary")], F.count(F.lit(1)).alias("shared")), f"grams{order}")
        out[order] = seen
    return out


def gram_evidence(counts: DataFrame) -> DataFrame:
    """``gram, value``: the evidence of the grams of ``gram, toxic, ordinary`` that have some."""
    tables = continuations(counts)
    every = tables[1].count()
    classes = ("toxic", "ordinary")
    lower = discounted(tables[1], 1, ("shared",)).select("gram", (F.col("m_shared") + F.col("g_shared") / every).alias("corpus"))
    kept: list[str] = []  # m and g of the classes' shorter grams
    for order in range(2, ORDER):
        names = (*classes, "shared") if order >= OWN else ("shared",)
        below = lower.select(F.col("gram").alias("_s"), F.col("corpus").alias("_lower"), *kept)
        at = discounted(tables[order], order, names).join(below, _suffix(order) == F.col("_s"))
        own = [F.col(f"{x}_{c}").alias(f"{x}{order}_{c}") for x in "mg" for c in classes] if order >= OWN else []
        lower = at.select("gram", (F.col("m_shared") + F.col("g_shared") * F.col("_lower")).alias("corpus"), *kept, *own)
        kept += [f"{x}{order}_{c}" for x in "mg" for c in classes] if order >= OWN else []
    p = {c: F.col("corpus") for c in classes}
    for order in range(OWN, ORDER):
        p = {c: F.col(f"m{order}_{c}") + F.col(f"g{order}_{c}") * p[c] for c in classes}
    below = saved(lower.select(F.col("gram").alias("_s"), *[p[c].alias(f"p_{c}") for c in classes]), "backoff")
    top = discounted(counts, ORDER, classes).join(below, _suffix(ORDER) == F.col("_s"))
    log = {c: F.ln(F.col(f"m_{c}") + F.col(f"g_{c}") * F.col(f"p_{c}")) for c in classes}
    value = log["toxic"] - log["ordinary"]
    return top.select("gram", value.cast("float").alias("value")).filter("value != 0")


def sample_labels(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """``doc_id, label, part``: labelled documents that may be learned from, at most about ``most`` by hash."""
    own = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    own = saved(own.withColumn("part", remainder(F.col("doc_id"))).filter(F.col("part") != HELD_OUT), "labels")
    n = own.count()
    if n <= most:
        return own
    return own.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(0.95 * most / n * (1 << 20)))


class Lookup:
    """Values of 64-bit keys, 0 for others: a table by some bits of the key, what finds no room there in a next one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys, first = np.unique(keys, return_index=True)
        values, self.levels = values[first], []
        for shift in (0, 12, 24, 36) if len(keys) <= TABLED else ():
            size = 1 << max(8, (4 * len(keys)).bit_length() - 1)
            at = (keys >> shift) & (size - 1)
            own, out = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.float32)
            own[at] = keys
            there = own[at] == keys
            out[at[there]] = values[there]
            self.levels.append((shift, size - 1, own, out))
            keys, values = keys[~there], values[~there]
        self.keys, self.values = keys, values

    def found(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys that are there, in any order."""
        out = []
        for shift, mask, own, values in self.levels:
            at = (keys >> shift) & mask
            there = own[at] == keys
            out.append(values[at[there]])
            keys = keys[~there]
        if len(self.keys) and len(keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out.append(self.values[at][self.keys[at] == keys])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.float32)


@dataclass
class Curve:
    """Where the evidence by block is, and what turns a text's evidence into a score."""
    uri: str = ""
    #: of the evidence and of its strong part
    slopes: tuple[float, float] = (1.0, 0.0)
    offset: float = 0.0
    #: score of all texts when a class has no labels
    constant: float | None = None


def block_evidence(uri: str, block: int) -> Lookup:
    """The written evidence of the grams of a block; a block without any has no folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(f"{uri}/block={block}")
    keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if f.path.endswith(".parquet"):
            for batch in pq.ParquetFile(store.open_input_file(f.path)).iter_batches(1 << 18):
                keys.append(string_keys(batch["gram"]))
                values.append(batch["value"].to_numpy())
    return Lookup(np.concatenate(keys), np.concatenate(values))


def raw_evidence(rows: DataFrame, uri: str) -> DataFrame:
    """rows, which have ``text`` and ``block``, plus ``z``: the evidence per symbol, ``plain`` and its part above the margin, ``strong``."""

    @F.pandas_udf("plain double, strong double")
    def z(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        block, table = None, None
        for texts, blocks in parts:
            out = np.zeros((len(texts), 2))
            for row, (text, b) in enumerate(zip(texts, blocks)):
                if b != block:
                    block, table = b, block_evidence(uri, b)
                n = 0
                for g in grams(text or ""):
                    found = table.found(g)
                    strong = found[np.abs(found) > MARGIN]
                    out[row] += found.sum(dtype=np.float64), (strong - np.copysign(np.float32(MARGIN), strong)).sum(dtype=np.float64)
                    n += len(g)
                out[row] /= n + PRIOR_LENGTH
            yield pd.DataFrame(out, columns=["plain", "strong"])

    return rows.withColumn("z", z("text", "block"))


def logistic(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[tuple[float, ...], float]:
    """Slopes, none below 0, and offset of P(y = 1 | z) by Newton steps with a small ridge. z has a row per y."""
    kept = list(range(z.shape[1]))
    while True:
        scale = np.where(z[:, kept].std(axis=0) > 0, z[:, kept].std(axis=0), 1.0)
        x = np.concatenate((z[:, kept] / scale, np.ones((len(z), 1))), axis=1)
        w = np.zeros(len(kept) + 1)
        w[-1] = np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (y - p) - 1e-3 * w)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        if len(kept) == 1 or w[:-1].min() >= 0:
            slopes = np.zeros(z.shape[1])
            slopes[kept] = w[:-1] / scale
            return tuple(slopes.tolist()), float(w[-1])
        del kept[int(w[:-1].argmin())]


def in_blocks(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns plus ``block``, the same for a row in every job: from its file and place there. Rows that are not read from Parquet are written once.

    The columns are ``text``, or ``_row`` that holds it, and any others. Blocks have as many rows as BLOCK bytes of text hold in the mean.
    """

    def placed(df: DataFrame, text: Column, *chosen: Column) -> DataFrame:
        at = df.metadataColumn("_metadata")
        size, rows = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count(F.lit(1))).first()
        blocks, run = max(1, size // BLOCK), max(1, min(rows, rows * BLOCK // max(size, 1)))
        return df.select(*chosen, F.pmod(F.xxhash64(at["file_path"], F.floor(at["row_index"] / run)), F.lit(blocks)).alias("block"))

    try:
        return placed(docs, docs["text"], *columns)
    except AnalysisException:
        rows = saved(docs.select(*columns), "texts")
        return placed(rows, F.col("text") if "text" in rows.columns else F.col("_row.text"), *[F.col(c) for c in rows.columns])


def fit(rows: DataFrame, labels: DataFrame, most: int = LABELLED) -> Curve:
    """Counts over all rows of ``doc_id, text, block``, classes and the curve from the sampled labels. Labels alone say what is toxic."""
    own = saved(sample_labels(labels.select("doc_id", "toxic"), most), "sample")
    small = F.broadcast(own.filter(F.col("part") != CALIBRATE).select(F.col("doc_id").alias("_d"), "label"))
    found = rows.select("doc_id", "text", "block").join(small, F.col("doc_id") == F.col("_d"), "left")
    parts = saved(block_grams(found), "block_grams")
    counts = saved(_added(parts), "counts")
    seen = counts.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if not seen[0] or not seen[1]:
        return Curve(constant=float(own.agg(F.avg("label")).first()[0] or 0.0))
    path = shared_dir(rows.sparkSession, "by_block")
    # tasks that share a block each have its grams: one row of them stays, in the partition of the block
    values = parts.select("gram", "block").join(saved(gram_evidence(counts), "evidence"), "gram").repartition("block")
    values.groupBy("block", "gram").agg(F.first("value").alias("value")).write.partitionBy("block").parquet(path)
    curve = Curve(path if re.match(r"\w+:", path) else f"file://{path}")
    check = F.broadcast(own.filter(F.col("part") == CALIBRATE).select(F.col("doc_id").alias("_d"), "label"))
    z = raw_evidence(rows.select("doc_id", "text", "block").join(check, F.col("doc_id") == F.col("_d")), curve.uri)
    z = z.groupBy("_d").agg(F.avg("z.plain").alias("plain"), F.avg("z.strong").alias("strong"), F.max("label").alias("label")).toPandas()  # at most one row a label
    if z["label"].nunique() == 2:
        z = z.sort_values("_d")
        curve.slopes, curve.offset = logistic(z[["plain", "strong"]].to_numpy(), z["label"].to_numpy(np.float64))
    return curve


def score(rows: DataFrame, curve: Curve) -> DataFrame:
    """rows plus ``score`` (0 to 1). rows are those of in_blocks and have ``text``."""
    if curve.constant is not None:
        return rows.withColumn("score", F.lit(curve.constant))
    linear = F.col("z.plain") * curve.slopes[0] + F.col("z.strong") * curve.slopes[1] + curve.offset
    return raw_evidence(rows, curve.uri).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(linear, F.lit(30.0)), F.lit(-30.0))))).drop("z")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per document."""
    rows = in_blocks(docs, docs["doc_id"], docs["text"])
    scored = score(rows, fit(rows, labels))
    held = F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under the threshold, with their columns as they are."""
    whole = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("_row")
    rows = in_blocks(docs, whole).select("_row", "_row.doc_id", "_row.text", "block")
    return score(rows, fit(rows, labels)).filter(F.col("score") < threshold).select("_row.*")

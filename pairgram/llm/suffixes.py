"""Suffix-array deduplication of byte strings of LENGTH bytes.

Every byte covered by a LENGTH-byte string that also starts anywhere else goes.

Sparse suffixes. A window (LENGTH bytes) has an anchor: the GRAM bytes in it with the
smallest hash, the first of equals. Equal windows have the same anchor at the same
offset, and neighbouring windows mostly share theirs, so a text is a list of runs
(windows with one anchor), about one per 85 bytes. Only runs are exchanged, as hashes:

* an anchor hash that occurs once has no equal window (one sum per hash);
* a run whose whole bytes occur twice has only equal windows (the same);
* what is left are runs at the rim of a repeated passage, and the runs they
  may be equal to in part. Their bytes are sorted as suffixes.

Merge sort. Each task sorts the suffixes that begin at its anchors, and sends them
front-coded (length of the prefix shared with the one before, and the rest) as sorted
runs to the task of their anchor. There a loser tree merges the runs: each entry
knows the prefix it shares with the last output, a longer one wins without a look at
the bytes, and equals are compared from there on, so no known prefix is compared
again. The merge yields the order and the shared prefix lengths; a window at
offset d of two suffixes is equal if they share LENGTH - d bytes and their d bytes
before the anchor are equal, which is read off for each d from the prefix lengths
and hashes of the bytes before.

Hot passages. An anchor with more than CROWD different runs (the rim of a passage
that very many documents hold) is not sent to one task: the windows of its runs, first
in blocks, are counted by hash, with partial sums before the shuffle, and joined back.

Hashes are 64 bits; runs must agree in two of them (anchor and whole).

Defined cases: null and empty texts have no bytes. Repeated rows are equal to each
other, so all their windows go. Texts shorter than LENGTH keep all bytes. Long
texts are read in pieces of PIECE bytes. Input columns may have any name.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgram.llm.common import is_empty, join_unique, keyed, saved

LENGTH = 200
GRAM = 32
CROWD = 1000
PIECE = 1 << 20
POSITION_BITS = 21
#: Windows of a block in which crowded runs are counted.
STEP = 8
#: Suffixes that a task sorts at a time, and, about, that a merging task gets.
RUN = 50_000
MERGE = 20_000


def _numbers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers from a multiply-and-shift generator."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


class Hasher:
    """Hashes of all substrings of a buffer from sums of byte values times powers."""

    BYTES = _numbers(256, 11)
    BASE = int(_numbers(1, 99)[0])

    def __init__(self, size: int):
        def powers(base: int) -> np.ndarray:
            out = np.full(size, np.uint64(base))
            out[0] = 1
            return np.multiply.accumulate(out)

        self.up, self.down = powers(self.BASE), powers(pow(self.BASE, -1, 1 << 64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.BYTES[data] * self.up[:len(data)], out=out[1:])
        return out

    def hash(self, sums: np.ndarray, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        at = self.down[:len(sums)][begin]
        return mixed((sums[end] - sums[begin]) * at)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def runs(texts: list[bytes], hasher: Hasher, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray] | None:
    """Runs of windows with one anchor in texts of at most PIECE + length bytes together.

    doc: index of the text; begin: first window; n: windows; lead: anchor - begin;
    anchor, whole: hashes of the anchor's bytes and of all bytes of the run.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < length:
        return None
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    sums = hasher.sums(data)
    grams = hasher.hash(sums, slice(0, len(data) - gram + 1), slice(gram, len(data) + 1))
    at = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = sliding_min((grams & ~low) | at, length - gram + 1)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[:len(least)]
    valid = starts[doc] + sizes[doc] >= np.arange(len(least)) + length
    first = np.empty(len(least), dtype=bool)
    first[0] = True
    np.not_equal(least[1:], least[:-1], out=first[1:])
    first[1:] |= doc[1:] != doc[:-1]
    begin = np.nonzero(first & valid)[0]
    if not len(begin):
        return None
    # a run ends before the next one begins, or with the last whole window of its text
    after = np.nonzero(first)[0]
    end = np.concatenate((after, [len(least)]))[np.searchsorted(after, begin, side="right")]
    end = np.minimum(end, starts[doc[begin]] + sizes[doc[begin]] - length + 1)
    anchor = (least[begin] & low).astype(np.int64)
    whole = hasher.hash(sums, begin, end - 1 + length) + (anchor - begin).astype(np.uint64)
    return {"doc": doc[begin], "begin": begin - starts[doc[begin]], "n": end - begin, "lead": anchor - begin,
            "anchor": grams[anchor].view(np.int64), "whole": whole.view(np.int64)}


def pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Groups of (key, doc_id, offset) and bytes, at most PIECE + length bytes each; a long text's pieces overlap by length - 1."""
    rows, texts, size = [], [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column("bytes")[i].as_py() or b""
            if len(text) < length:
                continue
            name = (batch.column("_key")[i].as_py(), batch.column("doc_id")[i].as_py())
            for at in range(0, len(text) - length + 1, PIECE):
                part = text[at:at + PIECE + length - 1]
                if size + len(part) > PIECE + length and rows:
                    yield rows, texts
                    rows, texts, size = [], [], 0
                rows.append((*name, at))
                texts.append(part)
                size += len(part)
    if rows:
        yield rows, texts


def run_table(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``anchor, whole, _key, doc_id, begin, n, lead``: all runs of ``_key, doc_id, bytes``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PIECE + 2 * length)
        for rows, texts in pieces(batches, length):
            found = runs(texts, hasher, length, gram)
            if found is None:
                continue
            doc = found["doc"]
            keys = np.array([r[0] for r in rows], dtype=np.int64)[doc]
            ids = pa.array([r[1] for r in rows], pa.int64()).take(pa.array(doc))
            offset = np.array([r[2] for r in rows], dtype=np.int64)[doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found["anchor"]), pa.array(found["whole"]), pa.array(keys), ids, pa.array(found["begin"] + offset),
                 pa.array(found["n"].astype(np.int16)), pa.array(found["lead"].astype(np.int16))],
                names=["anchor", "whole", "_key", "doc_id", "begin", "n", "lead"])

    return docs.mapInArrow(find, "anchor long, whole long, _key long, doc_id long, begin long, n short, lead short")


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    most = min(len(a), len(b))
    step = 16
    while known < most and a[known:known + step] == b[known:known + step]:
        known += step
        step *= 2
    known = min(known, most)
    step = min(step, most - known)
    while step:  # the first difference is within the next ``step`` bytes, or there is none
        half = (step + 1) // 2
        if a[known:known + half] == b[known:known + half]:
            known += half
            step -= half
        elif half == 1:
            break
        else:
            step = half
    return known


def front_code(sorted_items: list[bytes]) -> tuple[list[int], list[bytes]]:
    shared, rest, before = [], [], b""
    for x in sorted_items:
        n = common_prefix(before, x, 0)
        shared.append(n)
        rest.append(x[n:])
        before = x
    return shared, rest


class LoserTree:
    """Merge of front-coded sorted runs that keeps the shared prefix of each run's head with the last output."""

    def __init__(self, coded: list[tuple[list[int], list[bytes]]]):
        self.runs = coded
        k = 1
        while k < len(coded):
            k *= 2
        self.k = k
        self.next = [0] * k
        self.head: list[bytes | None] = [None] * k
        self.shared = [0] * k
        for i in range(len(coded)):
            self._advance(i)
        self.losers = [0] * k
        self.winner = self._build(1)

    def _advance(self, i: int) -> None:
        """The run's next entry. It shares with the last output, its predecessor, what front coding says."""
        shared, rest = self.runs[i]
        at = self.next[i]
        if at >= len(rest):
            self.head[i] = None
            return
        self.head[i] = (self.head[i] or b"")[:shared[at]] + rest[at]
        self.shared[i] = shared[at]
        self.next[i] = at + 1

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix becomes that with the winner."""
        x, y = self.head[a], self.head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = self.shared[a], self.shared[b]
        if p != q:  # the one that shares more with the last output is smaller, and the other shares with it what it did
            return (a, b) if p > q else (b, a)
        n = common_prefix(x, y, p)
        if (n == len(x)) or (n < len(y) and x[n] < y[n]):
            self.shared[b] = n
            return a, b
        self.shared[a] = n
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        won, lost = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple[int, int, bytes, int]]:
        """(run, index in the run, string, prefix shared with the string before)."""
        while self.head[self.winner] is not None:
            i = self.winner
            yield i, self.next[i] - 1, self.head[i], self.shared[i]
            self._advance(i)
            node, won = (i + self.k) // 2, i
            while node:
                won, self.losers[node] = self._play(self.losers[node], won)
                node //= 2
            self.winner = won


def equal_windows(shared: np.ndarray, anchors: np.ndarray, before: list[bytes], lead: np.ndarray, n: np.ndarray,
                  length: int = LENGTH) -> np.ndarray:
    """Which windows of sorted suffixes have an equal one: a row per suffix, a column per offset d of the anchor in the window.

    shared: prefix shared with the suffix before; before: the bytes before the anchor.
    """
    width = int(lead.max()) + 1
    grid = np.zeros((len(before), max(width - 1, 1)), dtype=np.uint8)
    for i, b in enumerate(before):
        grid[i, :len(b)] = np.frombuffer(b, dtype=np.uint8)[::-1]
    powers = Hasher(width + 1).up
    hashes = np.zeros((len(before), width), dtype=np.uint64)
    np.cumsum(Hasher.BYTES[grid[:, :width - 1]] * powers[:width - 1], axis=1, out=hashes[:, 1:]) if width > 1 else None
    at = np.arange(len(before))
    other = np.ones(len(before), dtype=bool)
    other[1:] = anchors[1:] != anchors[:-1]
    equal = np.zeros((len(before), width), dtype=bool)
    for d in range(width):
        own = np.nonzero((lead >= d) & (lead - n < d))[0]
        if len(own) < 2:
            continue
        block = np.maximum.accumulate(np.where(other | (shared < length - d), at, 0))[own]
        order = np.lexsort((hashes[own, d], block))
        same = (block[order][1:] == block[order][:-1]) & (hashes[own[order], d][1:] == hashes[own[order], d][:-1])
        twice = np.zeros(len(own), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        equal[own, d] = twice
    return equal


BLOCK = "bucket int, keys array<bigint>, ids array<bigint>, anchors array<bigint>, at array<bigint>, lead array<int>, n array<int>, single array<boolean>, shared array<int>, rest array<binary>, before array<binary>"
NAMES = ("keys", "ids", "anchors", "at", "lead", "n", "single")


def sorted_runs(rows: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """BLOCK: front-coded runs of the suffixes at the anchors of ``runs`` in ``bytes``, one row per task, bucket and RUN suffixes."""

    def emit(held: list[tuple]) -> Iterator[dict]:
        held.sort(key=lambda x: (x[0], x[1]))
        begin = 0
        for i in range(1, len(held) + 1):
            if i == len(held) or held[i][0] != held[begin][0]:
                part = held[begin:i]
                shared, rest = front_code([x[1] for x in part])
                named = {c: [x[3 + j] for x in part] for j, c in enumerate(NAMES)}
                yield {"bucket": part[0][0], "shared": shared, "rest": rest, "before": [x[2] for x in part], **named}
                begin = i

    types = {"bucket": pa.int32(), "shared": pa.list_(pa.int32()), "rest": pa.list_(pa.binary()), "before": pa.list_(pa.binary()),
             "keys": pa.list_(pa.int64()), "ids": pa.list_(pa.int64()), "anchors": pa.list_(pa.int64()), "at": pa.list_(pa.int64()),
             "lead": pa.list_(pa.int32()), "n": pa.list_(pa.int32()), "single": pa.list_(pa.bool_())}
    schema = pa.schema([(c.split()[0], types[c.split()[0]]) for c in BLOCK.split(", ")])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("bytes")[i].as_py()
                name = (batch.column("_key")[i].as_py(), batch.column("doc_id")[i].as_py())
                for r in batch.column("runs")[i].as_py():
                    at = r["begin"] + r["lead"]
                    held.append((r["anchor"] % buckets, data[at:r["begin"] + r["n"] - 1 + length], data[r["begin"]:at],
                                 *name, r["anchor"], at, r["lead"], r["n"], r["single"]))
                if len(held) >= RUN:
                    for row in emit(held):
                        yield pa.RecordBatch.from_pylist([row], schema=schema)
                    held = []
        for row in emit(held):
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    return rows.mapInArrow(sort, BLOCK)


def merged(blocks: DataFrame, length: int = LENGTH) -> DataFrame:
    """``_key, doc_id, first, last``: ranges of equal windows (first to last start) of the single runs."""

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        coded = [(list(s), list(r)) for s, r in zip(part["shared"], part["rest"])]
        named = {c: [list(x) for x in part[c]] for c in (*NAMES, "before")}
        order, shared = [], []
        for run, at, _, n in LoserTree(coded):
            order.append((run, at))
            shared.append(n)
        take = {c: [named[c][run][at] for run, at in order] for c in named}
        lead, n, at = (np.array(take[c], dtype=np.int64) for c in ("lead", "n", "at"))
        equal = equal_windows(np.array(shared), np.array(take["anchors"], dtype=np.int64), take["before"], lead, n, length)
        equal &= np.array(take["single"], dtype=bool)[:, None]
        edge = np.zeros((len(equal), equal.shape[1] + 2), dtype=np.int8)
        edge[:, 1:-1] = equal
        change = np.diff(edge, axis=1)
        row, low = np.nonzero(change == 1)
        high = np.nonzero(change == -1)[1] - 1
        return pd.DataFrame({"_key": [take["keys"][i] for i in row], "doc_id": [take["ids"][i] for i in row],
                             "first": at[row] - high, "last": at[row] - low})

    return blocks.groupBy("bucket").applyInPandas(merge, "_key long, doc_id long, first long, last long")


def blocks_of_run(hasher: Hasher, part: np.ndarray, lead: int, n: int, length: int) -> Iterator[tuple]:
    """(b, hash of all bytes or None, hash of the common bytes, first d, window hashes) of each block of STEP offsets.

    Block b has the windows of offsets STEP * b to STEP * b + STEP - 1; the common bytes are those that all of them hold.
    """
    sums = hasher.sums(part)
    one = lambda i, j: int(hasher.hash(sums, np.array([i]), np.array([j])).view(np.int64)[0])
    windows = hasher.hash(sums, slice(0, n), slice(length, length + n)).view(np.int64)
    least = lead - n + 1
    for b in range(least // STEP, lead // STEP + 1):
        low, high = STEP * b, STEP * b + STEP - 1
        first, last = max(low, least), min(high, lead)
        whole = one(lead - high, lead - low + length) if (first, last) == (low, high) else None
        yield b, whole, one(lead - low, lead - high + length), first, windows[lead - last:lead - first + 1][::-1].tolist()


def crowded(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """``_key, doc_id, first, last`` of equal windows among the runs of crowded anchors, counted by hash.

    Blocks of STEP windows first: if the bytes that all windows of a block hold
    occur once, none of its windows is equal to another; if all its bytes occur
    twice, all are. Single windows are counted for the blocks in between, and for
    one block of each kind that occurs twice, which stands for the others.
    """
    schema = ("anchor long, b int, whole long, core long, d0 int, hashes array<long>, _key long, doc_id long, at long, single boolean")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(2 * length)
        for batch in batches:
            for i in range(batch.num_rows):
                data, found = batch.column("bytes")[i].as_py(), []
                key, doc = batch.column("_key")[i].as_py(), batch.column("doc_id")[i].as_py()
                for r in batch.column("runs")[i].as_py():
                    part = np.frombuffer(data, dtype=np.uint8, offset=r["begin"], count=r["n"] - 1 + length)
                    found += [(r["anchor"], *x, key, doc, r["begin"] + r["lead"], r["single"])
                              for x in blocks_of_run(hasher, part, r["lead"], r["n"], length)]
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=[c.split()[0] for c in schema.split(", ")])

    table = saved(rows.mapInArrow(cut, schema), "blocks")
    def counted(rows: DataFrame, keys: list[str], *more) -> DataFrame:
        """The keys that several rows share, with their number ``_n``."""
        return saved(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *more).filter("_n > 1"), "counted")

    # a passage that many documents hold is one key: such keys meet their rows by broadcast
    key = ["anchor", "b", "core"]
    cores = counted(table, key)
    table = saved(join_unique(table, cores.select(*key), key, "left_semi", counts=cores), "cores")
    key = ["anchor", "b", "whole"]
    twice = counted(table.filter("whole IS NOT NULL"), key, F.min(F.struct("_key", "doc_id", "at")).alias("one"))
    full = join_unique(table.filter("whole IS NOT NULL"), twice.drop("_n"), key, "left", counts=twice)
    table = saved(full.unionByName(table.filter("whole IS NULL").withColumn("one", F.lit(None).cast(twice.schema["one"].dataType))), "wholes")
    known = F.col("one").isNotNull()
    spans = table.filter(known & F.col("single")).select(
        "_key", "doc_id", (F.col("at") - STEP * F.col("b") - (STEP - 1)).alias("first"), (F.col("at") - STEP * F.col("b")).alias("last"))
    open_ = table.filter(~known | (F.col("one") == F.struct("_key", "doc_id", "at")))
    windows = saved(open_.select("anchor", "_key", "doc_id", "at", (F.col("single") & ~known).alias("asked"), "d0", F.posexplode("hashes").alias("i", "h"))
                    .withColumn("d", F.col("d0") + F.col("i")), "windows")
    key = ["anchor", "d", "h"]
    same = counted(windows, key)
    found = join_unique(windows.filter("asked"), same.select(*key), key, "left_semi", counts=same)
    return spans.unionByName(found.select("_key", "doc_id", (F.col("at") - F.col("d")).alias("first"), (F.col("at") - F.col("d")).alias("last")))


def _released(spark) -> None:
    """Let the cluster drop the shuffle files of finished steps, whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _texts(docs: DataFrame) -> DataFrame:
    """``_key, doc_id, bytes`` and ``id``, the doc_id itself; in doc_id a null is the least long (the key tells the rows apart)."""
    own = F.col("doc_id").cast("long")
    return keyed(docs, "doc_id", "text").select("_key", F.coalesce(own, F.lit(-(1 << 63))).alias("doc_id"), own.alias("id"),
                                                F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes"))


def duplicate_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``_key, doc_id, first, last``: ranges of window starts whose windows also start elsewhere."""
    if length < gram or length <= STEP:
        raise ValueError("a window must be longer than a block and hold an anchor")
    spark = docs.sparkSession
    texts = _texts(docs).drop("id")
    anchors = run_table(texts, length, gram).groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor")
    anchors = saved(anchors, "anchors")
    found = saved(run_table(texts, length, gram).join(anchors, "anchor", "left_semi"), "runs")
    _released(spark)
    kinds = saved(found.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("_key", "doc_id", "begin")).alias("one")), "kinds")
    per_anchor = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    equal = kinds.filter("c > 1").select("anchor", "whole", F.col("c").alias("_n"))
    all_equal = join_unique(found, equal.drop("_n"), ["anchor", "whole"], "left_semi", counts=equal).select(
        "_key", "doc_id", F.col("begin").alias("first"), (F.col("begin") + F.col("n") - 1).alias("last"))
    # one run of each kind stands for it where anchors have several kinds
    some = kinds.join(per_anchor, "anchor").select("anchor", "whole", "one", (F.col("c") == 1).alias("single"), (F.col("kinds") > crowd).alias("hot"))
    some = some.join(found.select("anchor", "whole", F.struct("_key", "doc_id", "begin").alias("one"), "n", "lead"), ["anchor", "whole", "one"])
    by_doc = saved(some.groupBy("one._key", "one.doc_id", "hot").agg(F.collect_set(F.struct(
        "anchor", "one.begin", F.col("n").cast("int").alias("n"), F.col("lead").cast("int").alias("lead"), "single")).alias("runs")), "rims")
    _released(spark)
    n, hot = by_doc.agg(F.sum(F.when(~F.col("hot"), F.size("runs"))), F.max("hot")).first()
    spans = [all_equal]
    if n or hot:
        once = texts.filter(F.length("bytes") >= length)
        own = by_doc.select(F.col("_key").alias("_k"), F.col("doc_id").alias("_d"), "hot", "runs")
        rims = once.join(own, (F.col("_key") == F.col("_k")) & (F.col("doc_id") == F.col("_d"))).select("_key", "doc_id", "hot", "bytes", "runs")
        rims = saved(rims, "texts")
        if n:
            blocks = sorted_runs(rims.filter(~F.col("hot")).drop("hot"), int(n // MERGE + 1), length)
            spans.append(saved(merged(blocks, length), "merged"))
        if hot:
            spans.append(saved(crowded(rims.filter("hot").drop("hot"), length), "crowded"))
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def remove_duplicates(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``doc_id, kept`` (bytes left)``, n_bytes, n_removed, n_spans``, one row per document."""
    spans = duplicate_spans(docs, length, gram, crowd)
    ranges = spans.groupBy("_key", "doc_id").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    ranges = saved(ranges, "spans").select(F.col("_key").alias("_k"), F.col("doc_id").alias("_d"), "spans")
    _released(docs.sparkSession)
    joined = _texts(docs).join(ranges, (F.col("_key") == F.col("_k")) & (F.col("doc_id") == F.col("_d")), "left")

    @F.pandas_udf("kept binary, n_removed long, n_spans long")
    def cut(data: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(data, spans):
            kept, upto, count = [], 0, 0
            end = 0
            for r in sorted((s["first"], s["last"]) for s in own) if own is not None else ():
                if r[0] > end or not count:
                    kept.append(text[end:r[0]])
                    count += 1
                end = max(end, r[1] + length)
            kept.append(text[end:])
            left = b"".join(kept)
            out.append((left, len(text) - len(left), count))
        return pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])

    return joined.select(F.col("id").alias("doc_id"), F.octet_length("bytes").cast("long").alias("n_bytes"), cut("bytes", "spans").alias("c")).select(
        "doc_id", "n_bytes", "c.n_removed", "c.n_spans", "c.kept")

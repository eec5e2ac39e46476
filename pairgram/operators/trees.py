"""Boosted trees fitted on the slots that are not zero (M1, M2): MLlib's method and model, without its dense rows.

MLlib holds a training row as an array of all slots and sums a histogram of all slots for each node and task. Here a slot is a
column of its rows that are not zero, with their bins; columns are dealt to blocks by slot. A block finds the best split of each
node of a level by itself, the rows with zero being those that the node has more, so nothing is summed across tasks. The driver
holds a label, a prediction, a gradient and a node for each training row (some 40 bytes) and sends the last two to the blocks.

Candidate thresholds, gains, residuals and leaves are MLlib's (variance as impurity, all rows for the thresholds). Gradients are
compared as whole multiples of a power of two, so sums are exact: splits that part the rows alike have the same gain and the
first slot wins. In MLlib the last bit of the sums decides there, which hangs on how the rows lie in their partitions.
"""

from __future__ import annotations

import math
import pickle
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that are not zero in a block of columns.
BLOCK = 1 << 19
#: Bins of all nodes that a block sums at once.
SUMS = 1 << 22
#: Blocks (about 4 MB each) that the driver searches itself: a job for each level would take longer.
NEAR_BLOCKS = 2
#: Bytes of row numbers that a level's splits may bring to the driver unasked.
ROWS_BYTES = 32 << 20


def thresholds(values: np.ndarray, n_rows: int, max_bins: int) -> np.ndarray:
    """MLlib's candidate splits of one slot: ``values`` are those that are not zero, ascending."""
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    distinct, counts = values[first], np.diff(np.r_[first, len(values)])
    if len(values) < n_rows:
        zero = np.searchsorted(distinct, 0.0)
        distinct, counts = np.insert(distinct, zero, 0.0), np.insert(counts, zero, n_rows - len(values))
    between = (distinct[:-1] + distinct[1:]) / 2
    most = min(max_bins, n_rows) - 1
    if len(between) <= most:
        return between
    # a threshold is put where the count of the values below it is nearest to the target, which then goes on by a stride
    seen = np.cumsum(counts)
    middle = seen[:-1] + seen[1:]
    stride = target = n_rows / (most + 1)
    found, at = [], 0
    while (at := max(at, int(np.searchsorted(middle, 2 * target, "right")))) < len(middle):
        found.append(between[at])
        at, target = at + 1, target + stride
    return np.array(found)


def _columns(ids: np.ndarray, max_bins: int):
    """Makes a partition of ``idx, value, row``, sorted so, one block of columns; slots without a split are left out."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("idx", pa.int64()), ("value", pa.float64()), ("row", pa.int64())]))
        idx, value, row = (table[c].to_numpy() for c in ("idx", "value", "row"))
        row = np.searchsorted(ids, row).astype(np.int32)
        first = np.flatnonzero(np.r_[True, idx[1:] != idx[:-1]]) if len(idx) else np.zeros(0, np.int64)
        slots, firsts, limits, zeros, bins, rows, n = [], [], [], [], [], [], 0
        for lo, hi in zip(first, np.r_[first[1:], len(idx)]):
            cut = thresholds(value[lo:hi], len(ids), max_bins)
            if len(cut):
                slots.append(idx[lo])
                firsts.append(n)
                limits += [cut, [np.inf]]
                zeros.append(n + np.searchsorted(cut, 0.0))
                bins.append(n + np.searchsorted(cut, value[lo:hi]))
                rows.append(row[lo:hi])
                n += len(cut) + 1
        if slots:
            parts = (np.array(slots, np.int64), np.array([*firsts, n], np.int64), np.concatenate(limits).astype(float), np.array(zeros, np.int64),
                     np.concatenate(bins).astype(np.int32), np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], list(BLOCK_COLUMNS))
    return make


BLOCK_COLUMNS = {"slots": np.int64, "firsts": np.int64, "limits": float, "zeros": np.int64, "bins": np.int32, "rows": np.int32}


def _arrays(row) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[c], t) for c, t in BLOCK_COLUMNS.items())


def best_splits(block: tuple[np.ndarray, ...], node: np.ndarray, gradient: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> dict:
    """``{node: (gain, slot, threshold, bin)}``: each node's best split on the block's columns, of equal ones the first.

    ``node`` is the place of a row's node in ``sums`` and ``counts``, or -1; gradients are whole numbers.
    """
    slots, firsts, limits, zeros, bins, rows = block
    n_bins, found = len(limits), {}
    slot_of = np.repeat(np.arange(len(slots)), np.diff(firsts))
    at = node[rows]
    each = max(1, SUMS // n_bins)
    for low in range(0, len(sums), each):
        few = min(each, len(sums) - low)
        here = np.flatnonzero((at >= low) & (at < low + few))
        if not len(here):
            continue
        keys = (at[here] - low) * np.int64(n_bins) + bins[here]
        count = np.bincount(keys, minlength=few * n_bins)
        key = np.flatnonzero(count)
        total = np.bincount(keys, gradient[rows[here]], few * n_bins)[key].astype(np.int64)
        count = count[key]
        # the rows of the node that are zero in the slot
        k, column = key // n_bins, slot_of[key % n_bins]
        group = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (column[1:] != column[:-1])])
        gk = k[group]
        rest = counts[low + gk] - np.add.reduceat(count, group)
        some = rest > 0
        key = np.r_[key, (gk * n_bins + zeros[column[group]])[some]]
        total = np.r_[total, (sums[low + gk] - np.add.reduceat(total, group))[some]]
        count = np.r_[count, rest[some]]
        order = np.argsort(key, kind="stable")
        key, total, count = key[order], total[order], count[order]
        k, column = key // n_bins, slot_of[key % n_bins]
        same = (k[1:] == k[:-1]) & (column[1:] == column[:-1])
        start = np.flatnonzero(np.r_[True, ~same])
        of = np.cumsum(np.r_[0, ~same])
        left, n_left = np.cumsum(total), np.cumsum(count)
        left, n_left = left - (left[start] - total[start])[of], n_left - (n_left[start] - count[start])[of]
        cut = np.flatnonzero(same & (key[1:] != key[:-1]))
        k, left, n_left = k[cut], left[cut], n_left[cut]
        n = counts[low + k]
        n_right = n - n_left
        apart = left / n_left - (sums[low + k] - left) / n_right
        gain = (n_left * n_right) / (n * n) * apart * apart
        ends = np.searchsorted(k, np.arange(few + 1))
        for j in range(few):
            if ends[j] < ends[j + 1]:
                i = ends[j] + int(np.argmax(gain[ends[j]:ends[j + 1]]))
                b = int(key[cut[i]] % n_bins)
                found[low + j] = (float(gain[i]), int(slots[slot_of[b]]), float(limits[b]), b)
    return found


def split_rows(block: tuple[np.ndarray, ...], b: int, k: int, node: np.ndarray) -> tuple[bool, np.ndarray]:
    """Whether zero goes left at the split after bin ``b``, and the rows of node ``k`` that go the other way."""
    _, firsts, _, zeros, bins, rows = block
    slot = int(np.searchsorted(firsts, b, "right")) - 1
    zero_left = bool(zeros[slot] <= b)
    lo, hi = np.searchsorted(bins, [b + 1, firsts[slot + 1]] if zero_left else [firsts[slot], b + 1])
    away = rows[lo:hi]
    return zero_left, away[node[away] == k]


class _Grower:
    """Grows a tree on the blocks, level by level: a job finds the splits, and one asks the winning blocks for their rows if they are many."""

    def __init__(self, blocks, n_blocks: int, sc, max_depth: int):
        self.blocks, self.n_blocks, self.sc, self.max_depth = blocks, n_blocks, sc, max_depth
        self.near = blocks.collect() if n_blocks <= NEAR_BLOCKS else None

    def grow(self, target: np.ndarray) -> tuple[dict[int, tuple[int, float]], np.ndarray]:
        """``{node: (slot, threshold)}`` of the inner nodes (children of i are 2i and 2i + 1, the root is 1) and each row's leaf."""
        at, splits = np.ones(len(target), np.int64), {}
        largest = float(np.abs(target).max())
        if largest == 0:
            return splits, at
        whole = np.rint(target * 2.0 ** math.floor(52 - math.log2(len(target) * largest)))
        level = [1]
        for _ in range(self.max_depth):
            mixed = [i for i in level if np.ptp(whole[at == i])]
            if not mixed:
                break
            place = np.full(max(int(at.max()), *mixed) + 1, -1, np.int32)
            place[mixed] = np.arange(len(mixed))
            node = place[at]
            inside = node >= 0
            counts = np.bincount(node[inside], minlength=len(mixed))
            sums = np.bincount(node[inside], whole[inside], len(mixed)).astype(np.int64)
            # few rows come with each block's best splits, many are asked for where a split has won
            few = self.near is not None or self.n_blocks * inside.sum() * 4 <= ROWS_BYTES
            best, search = {}, _search(node, whole, sums, counts, few)
            for found in search(0, self.near) if self.near is not None else self.blocks.mapPartitionsWithIndex(search).collect():
                for k, split in found.items():
                    if split[0] > 0 and (k not in best or (-split[0], split[1]) < (-best[k][0], best[k][1])):
                        best[k] = split
            if not best:
                break
            if few:
                parted = [(k, *split[-1]) for k, split in best.items()]
            else:
                parted = self.sc.runJob(self.blocks.mapPartitionsWithIndex(_ask(node, best)), list, sorted({split[4] for split in best.values()}))
            for k, zero_left, away in parted:
                i, own = mixed[k], node == k
                at[own] = 2 * i + (0 if zero_left else 1)
                at[away] = 2 * i + (1 if zero_left else 0)
            splits |= {mixed[k]: split[1:3] for k, split in best.items()}
            level = [c for k in best for c in (2 * mixed[k], 2 * mixed[k] + 1)]
        return splits, at


def _search(node, gradient, sums, counts, with_rows):
    def run(part, blocks):
        for j, block in enumerate(blocks):
            found = best_splits(block, node, gradient, sums, counts)
            yield {k: (*split, part, j, split_rows(block, split[3], k, node) if with_rows else None) for k, split in found.items()}
    return run


def _ask(node, best):
    def run(part, blocks):
        for j, block in enumerate(blocks):
            for k, (_, _, _, b, p, own, _) in best.items():
                if (p, own) == (part, j):
                    yield (k, *split_rows(block, b, k, node))
    return run


def boosted(vectors: DataFrame, entries: DataFrame, classify: bool, max_iter: int, max_depth: int, step: float, max_bins: int) -> tuple[list, list[float]]:
    """Trees and their weights. ``vectors`` has ``row, label, n`` (n: values of the row), ``entries`` has ``row, idx, value``, both written.

    A tree is ``(splits, {node: (count, sum, sum of squares)})``; a node's value is its mean.
    """
    spark = vectors.sparkSession
    table = vectors.toArrow()
    order = np.argsort(table["row"].to_numpy())
    ids, label = table["row"].to_numpy()[order], table["label"].to_numpy()[order].astype(float)
    if not len(ids):
        raise ValueError("no training rows")
    if classify:
        if not np.isin(label, (0.0, 1.0)).all():
            raise ValueError("labels must be 0 or 1")
        label = 2 * label - 1
    n_blocks = max(1, -(-int(table["n"].to_numpy().sum()) // BLOCK))
    dealt = entries.select("idx", "value", "row").repartition(n_blocks, "idx").sortWithinPartitions("idx", "value", "row")
    made = dealt.mapInArrow(_columns(ids, max_bins), ", ".join(f"{c} binary" for c in BLOCK_COLUMNS))
    blocks = made.rdd.map(_arrays).persist(StorageLevel.MEMORY_AND_DISK)
    grower = _Grower(blocks, n_blocks, spark.sparkContext, max_depth)
    trees, weights, seen = [], [], np.zeros(len(ids))
    try:
        for t in range(max_iter):
            if t == 0:
                target, weight = label, 1.0
            elif classify:
                target, weight = 4 * label / (1 + np.exp(2 * label * seen)), step
            else:
                target, weight = 2 * (label - seen), step
            splits, at = grower.grow(target)
            size = int(at.max()) + 1
            stats = np.stack([np.bincount(at, x, size) for x in (np.ones(len(at)), target, target * target)])
            for i in range(size - 1, 1, -1):  # an inner node holds its children
                stats[:, i // 2] += stats[:, i]
            seen = seen + weight * (stats[1] / np.maximum(stats[0], 1))[at]
            trees.append((splits, {i: tuple(map(float, stats[:, i])) for i in range(1, size) if stats[0, i]}))
            weights.append(weight)
    finally:
        blocks.unpersist()
    return trees, weights


def as_model(spark, estimator, trees: list, weights: list[float], n_features: int):
    """The trees as the estimator's own MLlib model."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    ml = jvm.org.apache.spark.ml
    regressor, leaf, inner, limit_at = ml.regression.DecisionTreeRegressionModel, ml.tree.LeafNode, ml.tree.InternalNode, ml.tree.ContinuousSplit
    calculator = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

    def array_of(kind, items):
        out = gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    def spread(stats):
        count, total, squares = stats
        return (squares - total * total / count) / count

    def node(splits, stats, held, i):
        count, total, _ = stats[i]
        own = calculator(held[i], int(count))
        if i not in splits:
            return leaf(total / count, spread(stats[i]), own)
        left, right = node(splits, stats, held, 2 * i), node(splits, stats, held, 2 * i + 1)
        gain = spread(stats[i]) - sum(stats[c][0] / count * spread(stats[c]) for c in (2 * i, 2 * i + 1))
        return inner(total / count, spread(stats[i]), gain, left, right, limit_at(*splits[i]), own)

    made = []
    for t, (splits, stats) in enumerate(trees):
        sent = ml.python.MLSerDe.loads(bytearray(pickle.dumps([array("d", x) for x in stats.values()], 2)))
        made.append(regressor(f"{estimator.uid}_{t}", node(splits, stats, dict(zip(stats, sent)), 1), n_features))
    kind = ml.classification.GBTClassificationModel if "Classifier" in type(estimator).__name__ else ml.regression.GBTRegressionModel
    model = kind(estimator.uid, array_of(regressor, made), array_of(jvm.double, weights), n_features)
    return estimator._copyValues(estimator._create_model(model))

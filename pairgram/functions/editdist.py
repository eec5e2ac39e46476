"""Normalised edit distance over token lists, divided by the length of the
longest optimal alignment.

    0.0 if the lists are equal; 1.0 if exactly one is empty; else d / l, where d
    is the Levenshtein distance and l the longest alignment among those of
    cost d.

With g the inserted and deleted items of an alignment of n and m items, l = (n + m + g) / 2, so the longest of the
cheapest has the most of them. A DP cell carries the pair (d, g) as one integer ``v = d * K - g`` with K a power of two
above every g: a match adds 0, an exchange K, an insertion or deletion K - 1, and the lexicographic optimum (min d,
then max g) is the plain minimum of v. Cells of an anti-diagonal do not depend on each other, so a diagonal is six numpy
operations over blocks of 32-bit numbers (64-bit for lists too long for them). Pairs of one Arrow batch with similar
lengths are stacked side by side, and only the cells inside the longest lists of the stack are swept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

GROUP_CELLS = 1 << 15  # cells of a stacked diagonal, so that it stays in the processor's cache
STEP = 6000  # cells that take as long as the calls of one diagonal
NEAR = 1.25  # short lists of about the same length, to sort by


def _cost(n, m, k):
    """Time of a stack of k pairs, in cells."""
    return (n + m) * STEP + n * m * k


def _coded(lefts: pa.ListArray, rights: pa.ListArray) -> list[list[np.ndarray]]:
    """Both columns' lists as arrays of integers, equal where the items are; a null list is empty."""
    items = pa.concat_arrays([lefts.flatten(), rights.flatten()]).dictionary_encode(null_encoding="encode")
    codes, at, out = items.indices.to_numpy(zero_copy_only=False), 0, []
    for column in (lefts, rights):
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)) + at
        out.append(np.split(codes[:ends[-1] if len(ends) else at], ends[:-1]) if not at else np.split(codes[at:], ends[:-1] - at))
        at = int(ends[-1]) if len(ends) else at
    return out


def _sweep(group):
    """DP over a group of (short, long) code arrays; returns d and g of each pair."""
    n = np.array([len(r) for r, _ in group])
    m = np.array([len(c) for _, c in group])
    nmax, mmax, k = int(n.max()), int(m.max()), len(group)
    shift = (nmax + mmax + 1).bit_length()
    cost = 1 << shift
    # costs are at most mmax * cost
    most = max(mmax, *(int(x.max()) for pair in group for x in pair))
    kind = np.int32 if most.bit_length() + shift < 31 else np.int64
    rows = np.zeros((nmax, k), dtype=kind)
    cols = np.zeros((mmax, k), dtype=kind)  # from the last item to the first
    for i, (r, c) in enumerate(group):
        rows[:len(r), i] = r
        cols[mmax - len(c):, i] = c[::-1]
    rows <<= shift
    cols <<= shift
    before, last, now, other = (np.zeros((nmax + 1, k), dtype=kind) for _ in range(4))
    last[:2] = cost - 1
    last[0] = cost - 1
    ends = n + m
    order = np.argsort(ends, kind="stable")
    due, found = 0, np.empty(k, dtype=np.int64)
    for t in range(1, nmax + mmax + 1):
        if t > 1:
            lo, hi = max(1, t - mmax), min(nmax, t - 1)  # cells (i, t - i) that are not on an edge
            x, y = now[lo:hi + 1], other[lo:hi + 1]
            # the items differ: codes are multiples of cost, so the lesser of cost and their difference in bits is 0 or cost
            np.bitwise_xor(rows[lo - 1:hi], cols[mmax - t + lo:mmax - t + hi + 1], out=x)
            np.minimum(x, cost, out=x)
            np.add(x, before[lo - 1:hi], out=x)
            np.minimum(last[lo - 1:hi], last[lo:hi + 1], out=y)
            np.add(y, cost - 1, out=y)
            np.minimum(x, y, out=x)
            if t <= mmax:
                now[0] = t * (cost - 1)
            if t <= nmax:
                now[t] = t * (cost - 1)
            before, last, now = last, now, before
        while due < k and ends[order[due]] == t:
            found[order[due]] = last[n[order[due]], order[due]]
            due += 1
    d = (found + cost - 1) >> shift
    return d, d * cost - found


def nlevenshtein_many(lefts, rights) -> np.ndarray:
    """Normalised distance for each pair of sequences (lists or Arrow lists)."""
    lefts, rights = (x if isinstance(x, pa.Array) else pa.array([None if v is None else list(v) for v in x], pa.list_(pa.string())) for x in (lefts, rights))
    size = len(lefts)
    res = np.zeros(size, dtype=np.float64)
    work = []
    for i, (a, b) in enumerate(zip(*_coded(lefts, rights))) if size else ():
        if np.array_equal(a, b):
            res[i] = 0.0
        elif not len(a) or not len(b):
            res[i] = 1.0
        else:
            work.append((i, a, b) if len(a) <= len(b) else (i, b, a))
    if not work:
        return res
    work.sort(key=lambda w: (int(np.log(len(w[1])) / np.log(NEAR)), len(w[2]), len(w[1])))
    start = 0
    while start < len(work):
        n, m, end = len(work[start][1]), len(work[start][2]), start + 1
        # a pair joins the stack if its padding costs less than a sweep of its own
        while end < len(work):
            own = len(work[end][1]), len(work[end][2])
            wide, k = (max(n, own[0]), max(m, own[1])), end - start
            if (k + 1) * wide[0] > GROUP_CELLS or _cost(*wide, k + 1) - _cost(n, m, k) > _cost(*own, 1):
                break
            (n, m), end = wide, end + 1
        chunk = work[start:end]
        d, g = _sweep([(w[1], w[2]) for w in chunk])
        for (i, a, b), dd, gg in zip(chunk, d.tolist(), g.tolist()):
            res[i] = 2.0 * dd / (len(a) + len(b) + gg)
        start = end
    return res


@F.arrow_udf(DoubleType())
def nlevenshtein_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(nlevenshtein_many(a, b))


def nlevenshtein(a: Column, b: Column) -> Column:
    """Column form of E1 over two array columns."""
    return nlevenshtein_udf(a, b)

"""Prefix trie of rebuilt conversations from composable fingerprints.

A conversation is rebuilt from the first turns of its group's base conversation and
its own turns after as many. A node of the trie is a distinct sequence of first
turns. No rebuilt text is made: a turn is stored once, by a reference to its
content (a 128-bit hash of role and text), and a sequence's fingerprint is the
polynomial sum of x * B^i over its turns in four lanes modulo 2^31 - 1, an element of
the monoid of (sum, length). Fingerprints of sequences put together follow from
those of the parts, so base head and own suffix are combined symbolically: the
suffix's share is a difference of two prefix sums times a power of B.

Prefix sums run over all turns of a conversation: turns are range partitioned, so
that a conversation of any length is divided; each task sums its part, and parts of
a divided conversation (at most two rows for each border of partitions) are combined.

Equality is verified, not assumed: turns that share a reference must be equal
texts, and the members of a node must share the parent's fingerprint and the last
turn's reference, which by induction makes their whole sequences equal. If a check
fails, all is done again with another seed.

Subtree sums need no walk by depth: a node belongs to its smallest member, whose
nodes are an unbroken tail of its path. The sum over a subtree is the sum of all its
members' own totals, less what the node's owner owns above it. Each is an
aggregate with partial sums.

Defined cases: turns without conv_id belong to no conversation and are left out; turns
are ordered by turn (null first), equal turns by reference; null role or text is empty;
repeated rows are turns each; the base of a negative conv_id is the next smaller
multiple. An empty table has no nodes. Extra columns are not touched.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairgram.llm.common import is_empty, join_unique, saved

GROUP = 5
HEADS = 9
#: Modulus of each of the four lanes.
P = (1 << 31) - 1
LANES = 4
#: Depths per block of a running sum, and ids per block of a list of ids.
BLOCK = 4096
IDS = 1 << 16

KEY = ["depth", "f1", "f2"]


def bases(seed: int) -> list[int]:
    draw = random.Random(seed)
    return [draw.randrange(2, P - 1) for _ in range(LANES)]


def unpack(c1: Column, c2: Column) -> list[Column]:
    return [F.shiftright(c1, 31), c1.bitwiseAND(F.lit(P)), F.shiftright(c2, 31), c2.bitwiseAND(F.lit(P))]


def pack(lanes: list[Column], n1: str, n2: str) -> list[Column]:
    return [F.shiftleft(lanes[0], 31).bitwiseOR(lanes[1]).alias(n1), F.shiftleft(lanes[2], 31).bitwiseOR(lanes[3]).alias(n2)]


def affine(add: list[Column], times: list[Column], lanes: list[Column]) -> list[Column]:
    """add + times * lanes in each lane."""
    return [(a + t * x) % F.lit(P) for a, t, x in zip(add, times, lanes)]


def references(conversations: DataFrame, seed: int, bits: int = 64) -> DataFrame:
    """``conv, turn, role, text, r1, r2``: the turns with their content references (``bits`` of each half, fewer in tests only)."""
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    half = lambda n: F.shiftrightunsigned(F.xxhash64(F.lit(2 * seed + n), "role", "text"), 64 - bits)
    return turns.withColumns({"r1": half(0), "r2": half(1)})


def references_hold(turns: DataFrame) -> bool:
    """Whether equal references mean equal turns, by comparing the texts themselves (partial sums first)."""
    said = F.struct("role", "text")
    return is_empty(turns.groupBy("r1", "r2").agg(F.min(said).alias("a"), F.max(said).alias("b")).filter("a != b"))


def _lanes(r1: np.ndarray, r2: np.ndarray) -> np.ndarray:
    low, high = np.uint64(P), np.uint64(32)
    a, b = r1.view(np.uint64), r2.view(np.uint64)
    return np.stack([a & low, (a >> high) & low, b & low, (b >> high) & low]) % np.uint64(P)


def local_sums(turns: DataFrame, base: list[int]) -> DataFrame:
    """Range partition the turns and sum within each part of a conversation.

    Adds ``part, at`` (place in the part's run of the conversation, from 1), the sums up to
    and with the turn ``u1, u2`` and before it ``v1, v2``, and ``w1, w2``: B to the power ``at``.
    """
    names = ["conv", "r1", "r2", "n_bytes"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        p = np.uint64(P)
        powers, last, done, carried = np.ones((LANES, 1), dtype=np.uint64), None, 0, np.zeros((LANES, 1), dtype=np.uint64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            while powers.shape[1] <= n:
                step = np.array([[pow(b, powers.shape[1], P)] for b in base], dtype=np.uint64)
                powers = np.concatenate([powers, powers * step % p], axis=1)
            conv = batch.column("conv").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            at = np.arange(n) - starts[run] + 1
            power = powers[:, at]
            goes_on = conv[0] == last and last is not None
            first = run == 0
            if goes_on:
                power[:, first] = power[:, first] * np.array([[pow(b, done, P)] for b in base], dtype=np.uint64) % p
            else:
                done, carried = 0, np.zeros((LANES, 1), dtype=np.uint64)
            term = _lanes(batch.column("r1").to_numpy(), batch.column("r2").to_numpy()) * power % p
            total = np.cumsum(term, axis=1)
            upto = total - (total[:, starts] - term[:, starts])[:, run]
            upto[:, first] += carried
            upto %= p
            before = (upto + p - term) % p
            at[first] += done
            last, done, carried = conv[-1], int(at[-1]), upto[:, -1:]
            pair = lambda x, i: pa.array((x[i] << np.uint64(31) | x[i + 1]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(np.full(n, part)), pa.array(at), pair(upto, 0), pair(upto, 2),
                 pair(before, 0), pair(before, 2), pair(power, 0), pair(power, 2)],
                names=[*names, "part", "at", "u1", "u2", "v1", "v2", "w1", "w2"])

    order = ["conv", "turn", "r1", "r2", "tie"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).select(*names)
    return ranged.mapInArrow(sums, ", ".join(f"{c} long" for c in [*names, "part", "at", "u1", "u2", "v1", "v2", "w1", "w2"]))


def offsets(local: DataFrame) -> DataFrame:
    """``conv, part, o_at, o1, o2, ow1, ow2``: what the parts of a divided conversation have before them.

    Only conversations in several parts have rows: at most two for each border between partitions.
    """
    ends = local.groupBy("conv", "part").agg(F.max("at").alias("n"), F.max_by(F.struct("u1", "u2", "w1", "w2"), "at").alias("e"))
    several = ends.groupBy("conv").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("conv")
    ends = ends.join(several, "conv", "left_semi").select("conv", "part", "n", "e.*")

    def split(a: int, b: int) -> list[int]:
        return [a >> 31, a & P, b >> 31, b & P]

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        n, total, power, out = 0, [0] * LANES, [1] * LANES, []
        for r in rows.sort_values("part").itertuples():
            out.append((r.conv, r.part, n, total[0] << 31 | total[1], total[2] << 31 | total[3], power[0] << 31 | power[1], power[2] << 31 | power[3]))
            total = [(t + w * x) % P for t, w, x in zip(total, power, split(int(r.u1), int(r.u2)))]
            power = [w * x % P for w, x in zip(power, split(int(r.w1), int(r.w2)))]
            n += int(r.n)
        return pd.DataFrame(out, columns=["conv", "part", "o_at", "o1", "o2", "ow1", "ow2"])

    return ends.groupBy("conv").applyInPandas(combine, "conv long, part long, o_at long, o1 long, o2 long, ow1 long, ow2 long")


def prefix_sums(turns: DataFrame, base: list[int]) -> DataFrame:
    """``conv, pos, r1, r2, n_bytes, u1, u2, v1, v2``: each turn with its place and the sums up to it and before it."""
    local = saved(local_sums(turns, base), "local_sums")
    shift = saved(offsets(local), "offsets")
    joined = local.join(F.broadcast(shift), ["conv", "part"], "left")
    one = F.lit((1 << 31) | 1)
    add = unpack(F.coalesce("o1", F.lit(0)), F.coalesce("o2", F.lit(0)))
    times = unpack(F.coalesce("ow1", one), F.coalesce("ow2", one))
    return joined.select("conv", (F.col("at") + F.coalesce("o_at", F.lit(0))).alias("pos"), "r1", "r2", "n_bytes",
                         *pack(affine(add, times, unpack(F.col("u1"), F.col("u2"))), "u1", "u2"),
                         *pack(affine(add, times, unpack(F.col("v1"), F.col("v2"))), "v1", "v2"))


def paths(prefixes: DataFrame, base: list[int], group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """``conv, depth, f1, f2, p1, p2, r1, r2, n_bytes, is_end``: every rebuilt conversation at each of its depths.

    f is the fingerprint of the first ``depth`` turns, p that of one turn less, r the last turn's reference.
    """
    turn = F.struct("pos", "u1", "u2", "v1", "v2", "r1", "r2", "n_bytes")
    convs = saved(prefixes.groupBy("conv").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("pos") < heads, turn))).alias("heads")), "heads")
    other = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"), F.col("heads").alias("base_heads"))
    h = (F.crc32(F.col("conv").cast("string")) % heads).cast("int")
    plan = convs.withColumns({"h": h, "base": F.col("conv") - F.pmod("conv", F.lit(group))}).join(other, "base", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))).cast("int"))
    none = F.lit(0).cast("long")
    end = lambda xs, i, f: F.coalesce(F.when(i > 0, F.get(xs, i - 1)[f]), none)
    inverse = [pow(b, -1, P) for b in base]
    power = [F.element_at(F.array(*[F.lit(pow(v, k, P)).cast("long") for k in range(heads)]), F.col("h") - F.col("taken") + 1) for v in inverse]
    # head + (own sum - own sum of the first h) / B^(h - taken): the suffix moved to where the head ends
    own = unpack(end(F.col("heads"), F.col("h"), "u1"), end(F.col("heads"), F.col("h"), "u2"))
    head = unpack(end(F.col("base_heads"), F.col("taken"), "u1"), end(F.col("base_heads"), F.col("taken"), "u2"))
    plan = plan.select("conv", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
                       *pack(power, "i1", "i2"), *pack(affine(head, [F.lit(P) - x for x in power], own), "a1", "a2"),
                       F.slice("base_heads", F.lit(1), F.col("taken")).alias("head"))
    plan = saved(plan, "plan")
    root = plan.select("conv", none.alias("depth"), *[none.alias(c) for c in ("f1", "f2", "p1", "p2", "r1", "r2", "n_bytes")], (F.col("length") == 0).alias("is_end"))
    heads_ = plan.select("conv", "length", F.inline("head")).select(
        "conv", F.col("pos").alias("depth"), F.col("u1").alias("f1"), F.col("u2").alias("f2"), F.col("v1").alias("p1"), F.col("v2").alias("p2"),
        "r1", "r2", "n_bytes", (F.col("pos") == F.col("length")).alias("is_end"))
    tail = join_unique(prefixes.filter(F.col("pos") > F.crc32(F.col("conv").cast("string")) % heads), plan.drop("head"), ["conv"])
    add, times = unpack(F.col("a1"), F.col("a2")), unpack(F.col("i1"), F.col("i2"))
    depth = F.col("taken") + F.col("pos") - F.col("h")
    tail = tail.select("conv", depth.alias("depth"), *pack(affine(add, times, unpack(F.col("u1"), F.col("u2"))), "f1", "f2"),
                       *pack(affine(add, times, unpack(F.col("v1"), F.col("v2"))), "p1", "p2"), "r1", "r2", "n_bytes", (depth == F.col("length")).alias("is_end"))
    return root.unionByName(heads_).unionByName(tail)


def _fingerprinted(conversations: DataFrame, group: int, heads: int, bits: int) -> tuple[DataFrame, DataFrame, int]:
    """Paths and nodes under the first seed for which both checks of equality hold."""
    for seed in count(1):
        turns, base = references(conversations, seed, bits), bases(seed)
        if not references_hold(turns):
            continue
        narrow = saved(turns.select("conv", "turn", "r1", "r2", F.octet_length("text").cast("long").alias("n_bytes"),
                                    F.monotonically_increasing_id().alias("tie")), "turns")
        prefixes = saved(prefix_sums(narrow, base), "prefixes")
        steps = saved(paths(prefixes, base, group, heads), "paths")
        same = ("p1", "p2", "r1", "r2", "n_bytes")
        nodes = saved(steps.groupBy(*KEY).agg(
            F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in same],
            *[F.max(c).alias(f"{c}_most") for c in same]), "nodes")
        differ = " OR ".join(f"{c} != {c}_most" for c in same)
        if is_empty(nodes.filter(differ)):
            return steps, nodes.drop(*[f"{c}_most" for c in same]), seed


def _ends(steps: DataFrame) -> DataFrame:
    """``depth, f1, f2, ends_sha256``: ids that end in a node are joined block by block and hashed as a stream."""
    at = F.expr(f"conv div {IDS}").alias("block")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    blocks = steps.filter("is_end").groupBy(*KEY, at).agg(ids.alias("ids")).repartition(*KEY).sortWithinPartitions(*KEY, "block")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *k, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if k != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield rows(out)
        if key is not None:
            yield rows([(*key, state.hexdigest())])

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*KEY, "ends_sha256"])

    return blocks.select(*KEY, "ids").mapInArrow(digest, "depth long, f1 long, f2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS, bits: int = 64) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, r1, r2, seed`` (the last turn's reference and its seed, see turns_of)."""
    steps, nodes, seed = _fingerprinted(conversations, group, heads, bits)
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = saved(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saves": (F.col("n_convs") - 1) * F.col("n_bytes"),
                                     "block": F.expr(f"depth div {BLOCK}")}), "children")
    # what each conversation owns in all, and what it owns above each of its nodes
    blocks = nodes.groupBy("conv_id", "block").agg(F.sum("leaf").alias("b_leaf"), F.sum("saves").alias("b_saves"))
    over = Window.partitionBy("conv_id").orderBy("block")
    blocks = blocks.select("conv_id", "block", *[(F.sum(f"b_{c}").over(over) - F.col(f"b_{c}")).alias(f"b_{c}") for c in ("leaf", "saves")])
    within = Window.partitionBy("conv_id", "block").orderBy("depth")
    owned = nodes.join(blocks, ["conv_id", "block"])
    owned = owned.select(*nodes.columns, *[(F.sum(c).over(within) - F.col(c) + F.col(f"b_{c}")).alias(f"{c}_above") for c in ("leaf", "saves")])
    totals = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.sum("leaf").alias("t_leaf"), F.sum("saves").alias("t_saves"))
    sums = join_unique(steps.select(*KEY, "conv"), saved(totals, "totals"), ["conv"]).groupBy(*KEY).agg(
        F.sum("t_leaf").alias("t_leaf"), F.sum("t_saves").alias("t_saves"))
    full = owned.join(sums, KEY).join(_ends(steps), KEY, "left").select(
        *KEY, "conv_id", (F.col("depth") - 1).alias("p_depth"), "p1", "p2", "n_convs", "n_children",
        (F.col("t_leaf") - F.col("leaf_above")).alias("n_leaves"), (F.col("t_saves") - F.col("saves_above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "r1", "r2")
    full = saved(full, "sums")
    parents = full.select(F.col("depth").alias("p_depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    below = join_unique(full.filter("depth > 0"), parents, ["p_depth", "p1", "p2"])
    root = full.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.unionByName(root.select(*below.columns)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "r1", "r2", F.lit(seed).alias("seed"))


def turns_of(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes with the ``role`` and ``text`` of their last turn, looked up by its reference (null for the root)."""
    seed = (nodes.agg(F.first("seed")).first()[0]) or 1
    texts = references(conversations, seed).select("r1", "r2", "role", "text").dropDuplicates(["r1", "r2"])
    root = nodes.filter("depth = 0").withColumns({"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    return nodes.filter("depth > 0").join(texts, ["r1", "r2"]).unionByName(root)

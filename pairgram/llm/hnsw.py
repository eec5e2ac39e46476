"""Approximate nearest neighbours by inner product: one small-world graph per shard.

Distinct vectors are dealt to shards by their hash; equal vectors are one node that
keeps its smallest ids, as many as an answer can name, so copies neither crowd
a graph nor a task. A shard's graph is a hierarchical navigable small world:
every node has a top level, drawn from its hash with geometric odds, and on each of its
levels at most M (2 M on the lowest) links to near nodes that are not nearer to a link already
chosen. It is stored as one row per node with its links as one flat array.

Inner product is made a distance by one more coordinate, sqrt(R - |x|^2) with R the
largest squared norm of the shard: all nodes then have the same norm, and nearness to a
query (0 there) orders as the inner product does. Scores in results are inner
products of the original vectors in double precision.

Nodes go in by level, highest first, in batches that grow with the graph: a batch is searched
in the graph so far, all its rows in step as matrix operations, and among itself exactly.
Search goes down the levels and keeps the best ``beam`` nodes on the lowest.

Queries are sent to every shard of their dimension, in blocks; each shard answers
with its best, and the answers are merged per query.

Defined cases: rows whose vector is null, empty or zero or holds a null or non-finite
component, and rows without vec_id, take no part. Vectors are compared with those of
equal length. Repeated rows count once; rows of one vec_id with different vectors are
different rows. Ties go to the smaller vec_id. A table without such vectors gives no rows. Extra
columns are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairgram.llm.common import join_unique, saved

NEAREST = 20
#: Links per node and level; twice as many on the lowest.
LINKS = 16
#: Nodes kept by a search while a graph is built and when it is asked.
BUILD_BEAM = 64
BEAM = 96
#: Shards of each dimension, and the bytes of vectors that a shard holds in the mean: a table beyond both has more shards.
SHARDS = 8
SHARD_BYTES = 64 << 20
#: Queries that one task answers on one shard.
QUERY_BLOCK = 1 << 15
BATCH = 512


# ------------------------------------------------------------ one graph ----

class Graph:
    """Flat neighbour arrays of one shard: ``links[0]`` is nodes x 2 M, ``links[l]`` nodes x M; -1 fills up."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray] | None = None, m: int = LINKS):
        self.original = vectors
        square = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
        extra = np.sqrt(np.maximum(square.max(initial=0.0) - square, 0.0))
        # one scale for all, so that any finite vector fits single precision
        scale = max(np.sqrt(square.max(initial=0.0)), np.finfo(np.float64).tiny)
        self.vectors = (np.concatenate([vectors, extra[:, None]], axis=1) / scale).astype(np.float32)
        self.levels, self.m = levels, m
        top = int(levels.max(initial=0))
        self.links = links or [np.full((len(vectors), 2 * m if l == 0 else m), -1, dtype=np.int32) for l in range(top + 1)]
        self.entry = int(np.argmax(levels)) if len(levels) else -1

    def search(self, queries: np.ndarray, starts: np.ndarray, level: int, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (-1 fills up) and nearness, best first, of the ``beam`` best found for each query from its starts."""
        n, links = len(queries), self.links[level]
        width = links.shape[1]
        ids = np.full((n, beam), -1, dtype=np.int32)
        near = np.full((n, beam), -np.inf, dtype=np.float32)
        seen = np.zeros((n, len(self.vectors) + 1), dtype=bool)  # the last column stands for -1
        seen[:, -1] = True
        k = min(starts.shape[1], beam)
        ids[:, :k] = starts[:, :k]
        near[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("qkd,qd->qk", self.vectors[ids[:, :k]], queries), -np.inf)
        rows = np.arange(n)
        seen[rows[:, None], ids[:, :k]] = True
        fresh = near > -np.inf
        live = rows[fresh.any(axis=1)]
        expand = min(expand, beam)
        while len(live):
            open_ = np.where(fresh[live], near[live], -np.inf)
            pick = np.argpartition(-open_, expand - 1, axis=1)[:, :expand]
            chosen = np.take_along_axis(ids[live], pick, axis=1)
            chosen[np.take_along_axis(open_, pick, axis=1) == -np.inf] = -1
            fresh[live[:, None], pick] = False
            found = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(live), expand * width)
            found.sort(axis=1)
            again = np.zeros_like(found, dtype=bool)
            again[:, 1:] = found[:, 1:] == found[:, :-1]
            again |= seen[live[:, None], found]
            seen[live[:, None], found] = True
            gain = np.full(found.shape, -np.inf, dtype=np.float32)
            r, c = np.nonzero(~again)
            gain[r, c] = np.einsum("nd,nd->n", self.vectors[found[r, c]], queries[live[r]])
            all_near = np.concatenate([near[live], gain], axis=1)
            best = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
            near[live] = np.take_along_axis(all_near, best, axis=1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], found], axis=1), best, axis=1)
            fresh[live] = np.take_along_axis(np.concatenate([fresh[live], gain > -np.inf], axis=1), best, axis=1)
            live = live[fresh[live].any(axis=1)]
        order = np.argsort(-near, axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        return np.where(near > -np.inf, np.take_along_axis(ids, order, axis=1), -1), near

    def descend(self, queries: np.ndarray, upto: int) -> np.ndarray:
        """The nearest node found on the level above ``upto``, as starts for it."""
        starts = np.full((len(queries), 1), self.entry, dtype=np.int32)
        for level in range(len(self.links) - 1, upto, -1):
            starts = self.search(queries, starts, level, 1)[0]
        return starts

    def pick(self, of: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """From candidates (best first) of each node at most ``most``: those nearer to the node than to any already taken; then the best of the others fill up."""
        n, c = ids.shape
        taken = np.zeros((n, c), dtype=bool)
        v = self.vectors[ids]
        between = np.matmul(v, v.transpose(0, 2, 1))
        closest = np.full((n, c), -np.inf, dtype=np.float32)
        for i in range(c):
            new = (near[:, i] > -np.inf) & (closest[:, i] < near[:, i]) & (taken.sum(axis=1) < most)
            taken[new, i] = True
            closest[new] = np.maximum(closest[new], between[new, i])
        rank = np.where(taken, 0, c) + np.arange(c)
        rank[near == -np.inf] = 2 * c
        order = np.argsort(rank, axis=1)[:, :most]
        out = np.where(np.take_along_axis(near, order, axis=1) > -np.inf, np.take_along_axis(ids, order, axis=1), -1)
        if c < most:
            out = np.concatenate([out, np.full((n, most - c), -1, dtype=out.dtype)], axis=1)
        return out

    def link_back(self, nodes: np.ndarray, chosen: np.ndarray, level: int) -> None:
        """Give each chosen node a link to the new one; full lists are picked anew from old and new links."""
        links = self.links[level]
        most = links.shape[1]
        r, c = np.nonzero(chosen >= 0)
        target, new = chosen[r, c], nodes[r]
        near = np.einsum("nd,nd->n", self.vectors[target], self.vectors[new])
        order = np.lexsort((-near, target))
        target, new = target[order], new[order]
        starts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else np.zeros(0, dtype=int)
        nr = np.arange(len(target)) - np.repeat(starts, np.diff(np.append(starts, len(target))))
        keep = nr < most  # only the nearest of them can stay
        owners = target[starts]
        more = np.full((len(owners), most), -1, dtype=np.int32)
        more[np.searchsorted(owners, target[keep]), nr[keep]] = new[keep]
        for at in range(0, len(owners), BATCH):
            own, add = owners[at:at + BATCH], more[at:at + BATCH]
            add = add[:, :max(1, int((add >= 0).sum(axis=1).max()))]
            add = np.where((add[:, :, None] == links[own][:, None, :]).any(axis=2), -1, add)  # two fellows that chose each other
            both = np.concatenate([links[own], add], axis=1)
            gain = np.where(both >= 0, np.einsum("ncd,nd->nc", self.vectors[both], self.vectors[own]), -np.inf)
            order = np.argsort(-gain, axis=1, kind="stable")
            both, gain = np.take_along_axis(both, order, axis=1), np.take_along_axis(gain, order, axis=1)
            over = (gain > -np.inf).sum(axis=1) > most
            links[own[~over]] = np.where(gain > -np.inf, both, -1)[~over][:, :most]
            if over.any():
                links[own[over]] = self.pick(own[over], both[over], gain[over], most)

    def build(self, beam: int = BUILD_BEAM) -> "Graph":
        order = np.argsort(-self.levels, kind="stable")
        at = 1
        while at < len(order):
            nodes = order[at:at + min(at, BATCH)]
            level_of = self.levels[nodes]
            for level in range(int(level_of.max(initial=0)), -1, -1):
                new = nodes[level_of >= level]
                own = self.vectors[new]
                ids, near = self.search(own, self.descend(own, level), level, beam)
                near[np.isin(ids, new)] = -np.inf  # reached from the level above; they are among the fellows
                fellow = own @ own.T
                np.fill_diagonal(fellow, -np.inf)
                k = min(len(new), self.links[level].shape[1])
                best = np.argpartition(-fellow, k - 1, axis=1)[:, :k]
                ids = np.concatenate([ids, new[best].astype(np.int32)], axis=1)
                near = np.concatenate([near, np.take_along_axis(fellow, best, axis=1)], axis=1)
                rank = np.argsort(-near, axis=1, kind="stable")[:, :beam]
                ids, near = np.take_along_axis(ids, rank, axis=1), np.take_along_axis(near, rank, axis=1)
                chosen = self.pick(new, ids, near, self.m)
                self.links[level][new, :self.m] = chosen
                self.link_back(new, chosen, level)
            at += len(nodes)
        return self

    def nearest(self, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (-1 fills up) and inner products, best first."""
        if len(queries) > BATCH:
            parts = [self.nearest(queries[at:at + BATCH], k, beam) for at in range(0, len(queries), BATCH)]
            return tuple(np.concatenate(x) for x in zip(*parts))
        q = np.concatenate([queries, np.zeros((len(queries), 1), dtype=queries.dtype)], axis=1)
        q = (q / np.maximum(np.abs(q).max(axis=1, keepdims=True), np.finfo(np.float64).tiny)).astype(np.float32)
        ids, _ = self.search(q, self.descend(q, 0), 0, max(beam, k))
        score = np.einsum("qkd,qd->qk", self.original[ids].astype(np.float64), queries.astype(np.float64))
        score = np.where(ids >= 0, score, -np.inf)
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1)


def levels_of(hashes: np.ndarray, m: int = LINKS) -> np.ndarray:
    """Top levels with odds 1/m per step, from bits of the hash that do not choose the shard."""
    u = ((hashes.view(np.uint64) >> np.uint64(24)).astype(np.float64) + 1) / 2.0 ** 40
    return np.floor(-np.log(u) / np.log(m)).astype(np.int64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def flat_links(graph: Graph) -> pa.Array:
    """One flat array per node: its 2 M links of the lowest level, then M for each level up to its own."""
    widths = (2 + graph.levels) * graph.m
    ends = np.cumsum(widths)
    flat = np.full(int(ends[-1]) if len(ends) else 0, -1, dtype=np.int32)
    at = ends - widths
    for level, links in enumerate(graph.links):
        own = np.flatnonzero(graph.levels >= level)
        flat[at[own][:, None] + (level + (level > 0)) * graph.m + np.arange(links.shape[1])] = links[own]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat))


def load(table: pa.Table) -> Graph:
    """The graph of a shard's index rows, in the order of their nodes."""
    levels = table["level"].to_numpy().astype(np.int64)
    flat = table["links"].combine_chunks().flatten().to_numpy()
    m = len(flat) // int((2 + levels).sum())
    at = np.concatenate(([0], np.cumsum((2 + levels) * m)[:-1]))
    links = []
    for level in range(int(levels.max()) + 1):
        width = m if level else 2 * m
        own = np.flatnonzero(levels >= level)
        rows = np.full((len(levels), width), -1, dtype=np.int32)
        rows[own] = flat[at[own][:, None] + (level + (level > 0)) * m + np.arange(width)]
        links.append(rows)
    return Graph(_matrix(table["embedding"]), levels, links, m)


# ---------------------------------------------------------------- Spark ----

def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, embedding, h, dim``: the rows that take part; h is the vector's hash."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id IS NOT NULL AND size(embedding) > 0")
    rows = rows.filter(~F.coalesce(bad, F.lit(True))).filter(F.exists(v, lambda x: x != 0))
    return rows.withColumns({"h": F.xxhash64("embedding"), "dim": F.size("embedding")})


def nodes(rows: DataFrame, k: int = NEAREST) -> DataFrame:
    """``h, embedding, dim, ids``: distinct vectors with their k + 1 smallest ids, all that answers to k nearest can name.

    Tasks drop repeated rows, and all but the smallest ids of a vector, before they shuffle.
    """
    once = usable(rows).groupBy("h", "embedding", "dim", "vec_id").agg(F.lit(1).alias("_"))
    nr = F.row_number().over(Window.partitionBy("h", "embedding", "dim").orderBy("vec_id"))
    few = once.drop("_").withColumn("nr", nr).filter(F.col("nr") <= k + 1)
    return few.groupBy("h", "embedding", "dim").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def build_index(rows: DataFrame, k: int = NEAREST, m: int = LINKS, beam: int = BUILD_BEAM,
                shards: int = SHARDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``dim, shard, node, level, links, h, embedding, ids``, one row per distinct vector, written to the shared folder."""
    distinct = saved(nodes(rows, k), "vectors")
    width = 8 if "double" in dict(distinct.dtypes)["embedding"] else 4
    counts = distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    parts = F.greatest(F.lit(shards), F.ceil(F.col("n") * F.col("dim") * width / shard_bytes))
    dealt = distinct.join(counts, "dim").withColumn("shard", F.pmod("h", parts).cast("int")).drop("n")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")  # the order of arrival does not matter
        graph = Graph(_matrix(table["embedding"]), levels_of(table["h"].to_numpy(), m), m=m).build(beam)
        return pa.table({"dim": table["dim"], "shard": table["shard"], "node": pa.array(np.arange(len(table)), pa.int32()),
                         "level": pa.array(graph.levels, pa.int32()), "links": flat_links(graph), "h": table["h"],
                         "embedding": table["embedding"], "ids": table["ids"]})

    kind = dict(distinct.dtypes)["embedding"]
    schema = f"dim int, shard int, node int, level int, links array<int>, h long, embedding {kind}, ids array<long>"
    return saved(dealt.groupBy("dim", "shard").applyInArrow(build, schema), "graphs")


def search(index: DataFrame, queries: DataFrame, k: int = NEAREST, beam: int = BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for each row of queries (vec_id, embedding), itself left out."""
    own = usable(queries)
    asked = saved(own.groupBy("h", "embedding", "dim").agg(F.lit(1).alias("_")).drop("_").withColumn("qid", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-asked.count() // block))
    of_block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")
    sent = asked.join(saved(index.select("dim", "shard").distinct(), "shards"), "dim").select("dim", "shard", of_block.alias("block"), "qid", "embedding")
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("h", pa.int64()), ("score", pa.float64())])

    def answer(q: pa.Table, table: pa.Table) -> pa.Table:
        if not len(q) or not len(table):
            return schema.empty_table()
        table = table.sort_by("node")
        found, score = load(table).nearest(_matrix(q["embedding"]), k + 1, beam)
        row, col = np.nonzero(found >= 0)
        node, score = found[row, col], score[row, col]
        ids = table["ids"].combine_chunks()
        many = np.diff(ids.offsets.to_numpy())
        # a node names all its ids; of those the first k + 1 by (score, id) can count
        each = many[node]
        at = np.repeat(ids.offsets.to_numpy()[:-1][node], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        row, score, vec_id = np.repeat(row, each), np.repeat(score, each), ids.values.to_numpy()[at]
        h = np.repeat(table["h"].to_numpy()[node], each)
        order = np.lexsort((vec_id, -score, row))
        row = row[order]
        starts = np.searchsorted(row, np.arange(len(q)))
        keep = np.arange(len(row)) - starts[row] <= k
        order, row = order[keep], row[keep]
        return pa.table({"qid": q["qid"].to_numpy()[row], "vec_id": vec_id[order], "h": h[order], "score": score[order]}, schema=schema)

    keys = ["dim", "shard", "block"]
    answers = sent.groupBy(*keys).cogroup(graphs.groupBy(*keys)).applyInArrow(answer, "qid long, vec_id long, h long, score double")
    nr = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "h"))
    best = answers.withColumn("nr", nr).filter(F.col("nr") <= k + 1).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("nr", "vec_id", "h", "score"))).alias("near"))
    per_vector = saved(asked.join(best, "qid").select(F.col("h").alias("qh"), F.col("embedding").alias("qv"), "near"), "answers")
    rows = saved(own.select(F.col("vec_id").alias("query_id"), F.col("h").alias("qh"), F.col("embedding").alias("qv")).distinct(), "asked")
    others = F.filter("near", lambda x: ~((x["vec_id"] == F.col("query_id")) & (x["h"] == F.col("qh"))))
    listed = join_unique(rows, per_vector, ["qh", "qv"]).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))

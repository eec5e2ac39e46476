import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pairgram.llm import common, sharding
from pairgram.llm.sql import sharding_sql

from helpers import awkward, documents


def brute(rows, limit):
    """Split buckets one bit at a time, as the definition says."""
    items = []
    for r in rows:
        name = f"{'' if r[0] is None else r[0]}\x1f{r[1] or ''}"
        items.append((int(hashlib.md5(name.encode()).hexdigest()[:15], 16), len((r[1] or "").encode()) + 1))
    leaves = {}

    def split(bits, own):
        if sum(b for _, b in own) <= limit or len({h for h, _ in own}) == 1:
            leaves[bits] = own
            return
        sides = defaultdict(list)
        for h, b in own:
            sides[h >> (59 - len(bits)) & 1].append((h, b))
        for side, part in sides.items():
            split(bits + str(side), part)

    if items:
        split("", items)
    return leaves


@pytest.mark.parametrize("limit", [50, 400, 5_000, 10**9])
def test_same_shards_as_bit_by_bit_splitting(spark, limit):
    random.seed(limit)
    rows = [(i, "t" * random.randint(0, 90)) for i in range(300)]
    got = sharding.shard_rows(documents(spark, rows), limit).collect()
    want = brute(rows, limit)
    assert len(got) == len(rows)
    assert {(r.shard, r.shard_bytes, r.shard_rows) for r in got} == {(k, sum(b for _, b in v), len(v)) for k, v in want.items()}
    assert all(len(r.shard) == r.depth for r in got)


def test_passes_refine_only_what_is_too_heavy(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STRIDE", 2)
    rows = [(i, "y" * 20) for i in range(200)]
    got = sharding.shard_rows(documents(spark, rows), 60).collect()
    assert {(r.shard, r.shard_rows) for r in got} == {(k, len(v)) for k, v in brute(rows, 60).items()}


def test_equal_rows_fill_pages_within_the_limit(spark, monkeypatch):
    monkeypatch.setattr(common, "CHUNK", 7)
    rows = [(9, "z" * 9)] * 50 + [(10, "q")]
    got = sharding.shard_rows(documents(spark, rows), 35).collect()
    assert len(got) == 51
    weight = defaultdict(int)
    for r in got:
        weight[r.shard] += r.n_bytes
    assert max(weight.values()) <= 35 and len(weight) == 18
    assert all(r.shard_bytes == weight[r.shard] for r in got)


def test_awkward_rows(spark):
    rows = awkward(2_000)
    got = sharding.shard_rows(documents(spark, rows), 200)
    assert [c for c in got.columns if c == "doc_id"] and got.columns.count("shard") == 1
    out = got.collect()
    assert sorted(str((r.doc_id, r.text)) for r in out) == sorted(str(r[:2]) for r in rows)
    assert all(r.shard_bytes <= 200 or r.shard_rows == 1 for r in out)
    assert sharding.shard_rows(documents(spark, []), 200).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(documents(spark, rows), 0)


def test_sql_agrees_with_a_small_limit(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    got = sharding.shard_rows(docs.select("doc_id", "text"), 20_000).drop("text")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.execute(sharding_sql(20_000)).fetchall()
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows").collect())) == sorted(want)

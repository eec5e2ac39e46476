"""The pipeline against its operators' definitions, stage by stage; SQL cannot express the model, XXH64 and the draws."""

from collections import Counter, defaultdict

import corpus_pipeline
from pairgram.llm import chat, mixing, sharding, toxicity

from pairgram.llm.common import saved
from pairgram.llm.queries import QUERIES

from helpers import awkward, documents
from test_decontaminate import brute
from test_mixing import targets
from test_simhash import classes, naive

SF = "/root/testdata/sf0.001"
SCHEMA = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_does_its_part(spark):
    docs, tables = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = saved(stage(spark, docs, SF), name)
        tables[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == SCHEMA
    before, after = tables["toxicity"]
    scored = toxicity.score_documents(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scored if not r.predicted}
    before, after = tables["simhash_near_dedup"]
    rows = before.collect()
    want = classes([(r.doc_id, naive(r.text)) for r in rows])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(want))
    before, after = tables["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = brute([(r.doc_id, r.text) for r in before.collect()], items)
    assert sorted(r.doc_id for r in after.collect()) == sorted(f[0] for f in found if not f[-1])
    before, after = tables["mixing"]
    sizes, taken, source = defaultdict(int), defaultdict(int), {}
    for r in before.collect():
        sizes[r.source] += len((r.text or "").split())
        source[r.doc_id] = r.source
    times = Counter(r.doc_id for r in after.collect())
    for r in after.collect():
        taken[r.source] += len((r.text or "").split())
    longest = max(len((r.text or "").split()) for r in before.collect())
    assert all(abs(taken[s] - t) <= longest for s, t in targets(dict(sizes)).items()) and max(times.values()) <= 3
    before, after = tables["sharding"]
    assert before.count() == after.count() and after.agg({"shard_bytes": "max"}).first()[0] <= sharding.SHARD_BYTES


def test_awkward_tables(spark, tmp_path):
    for name, rows in (("some", awkward(2_000)), ("none", [])):
        folder = tmp_path / name
        documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 0), (2, 0), (None, 1)] if rows else [], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "another text")] if rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, str(folder))
        assert "shard" in out.columns and (out.count() > 0) == bool(rows)


def test_registered_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert chat.CONTROL and mixing.WEIGHTS == (5, 2, 1)

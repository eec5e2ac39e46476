import random

from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pairgram.operators import encode as ENC
from pairgram.operators import model as M
from pairgram.operators import tfidf as TF
from pairgram.sources import precomputed as PC
from pairgram.sources import tsv


def test_codes_of_many_columns(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice("pqrs"), f"v{draw.randrange(50)}", None if i % 7 == 0 else "same") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a string, `b.c` string, d string").withColumnRenamed("b.c", "b")
    enc = ENC.FrameEncoder(["a", "b", "d"]).fit(df)
    got = {r.id: (r.a_code, r.b_code, r.d_code) for r in enc.transform(df, ["id"]).collect()}
    code = [{v: i for i, v in enumerate(sorted({r[k] for r in rows} - {None}))} for k in (1, 2, 3)]
    assert got == {r[0]: tuple(code[k - 1].get(r[k]) for k in (1, 2, 3)) for r in rows}
    unseen = spark.createDataFrame([(1, "zz", "v0", "")], "id long, a string, b string, d string")
    r = enc.transform(unseen, ["id"]).first()
    assert (r.a_code, r.d_code) == (len(code[0]), len(code[2])) and r.b_code == code[1]["v0"]


def test_codes_of_long_values_without_keeping_them(spark, monkeypatch):
    """Values that share their beginning are ordered by all of it, and neither table of the encoder has other whole values."""
    draw = random.Random(2)
    texts = ["x" * n for n in (0, 1, ENC.HEAD - 1, ENC.HEAD, ENC.HEAD + 1, 500)] + ["x" * ENC.HEAD + t for t in ("é", "a", "ab", "ÿ")]
    texts += ["".join(draw.choices("abc", k=2000)) for _ in range(30)]
    df = spark.createDataFrame([(i, draw.choice(texts), t) for i, t in enumerate(texts * 2)], "id long, a string, b string")
    for most in (ENC.SHARED_ROWS, 0):  # by broadcast, by shuffling
        monkeypatch.setattr(ENC, "SHARED_ROWS", most)
        kept = []
        for name in ("stored", "checkpointed"):
            monkeypatch.setattr(ENC, name, lambda d, *rest, f=getattr(ENC, name): (kept.append(f(d, *rest)), kept[-1])[1])
        enc = ENC.FrameEncoder(["a", "b"]).fit(df)
        got = {r.id: (r.a_code, r.b_code) for r in enc.transform(df, ["id"]).collect()}
        code = [{v: i for i, v in enumerate(sorted({r[k] for r in df.collect()}, key=lambda v: v.encode()))} for k in (1, 2)]
        assert got == {r.id: (code[0][r.a], code[1][r.b]) for r in df.collect()}
        assert all(len(c) < 1500 for d in kept for r in d.collect() for c in r if isinstance(c, (str, bytes, bytearray)))
        monkeypatch.undo()


def test_stop_table_of_thousands_of_words(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("\n".join([" The ", "", "the", *(f"s{i}" for i in range(5000))]))
    stop = tsv.read_stop_words(spark, str(tmp_path / "stop.txt"))
    assert stop.count() == 5001
    docs = spark.createDataFrame([(1, "the a s1 b c"), (2, "a b s4999 c"), (3, "s1 s2 s3"), (4, None), (5, "b c")], "doc_id long, text string")
    short = ["the", *(f"s{i}" for i in range(5000))]
    want = {tuple(r) for r in TF.TfidfModel(short, min_df=2).fit(docs).transform(docs).collect()}
    got = {tuple(r) for r in TF.TfidfModel(stop, min_df=2).fit(docs).transform(docs).collect()}
    assert got == want and any(t == "a b c" for _, t, _ in got)


def test_a_large_stop_table_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(TF, "STOP_ROWS", 1)
    docs = spark.createDataFrame([(1, "x y z"), (2, "x z")], "doc_id long, text string")
    stop = spark.createDataFrame([("y",), ("q",), (None,)], "word string")
    assert sorted(r.term for r in TF.TfidfModel(stop, min_df=2).fit(docs).vocab.collect()) == ["x", "x z", "z"]


def test_bucketed_similarities_join_in_place(spark, tmp_path):
    rows = spark.range(500).selectExpr("id div 5 AS conv_id", "id % 5 AS turn", "id / 7 AS similarity", "id / 9 AS similarity_ic")
    PC.write_similarity(rows, str(tmp_path / "s"))
    back = PC.read_similarity(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    table = PC.bucketed(back, "pair_similarity")
    features = spark.range(600).selectExpr("id div 5 AS conv_id", "id % 5 AS turn", "id AS x")
    joined = PC.attach_similarity(features, table)
    assert joined.count() == 600 and joined.filter("similarity IS NULL").count() == 100
    plan = joined._jdf.queryExecution().executedPlan().toString()
    right = plan[plan.index("SortMergeJoin"):].split("FileScan")[0].rsplit("+- Project", 1)[-1]
    assert plan.count("Exchange") == 1 and "Exchange" not in right


def test_vectors_in_stored_form(spark):
    assert M.SPARSE == VectorUDT.sqlType().simpleString()
    vectors = [Vectors.dense([1.0, 0.0, 2.0]), Vectors.sparse(3, [1], [5.0]), Vectors.sparse(3, [], []), Vectors.dense([0.0, 0.0, 0.0])]
    schema = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("features", VectorUDT())])
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate(vectors)], schema)
    assert sorted((r.conv_id, r.idx, r.value) for r in M.matrix_entries(df).collect()) == [(0, 0, 1.0), (0, 2, 2.0), (1, 1, 5.0)]
    full = spark.range(2).select(M.sparse(3, F.array(F.lit(2)), F.array(F.lit(4.0))).alias("v"), "id")
    assert [r.v for r in M.as_vectors(full, ["v"]).collect()] == [Vectors.sparse(3, [2], [4.0])] * 2
    assert M.as_vectors(spark.range(1).select(M.sparse(3, F.array(), F.array()).alias("v")), ["v"]).first().v == Vectors.sparse(3, [], [])


def test_assembled_vectors_name_no_slot_in_the_schema(spark):
    """The names of the slots are a table; in the column's metadata they would be objects on the driver and a part of each file."""
    wide = spark.createDataFrame([(1, 1, 1, 2.0, 0.0), (1, 2, 0, None, float("nan")), (1, 2, 0, -1.0, 3.0)], "conv_id long, turn long, label int, a double, b double")
    size = 50_000
    docs = spark.createDataFrame([(((1, 1), 1), [0, 7], [0.5, 0.0]), (((1, 1), 2), [size - 1], [0.25]), (((1, 2), 2), [3], [1.0])],
                                 "d struct<p:struct<conv_id:long,turn:long>,side:int>, i array<int>, v array<double>")
    docs = docs.select(F.struct("d.p.conv_id", "d.p.turn", "d.side").alias("doc_id"), M.sparse(size, F.col("i"), F.col("v")).alias("tfidf"))
    df = M.assemble(wide, docs, size)
    assert len(df.schema.json()) < 5_000
    got = sorted((r.conv_id, r.turn, r.label, r.n_features, r.nnz, r.features.size, sorted(zip(r.features.indices.tolist(), r.features.values.tolist()))) for r in df.collect())
    n = 2 * size + 2
    assert got == [(1, 1, 1, n, 3, n, [(0, 0.5), (2 * size - 1, 0.25), (2 * size, 2.0)]), (1, 2, 0, n, 1, n, [(size + 3, 1.0)]),
                   (1, 2, 0, n, 3, n, [(size + 3, 1.0), (2 * size, -1.0), (2 * size + 1, 3.0)])]
    alone = M.assemble(wide, None, 0).filter("turn = 1").first()
    assert (alone.n_features, alone.nnz, alone.features.toArray().tolist()) == (2, 1, [2.0, 0.0])

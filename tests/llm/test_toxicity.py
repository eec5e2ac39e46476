import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pairgram.llm import toxicity

import memory_model

from helpers import awkward, documents


def corpus(n, seed=3):
    random.seed(seed)
    syllables = ["re", "ta", "no", "li", "san", "er", "the", "mo"]
    word = lambda: "".join(random.choice(syllables) for _ in range(random.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(random.randint(20, 200))], int(i % 4 == 0)
        for _ in range(max(1, len(words) // 25) * toxic):
            words.insert(random.randrange(len(words)), random.choice(["Jerkwad", "gitface", "jerkwadish"]))
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_and_planted_words(spark):
    rows, labels = corpus(900)
    out = toxicity.score_documents(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [(r.predicted, int(r.doc_id % 4 == 0)) for r in out if r.held_out]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)


def test_held_out_labels_do_not_matter(spark):
    rows, labels = corpus(240)
    turned = [(d, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, t in labels]
    docs = documents(spark, rows)
    a, b = ({r.doc_id: r.score for r in toxicity.score_documents(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, turned))
    assert a == b


def test_pieces_make_the_same_grams(monkeypatch):
    text = "Some Text, with -- runs   of 12 signs\nand ÉÀ漢 letters. " * 3
    whole = np.concatenate(list(toxicity.grams(text)))
    for piece in (1, 2, 5, 17, 64):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert np.array_equal(np.concatenate(list(toxicity.grams(text))), whole), piece


def test_models_are_distributions():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, memory_model.GRAMS, 4000)).astype(np.int32)
    p = memory_model.backoff(memory_model.continuation(keys[:300]), memory_model.continuation(keys))
    assert np.allclose(p.reshape(-1, 32).sum(axis=1), 1)
    model = memory_model.evidence(keys, (keys % 3 == 0) * 2.0, (keys % 3 == 1) * 1.0)
    free = keys[keys % 3 == 2]
    assert np.isfinite(model.table()).all() and len(model.keys) == len(keys) - len(free)


def test_counts_do_not_depend_on_when_they_are_summed(spark, monkeypatch):
    rows, _ = corpus(30)
    df = spark.createDataFrame([(t, i % 3 - 1 if i % 3 else None) for i, (_, t) in enumerate(rows)], "text string, label int")
    want = sorted(map(tuple, toxicity.count_grams(df).collect()))
    sums = toxicity._Sums()
    for part in (np.array([3, 1, 3]), np.array([1]), np.array([7, 7])):
        sums.add(part.astype(np.int32))
        sums.flush()
    assert sums.keys.tolist() == [1, 3, 7] and sums.sums.tolist() == [2, 2, 2]
    assert sum(w[1] for w in want) + sum(w[2] for w in want) > 0


def test_awkward_rows(spark):
    rows, labels = corpus(200)
    odd = [(None if r[0] is None else 5000 + r[0], *r[1:]) for r in awkward(3_000)]
    labels = spark.createDataFrame([*labels, (None, 1), (3, None), (5001, 0), (5001, 1)], "doc_id long, toxic int")
    docs = documents(spark, rows + odd)
    out = toxicity.score_documents(docs, labels).collect()
    assert len(out) == len(rows) + len(odd) and all(r.score is not None and r.held_out is not None for r in out)
    same = {r.score for r in out if r.doc_id == 5001}
    assert len(same) == 1
    kept = toxicity.remove_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in out)


@pytest.mark.parametrize("labels, share", [([], 0.0), ([(1, 0), (3, 0)], 0.0), ([(1, 1), (3, 1)], 1.0)])
def test_one_class_or_none(spark, labels, share):
    docs = documents(spark, [(i, f"text number {i}") for i in range(8)])
    out = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert {r.score for r in out} == {share}
    assert toxicity.score_documents(documents(spark, []), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8000)], "doc_id long, toxic int")
    n = toxicity.sample_labels(labels, 1000).count()
    assert 800 <= n <= 1000


def test_tables_equal_the_model_in_memory(spark):
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 32, (3000, toxicity.ORDER)) ** 2 // 32  # some symbols are frequent
    codes = np.unique(np.concatenate((codes, np.arange(32)[:, None].repeat(toxicity.ORDER, 1))), axis=0)
    toxic, ordinary = (rng.integers(0, 4, len(codes)) * rng.integers(0, 2, len(codes)) for _ in range(2))
    keys = (codes * 32 ** np.arange(toxicity.ORDER)[::-1]).sum(axis=1).astype(np.int32)
    want = memory_model.evidence(keys, toxic.astype(float), ordinary.astype(float)).table()
    grams = ["".join(chr(0x4E00 + c) for c in row) for row in codes]
    table = spark.createDataFrame(list(zip(grams, toxic.tolist(), ordinary.tolist())), "gram string, toxic long, ordinary long")
    got = {r.gram: r.value for r in toxicity.gram_evidence(table).collect()}
    assert len(got) > 100
    assert np.allclose([got.get(g, 0.0) for g in grams], want[keys], atol=1e-4)


def test_grams_are_code_points_of_any_script(spark):
    texts = ["слово дело", "слива 漢字", "a, b. c!"]
    got = {r.gram for r in toxicity.count_grams(spark.createDataFrame([(t, 1) for t in texts], "text string, label int")).collect()}
    assert got == {f" {t} "[i:i + 5] for t in texts for i in range(len(t) - 2)}


def test_what_is_kept_of_the_corpus_grows_with_it(spark):
    random.seed(5)
    text = lambda n: "".join(chr(0x4E00 + random.randrange(900)) for _ in range(n))
    small, large = ([(text(400), None) for _ in range(n)] for n in (20, 80))
    sizes = []
    for rows in (small, large):
        tables = toxicity.continuations(toxicity.count_grams(spark.createDataFrame(rows, "text string, label int")))
        sizes.append([tables[k].filter("shared > 0").count() for k in (4, 3, 2)])
    assert all(b > 3 * a for a, b in zip(*sizes))


def test_words_of_other_scripts_are_told_apart(spark):
    random.seed(11)
    word = lambda: "".join(random.choice("лорнатимекс") for _ in range(random.randint(3, 8)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(60)]
        if i % 4 == 0:
            for _ in range(4):
                words.insert(random.randrange(60), random.choice(["гадюкин", "гадюкины"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    out = toxicity.score_documents(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [(r.predicted, int(r.doc_id % 4 == 0)) for r in out if r.held_out]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)


def test_one_doc_id_on_many_rows_calibrates_once(spark, monkeypatch):
    rows, labels = corpus(200)
    one = next(d for d, _ in labels if zlib.crc32(str(d).encode()) % 4 == toxicity.CALIBRATE)
    sizes, real = [], toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda z, y: sizes.append(len(z)) or real(z, y))
    docs = documents(spark, rows + [(one, f"{rows[one][1]} {k}") for k in range(300)])
    toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).count()
    assert sizes == [sum(zlib.crc32(str(d).encode()) % 4 == toxicity.CALIBRATE for d, _ in labels)]


def test_many_moderate_signs_are_found(spark):
    random.seed(13)
    words = ["rela", "nosan", "taliro", "mose", "lisan", "torema", "sanoli", "merato"]
    rows, labels = [], []
    for i in range(400):
        weights = [3, 1] * 4 if i % 4 == 0 else [1, 1] * 4  # no word is over 1.5 times likelier
        rows.append((i, " ".join(random.choices(words, weights, k=250))))
        labels.append((i, int(i % 4 == 0)))
    out = toxicity.score_documents(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [(r.predicted, int(r.doc_id % 4 == 0)) for r in out if r.held_out]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)


def test_blocks_of_files_and_of_other_rows_score_alike(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4000)
    rows, labels = corpus(240)
    docs, labels = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    assert toxicity.in_blocks(read, read["text"]).select("block").distinct().count() > 1
    a, b = ({r.doc_id: r.score for r in toxicity.score_documents(x, labels).collect()} for x in (docs, read))
    assert all(abs(a[d] - b[d]) < 1e-6 for d in a)


def test_blocks_hold_as_many_bytes_whatever_the_length_of_the_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 100_000)
    for name, words in (("short", 30), ("long", 300)):
        spark.createDataFrame([(i, "word " * words) for i in range(2000)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name))
        blocks = toxicity.in_blocks(read, read["text"]).groupBy("block").count().collect()
        size = 2000 * words * 5
        assert size // 100_000 // 3 <= len(blocks) <= size // 100_000
        assert max(r["count"] for r in blocks) * words * 5 <= 8 * 100_000


def test_lookups_by_table_and_in_order_find_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    keys = np.repeat(rng.integers(-(1 << 62), 1 << 62, 5000) * 4096, 2)  # alike in their low bits, and each twice
    values = (keys % 97 + 1).astype(np.float32)
    asked = np.concatenate((keys[::3], rng.integers(-(1 << 62), 1 << 62, 3000), keys[:10]))
    want = sorted(float(k % 97 + 1) for k in asked if k in set(keys.tolist()))
    for most in (toxicity.TABLED, 10):
        monkeypatch.setattr(toxicity, "TABLED", most)
        assert sorted(toxicity.Lookup(keys, values).found(asked).tolist()) == want
        none = toxicity.Lookup(keys[:0], values[:0])
        assert not len(none.found(asked)) and not len(none.found(asked[:0]))


def test_keys_of_strings_are_those_of_their_texts():
    text = " aé漢 \U0001f600bc\u0301 "
    strings = pa.array([text[i:i + toxicity.ORDER] for i in range(len(text) - toxicity.ORDER + 1)])
    want = toxicity.keys_of(np.array([ord(c) for c in text], dtype=np.uint32))
    assert np.array_equal(toxicity.string_keys(strings), want)
    assert np.array_equal(toxicity.string_keys(strings.slice(2, 3)), want[2:5])
    assert not len(toxicity.string_keys(strings.slice(1, 0)))


def test_sums_do_not_depend_on_how_often_they_are_added_up(monkeypatch):
    texts, found = [r[1] for r in corpus(40)[0]], []
    for hold in (1 << 21, 300, 1):
        monkeypatch.setattr(toxicity, "HOLD", hold)
        sums = toxicity._Sums()
        for text in texts:
            for run in toxicity.runs(text):
                sums.add(toxicity.keys_of(run), run)
        sums.flush()
        found.append(dict(zip(toxicity.gram_strings(sums.codes).to_pylist(), sums.sums.tolist())))
    assert found[0] == found[1] == found[2]
    padded = [f" {' '.join(t.lower().split())} " for t in texts]
    assert sum(found[0].values()) == sum(len(t) - toxicity.ORDER + 1 for t in padded)

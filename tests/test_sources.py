import os
import tempfile

from pairgram.sources import tsv


def test_reference_layout_readers(spark):
    d = tempfile.mkdtemp(prefix="pairgram-tsv-")
    data = os.path.join(d, "test.data")
    with open(data, "w") as f:
        f.write("51\tHarbour\tthree boats came in\tthe boats are late\t3\tthree/O/CD/B-NP/O\tthe/O/DT/B-NP/O\n")
        f.write("52\tRay\tsome \"quoted\" text\tother\t5\ta/O/DT/B-NP/O\tb/O/DT/B-NP/O\n")
    rows = tsv.read_test_pairs(spark, data).collect()
    assert [r.trendid for r in rows] == [51, 52]
    assert rows[1].origsent == 'some "quoted" text' and rows[0].label == 3
    gold = os.path.join(d, "test.label")
    with open(gold, "w") as f:
        f.write("----\t0.6000\nfalse\t0.4000\ntrue\t1.0000\n")
    g = tsv.read_indexed(spark, gold, tsv.GOLD_SCHEMA).orderBy("row_idx").collect()
    assert [(r.row_idx, r.ans, r.prob) for r in g] == [(0, "----", 0.6), (1, "false", 0.4), (2, "true", 1.0)]


def test_line_numbers_follow_the_files(spark, tmp_path):
    """A short first file and a long second one: tasks may take the long one first."""
    folder = tmp_path / "gold"
    folder.mkdir()
    (folder / "part-00000.csv").write_text("false\t0.2\n" * 2)
    (folder / "part-00001.csv").write_text("true\t0.8\n" * 50_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = tsv.read_indexed(spark, str(folder), tsv.GOLD_SCHEMA)
        assert rows.filter("row_idx < 2 AND ans = 'false'").count() == 2
        got = rows.agg({"row_idx": "max"}).first()[0], rows.select("row_idx").distinct().count()
        assert got == (50_001, 50_002)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_gold_join_attaches_by_line(spark):
    from pairgram.plans.registry import QUERIES
    rows = QUERIES["gold_join"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.ans == ("true" if r.label >= 4 else "----" if r.label == 3 else "false") for r in rows)
    assert all(abs(r.prob - r.label / 5) < 1e-9 for r in rows)

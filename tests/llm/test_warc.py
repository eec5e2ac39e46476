import hashlib

from pairgram.llm import warc


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, offset string")


ROWS = [(5, "http://a/\r\nX: y", "p" * 150), (2, "http://b/", "p" * 150), (9, None, "p" * 150), (1, "u", "q" * 99), (3, "u", "q" * 99),
        (4, "u", None), (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\né漢" * 20), (8, "u", "\r\n\r\nWARC/1.1\r\né漢" * 20),
        (None, "u", "r" * 120), (10, "u", "r" * 120), (11, "v", "long " * 200_000), (12, "v", "s" * 130), (12, "v", "s" * 130)]


def want(rows):
    first = {}
    for p, _, h in rows:
        if h and len(h.encode()) >= 100 and p is not None:
            first[h] = min(p, first.get(h, p))
    out, done = [], set()
    for p, _, h in rows:
        data = (h or "").encode()
        response = h not in first or (first[h] == p and (p, h) not in done)
        done.add((p, h))
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "response" if response else "revisit", None if response else first[h]))
    return out


def test_pages_come_back_from_the_archives(spark, tmp_path):
    index = warc.write_archives(table(spark, ROWS), str(tmp_path / "w"))
    got = warc.read_records(index).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == sorted(map(str, want(ROWS)))
    html = {r[0]: (r[2] or "").encode() for r in ROWS}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_index_points_at_whole_records(spark, tmp_path):
    index = warc.write_archives(table(spark, ROWS), str(tmp_path / "w")).collect()
    for r in index:
        data = open(r.archive.removeprefix("file://"), "rb").read()[r.offset:r.offset + r.length]
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
        assert warc.decode(data)["payload_digest"] == r.payload_digest


def test_only_selected_records_are_read(spark, tmp_path):
    index = warc.write_archives(table(spark, ROWS), str(tmp_path / "w"))
    got = warc.read_records(index.filter("page_id in (1, 7)"), with_payload=False).collect()
    assert sorted(r.page_id for r in got) == [1, 7] and "payload" not in got[0].__fields__
    assert warc.read_records(index.filter("false")).count() == 0


def test_ranges_coalesce_what_touches():
    assert warc.ranges([(0, 5), (5, 5), (20, 1), (21, 9)], 100) == [(0, 10), (20, 10)]
    assert warc.ranges([(0, 5), (5, 5), (10, 50)], 10) == [(0, 10), (10, 50)]
    assert warc.ranges([]) == []


def test_empty_table(spark):
    assert warc.read_records(warc.write_archives(table(spark, []))).count() == 0


def test_every_payload_is_kept_when_splits_move_between_jobs(spark, tmp_path, monkeypatch):
    rows = [(i, f"u{i}", "p" * 150 if i % 2 else "q" * 140) for i in range(60)] + [(None, "n", "z" * 130)] * 3 + [(90, "v", "s" * 130)] * 5
    table(spark, rows).repartition(8).write.parquet(str(tmp_path / "pages"))
    real = warc.saved

    def moved(df, name):
        out = real(df, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000" if name == "first" else "128m")
        return out

    monkeypatch.setattr(warc, "saved", moved)
    try:
        got = warc.read_records(warc.write_archives(spark.read.parquet(str(tmp_path / "pages")), str(tmp_path / "w"))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(rows)
    kept = sorted(bytes(r.payload).decode() for r in got if r.record_type == "response")
    assert kept == sorted({h for _, _, h in rows})
    assert all(r.payload is None and r.refers_to == min((p for p, _, h in rows if hashlib.sha256(h.encode()).hexdigest() == r.payload_digest and p is not None), default=None)
               for r in got if r.record_type == "revisit")


def test_reading_tasks_follow_the_bytes_of_the_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 100_000)
    pages = spark.createDataFrame([(i, f"u{i}", f"{i} " + "x" * 9_000) for i in range(100)], "page_id long, url string, html string")
    read = warc.read_records(warc.write_archives(pages))
    assert read.rdd.getNumPartitions() == 10 and read.count() == 100

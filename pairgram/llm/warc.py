"""WARC archives, index first.

Write: each task writes its rows as records of one archive in the shared folder
(a new name per attempt) and returns one index row per record: archive, offset,
length, URL, digest. Only the index of finished attempts is kept, so a lost
executor's half-written archive is never referred to.

Read: the index is the first thing read. Selected records are sorted by (archive,
offset), neighbouring byte ranges are coalesced into reads of at most READ_BYTES
(a longer record is a read of its own), and only those bytes are fetched.
Archives are opened through pyarrow's file systems, so the shared folder may be
any store that it knows.

Equal payloads of at least MIN_REVISIT bytes: the one with the smallest page_id is a
response, the others are revisits that refer to it and hold no payload. Which
pages share a digest is settled by an aggregate with partial sums and a join that
Spark can split, so a payload that a third of the pages hold stays divisible.

Defined cases: null html is an empty payload; a null page_id comes after all
others; among equal page_ids with the payload the smallest url is the response, and one of
rows that agree in all; a null url is empty, and line breaks in it are percent-encoded. An empty table writes
no records. Input columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgram.llm.common import repeated, saved
from pairgram.session import shared_dir

MIN_REVISIT = 100
READ_BYTES = 4 << 20
#: Bytes of records that one reading task fetches, in the mean.
TASK_BYTES = 32 << 20
#: Rows that a writing task holds as Python objects at once.
SLICE = 64
CRLF = b"\r\n"

INDEX = "page_id long, url string, archive string, offset long, length long, payload_digest string, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_uri(page_id: int | None) -> str:
    return f"<urn:pairgram:page:{'none' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def encode(page_id: int | None, url: str, payload: bytes | None, n_bytes: int, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One record. A revisit keeps the HTTP headers, Content-Length (the payload's ``n_bytes``) included, and has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}",
            "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: {record_uri(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


def decode(record: bytes) -> dict:
    """A record's row as RECORD. The digest of a response is that of the bytes read."""
    head, _, rest = record.partition(CRLF + CRLF)
    named = _fields(head)
    block = rest[:int(named["content-length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    revisit = named["warc-type"] == "revisit"
    digest = named["warc-payload-digest"].partition(":")[2] if revisit else hashlib.sha256(payload).hexdigest()
    return {"page_id": page_of(named["warc-record-id"]), "url": named.get("warc-target-uri", ""),
            "payload_bytes": int(_fields(http)["content-length"]) if revisit else len(payload), "payload_digest": digest,
            "record_type": named["warc-type"], "refers_to": page_of(named["warc-refers-to"]) if revisit else None,
            "payload": None if revisit else payload}


def plan_records(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, revisit, refers_to``, one row per page; revisits have no payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    safe = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), safe.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    order = F.struct(F.col("page_id").isNull(), "page_id", "url")
    long_ = rows.filter(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest", "page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    first = long_.groupBy(F.col("payload_digest").alias("_d")).agg(F.min(order).alias("f"), F.min_by("copies", order).alias("copies"), F.sum("copies").alias("n"))
    first = saved(first.filter("n > 1").select("_d", F.col("f.page_id").alias("first_page"), F.col("f.url").alias("first_url"), "copies"), "first")
    out = rows.join(first, (F.col("payload_digest") == F.col("_d")) & (F.col("payload_bytes") >= MIN_REVISIT), "left")
    # what a row is follows from its values alone, so no other job or attempt sees it otherwise
    chosen = F.col("page_id").eqNullSafe(F.col("first_page")) & (F.col("url") == F.col("first_url"))
    revisit = F.col("_d").isNotNull() & ~F.coalesce(chosen, F.lit(False))
    out = out.withColumn("revisit", revisit)
    columns = ["page_id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", "revisit",
               F.when(F.col("revisit"), F.col("first_page")).alias("refers_to")]
    most = first.agg(F.max("copies")).first()[0] or 1
    if most == 1:
        return out.select(*columns)
    # rows that agree in all: one is kept with its payload, the others are made from their number
    same = ~F.col("revisit") & (F.coalesce("copies", F.lit(1)) > 1)
    tied = out.filter(same)
    kept = tied.groupBy("page_id", "url", "payload_digest", "payload_bytes").agg(F.first("payload").alias("payload"))
    kept = kept.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers_to"))
    others = tied.groupBy("page_id", "url", "payload_digest", "payload_bytes").agg((F.count(F.lit(1)) - 1).alias("copies"))
    others = repeated(others.withColumn("_key", F.xxhash64("payload_digest")), "copies", "_nr", most)
    others = others.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "payload_bytes", "payload_digest",
                           F.lit(True).alias("revisit"), F.col("page_id").alias("refers_to"))
    return out.filter(~same).select(*columns).unionByName(kept).unionByName(others)


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives and their index; returns the index as read back (INDEX)."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    uri = folder if re.match(r"\w+:", folder) else f"file://{folder}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        out, offset = None, 0
        name = f"{uuid.uuid4().hex}.warc"
        try:
            for batch in batches:
                index = []
                for row in (r for at in range(0, batch.num_rows, SLICE) for r in batch.slice(at, SLICE).to_pylist()):
                    if out is None:
                        store.create_dir(path, recursive=True)
                        out = store.open_output_stream(f"{path}/{name}")
                    record = encode(row["page_id"], row["url"], row["payload"], row["payload_bytes"], row["payload_digest"], row["revisit"], row["refers_to"])
                    out.write(record)
                    index.append((row["page_id"], row["url"], name, offset, len(record), row["payload_digest"],
                                  "revisit" if row["revisit"] else "response"))
                    offset += len(record)
                columns = list(zip(*index)) if index else [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                    names=["page_id", "url", "archive", "offset", "length", "payload_digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    index = plan_records(pages).mapInArrow(write, INDEX)
    return saved(index, "index").withColumn("archive", F.concat(F.lit(uri + "/"), "archive"))


def ranges(records: list[tuple[int, int]], most: int = READ_BYTES) -> list[tuple[int, int]]:
    """Coalesce sorted (offset, length) that touch into reads (offset, length) of at most ``most`` bytes."""
    out: list[tuple[int, int]] = []
    for offset, length in records:
        if out and out[-1][0] + out[-1][1] == offset and out[-1][1] + length <= most:
            out[-1] = (out[-1][0], out[-1][1] + length)
        else:
            out.append((offset, length))
    return out


def read_records(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of an index selection, decoded (RECORD; payload left out unless asked for)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, file = None, None
        for batch in batches:
            rows = list(zip(batch.column("archive").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist()))
            at = 0
            while at < len(rows):
                if rows[at][0] != name:
                    if file is not None:
                        file.close()
                    name = rows[at][0]
                    store, path = fs.FileSystem.from_uri(name)
                    file = store.open_input_file(path)
                upto = at
                while upto < len(rows) and rows[upto][0] == name:
                    upto += 1
                own = [r[1:] for r in rows[at:upto]]
                nr = 0
                for offset, length in ranges(own):
                    data, found = file.read_at(length, offset), []
                    while nr < len(own) and own[nr][0] < offset + length:
                        begin = own[nr][0] - offset
                        found.append(decode(data[begin:begin + own[nr][1]]))
                        nr += 1
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in found], schema=schema)
                at = upto
        if file is not None:
            file.close()

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload)
    columns = RECORD if with_payload else RECORD.rpartition(",")[0]
    # as many tasks as the records' bytes ask for: the index itself is a small part of them
    tasks = max(1, -(-(selected.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    ordered = selected.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(read, columns)

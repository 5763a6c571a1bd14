"""WARC archives with an index: write offset, length, URL and digest of every
record, then read selected records back by coalesced byte ranges.

Writing: pages are matched with the totals of their payload's group (equal
SHA-1 and length), and each task streams its records, one gzip member each,
into segment files of bounded size in the shared folder.  Files of a failed
attempt keep their own names; only the rows of the attempt that succeeds reach
the index, which Spark commits.  Reading: the index rows wanted are dealt by
file, sorted by offset, neighbouring ranges are read as one and every member
is inflated and parsed.

Defined results: a null payload is an empty one; null URLs become
``urn:page:<id>``; of equal payloads of at least ``min_dedup`` bytes the rows
with the largest id are responses (several, if the row itself is repeated) and
the others are revisits; a null id is below every other, and a group of null
ids only is all responses; an empty table writes no file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import compact, group_rows, open_fs, shared_path, table_bytes, write_table

MIN_DEDUP_BYTES = 1000
SEGMENT_BYTES = 256 << 20
#: Ranges of one file less than GAP apart are read together, up to READ bytes.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20

# The WARC 1.1 names for a revisit of an equal payload and its date.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "1970-01-01T00:00:00Z"

INDEX_SCHEMA = ("file string, offset long, length long, url string, payload_digest string, page_id long, "
                "record_type string, refers_to long")
RECORD_SCHEMA = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
                 "refers_to long, payload binary")


def record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(rid: str):
    tail = rid[len("<urn:page:"):-1]
    return None if tail == "null" else int(tail)


def make_record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One record: WARC head, HTTP head, and the payload unless a revisit.
    The HTTP head gives the full payload's length in either case."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    target = "".join(url.split()) if url else f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Date: {RECORD_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{b32}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    payload)``; length and digest of a response are taken from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    f = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[:int(f["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    page = _page_of(f["WARC-Record-ID"])
    digest = base64.b32decode(f["WARC-Payload-Digest"][len("sha1:"):]).hex()
    if f["WARC-Type"] == "revisit":
        n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
        return page, f["WARC-Target-URI"], n, digest, "revisit", _page_of(f["WARC-Refers-To"]), None
    real = hashlib.sha1(payload).hexdigest()
    if real != digest:
        raise ValueError(f"payload of {f['WARC-Record-ID']} does not have its digest")
    return page, f["WARC-Target-URI"], len(payload), real, "response", None, payload


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _writer(folder: str, segment_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, None, 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at >= segment_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"segment-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                revisit = r["record_type"] == "revisit"
                member = _gzip(make_record(r["page_id"], r["url"], (r["payload"] or "").encode(), r["digest"],
                                           r["refers_to"], revisit))
                out.write(member)
                rows.append((f"{folder}/{name}", at, len(member), r["url"], r["digest"], r["page_id"],
                             r["record_type"], r["refers_to"]))
                at += len(member)
            if rows:
                cols = list(zip(*rows))
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                                 ["file", "offset", "length", "url", "payload_digest", "page_id",
                                                  "record_type", "refers_to"])
        if out is not None:
            out.close()
    return write


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_dedup: int = MIN_DEDUP_BYTES,
                  segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write every row as a record below ``folder``; returns the index."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        payload.alias("payload")).select(
        "*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    salt = F.xxhash64(F.col("page_id"))
    thin = write_table(page.select("page_id", "digest", "n"), "page-digests", pages)
    totals = group_rows(thin, ["digest", "n"], salt, [("__winner", "max", F.col("page_id"))])
    # one row per (digest, salt): what a page has to look up
    totals = totals.select("digest", "n", F.pmod(salt, F.lit(64)).alias("__salt"), "__winner").distinct()
    placed = page.withColumn("__salt", F.pmod(salt, F.lit(64))).join(totals, ["digest", "n", "__salt"])
    revisit = (F.col("n") >= min_dedup) & ~F.col("page_id").eqNullSafe(F.col("__winner"))
    rows = placed.select("page_id", "url", "digest",
                         F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
                         F.when(revisit, F.col("__winner")).alias("refers_to"), "payload")
    return write_table(rows.mapInArrow(_writer(f"{folder}/data", segment_bytes), INDEX_SCHEMA), "warc-index", pages)


def _reader(with_payload: bool):
    def flush(fs, path, todo):
        with fs.open_input_file(path) as f:
            first, last = todo[0][0], todo[-1][0] + todo[-1][1]
            block = f.read_at(last - first, first)
        out = [parse_record(zlib.decompress(memoryview(block)[o - first:o - first + n], 31)) for o, n in todo]
        cols = list(zip(*out))
        if not with_payload:
            cols[6] = [None] * len(out)
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          ["page_id", "url", "payload_bytes", "payload_digest", "record_type",
                                           "refers_to", "payload"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, fs, path, todo = None, None, None, []
        for batch in batches:
            for f, o, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                end = todo[-1][0] + todo[-1][1] if todo else 0
                if todo and (f != uri or o > end + GAP_BYTES or o + n - todo[0][0] > READ_BYTES):
                    yield flush(fs, path, todo)
                    todo = []
                if f != uri:
                    uri = f
                    fs, path = open_fs(f)
                todo.append((o, n))
        if todo:
            yield flush(fs, path, todo)
    return read


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the given index rows.  Ranges of a file are dealt in
    stretches of READ_BYTES, so a large file is read by many tasks."""
    stretch = F.floor(F.col("offset") / F.lit(READ_BYTES))
    parts = max(index.sparkSession.sparkContext.defaultParallelism, table_bytes(index) >> 18)
    ranges = (index.select("file", "offset", "length").repartition(parts, "file", stretch)
              .sortWithinPartitions("file", "offset"))
    return ranges.mapInArrow(_reader(with_payload), RECORD_SCHEMA)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through an archive and back."""
    index = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_path(spark, "warc"))
    records = read_records(index, with_payload=False)
    return compact(records, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP4_SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, url, octet_length(b) AS n, sha1(b) AS h FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS winner FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> winner THEN winner END AS refers_to, url
FROM w
"""

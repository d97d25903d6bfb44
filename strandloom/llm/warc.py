"""WARC archives by way of a chunked record table.

Writing: each page becomes a record; a payload longer than a chunk becomes rows of record identifier and chunk number, each
with the digest of the payload so far, and is stored as WARC segments (a first record and `continuation` records). Of
records with equal payloads of at least `least` bytes, that with the largest page_id is the response and the others are
revisits that name it and carry no payload. Spark's text writer makes the files, with the blank lines that end a WARC
record as its line separator, so archives go wherever Spark can write and a row is never larger than a chunk.

Reading: archives of bounded size are read as whole files and cut into the chunk table again; chunks of a segmented
payload meet, ordered by chunk number, in a stream that updates one digest, so no payload is held whole. A revisit gets its
length from the response that it names.

Equal payloads are found by their SHA-1 and length; the counts are made before the shuffle, and the join of hot digests can be
split, as both of its sides are plain tables. Nulls: a null html is an empty payload; a null url is left out of the record; a
page without an id is always a response, and no revisit names it. Repeated rows are records of their own. An empty table gives
no archives and an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, utf8, written

CHUNK, LEAST, RECORDS_PER_FILE = 256 << 10, 1000, 1024
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
_CHUNKS = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int32()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("last", pa.bool_()), ("size", pa.int64()), ("running_digest", pa.string()), ("url", pa.string()), ("body", pa.binary())])
_CHUNKS_DDL = "record_id string, chunk_no int, page_id long, record_type string, refers_to long, digest string, last boolean, size long, running_digest string, url string, body binary"
_READ = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int32()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("whole", pa.bool_()), ("digest", pa.string()), ("size", pa.int64()), ("stated", pa.string()), ("body", pa.binary())])
_READ_DDL = "record_id string, chunk_no int, page_id long, record_type string, refers_to long, whole boolean, digest string, size long, stated string, body binary"


def assigned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html (bytes) and target: the page whose record holds the payload, where that is another."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html")).withColumn("sha1", F.sha1("html"))
    keyed = p.select("page_id", "sha1", F.length("html").alias("n")).where(F.col("n") >= least)
    several = written(keyed.groupBy("sha1").agg(F.max("page_id").alias("target"), F.count("*").alias("c")).where("c > 1").select("sha1", "target"), "targets")
    joined = p.join(several, "sha1", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id") != F.col("target"), F.col("target")).alias("target"))


def _batch(schema: pa.Schema, made: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)


def _cut(batches, chunk: int):
    for b in batches:
        at, data = utf8(b.column("html"))
        out: list[tuple] = []
        held = 0
        for k, (page, url, target) in enumerate(zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "target")), strict=True)):
            lo, hi = int(at[k]), int(at[k + 1])
            so_far, digest = hashlib.sha1(), hashlib.sha1(data[lo:hi]).hexdigest()
            record = f"urn:strandloom:page:{page}:{digest}"
            if target is not None:
                out.append((record, 0, page, "revisit", target, digest, True, hi - lo, digest, url, b""))
                continue
            for no, start in enumerate(range(lo, max(hi, lo + 1), chunk)):
                stop = min(hi, start + chunk)
                so_far.update(data[start:stop])
                out.append((record, no, page, "continuation" if no else "response", None, digest, stop == hi, hi - lo, so_far.hexdigest(), url, data[start:stop].tobytes()))
                held += stop - start
                if held > 4 << 20:
                    yield _batch(_CHUNKS, out)
                    out, held = [], 0
        if out:
            yield _batch(_CHUNKS, out)


def chunk_table(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of record identifier and chunk number, with the chunk and the digest of the payload up to its end."""
    return records.select("page_id", "url", "html", "target").mapInArrow(partial(_cut, chunk=chunk), _CHUNKS_DDL)


def record_column():
    """A chunk's WARC record, without the blank lines at its end, as a binary column."""
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *(v if not isinstance(v, str) else F.lit(v) for v in value), F.lit("\r\n"))
    c, later, revisit = F.col, F.col("chunk_no") > 0, F.col("record_type") == "revisit"
    either = lambda when, text: F.when(when, text).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", c("record_type")),
        line("WARC-Record-ID", "<", c("record_id"), either(later, F.concat(F.lit(":"), c("chunk_no").cast("string"))), ">"), line("WARC-Date", "2024-01-01T00:00:00Z"),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")), F.lit("")),
        line("WARC-Payload-Digest", "sha1:", c("digest")), F.coalesce(line("X-Page-ID", c("page_id").cast("string")), F.lit("")),
        either(revisit, F.concat(line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), line("WARC-Refers-To", "<urn:strandloom:page:", F.coalesce(c("refers_to").cast("string"), F.lit("")), ":", c("digest"), ">"))),
        either(later | ~c("last"), F.concat(line("WARC-Segment-Number", (c("chunk_no") + 1).cast("string")), line("X-Running-Digest", "sha1:", c("running_digest")))),
        either(later, line("WARC-Segment-Origin-ID", "<", c("record_id"), ">")), either(later & c("last"), line("WARC-Segment-Total-Length", (c("size") + len(HTTP)).cast("string"))),
        line("Content-Type", "application/http; msgtype=response"), line("Content-Length", (F.length("body") + F.when(later, 0).otherwise(len(HTTP))).cast("string")), F.lit("\r\n"))
    return F.concat(head.cast("binary"), F.when(later, F.lit(b"")).otherwise(F.lit(HTTP)), c("body"))


def write_warc(pages: DataFrame, path: str, chunk: int = CHUNK, least: int = LEAST, per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record for every page as WARC files below path, any path that Spark can write."""
    made = chunk_table(assigned(pages, least), chunk).select(record_column().cast("string").alias("value"))
    made.write.option("lineSep", END.decode()).option("maxRecordsPerFile", per_file).text(path)


def records(archive: bytes):
    """Header fields and block of each record of a WARC file."""
    pos, view = 0, memoryview(archive)
    while pos < len(archive):
        stop = archive.index(END, pos)
        version, *lines = archive[pos:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {pos}")
        fields = dict(x.split(": ", 1) for x in lines)
        start = stop + len(END)
        pos = start + int(fields["Content-Length"])
        yield fields, view[start:pos]
        if archive[pos : pos + len(END)] != END:
            raise ValueError(f"a record's end is missing at byte {pos}")
        pos += len(END)


def _body(block: memoryview, fields: dict) -> int:
    """Where the payload of a record's block begins: behind the HTTP head, if it has one."""
    if not fields.get("Content-Type", "").startswith("application/http"):
        return 0
    for size in (1 << 12, len(block)):
        if (at := bytes(block[:size]).find(END)) >= 0:
            return at + len(END)
    return len(block)


def _parse(batches):
    for b in batches:
        for content in b.column("content"):
            out, held = [], 0
            for f, block in records(content.as_py()):
                no, kind = int(f.get("WARC-Segment-Number", 1)) - 1, f["WARC-Type"]
                body = block if no else block[_body(block, f) :]
                whole = kind == "revisit" or "WARC-Segment-Number" not in f
                to = re.match(r"<urn:strandloom:page:(-?\d+):", f.get("WARC-Refers-To", ""))
                page, stated = f.get("X-Page-ID"), f["WARC-Payload-Digest"].partition(":")[2]
                out.append((f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"])[1:-1], no, None if page is None else int(page), kind, int(to[1]) if to else None, whole, stated if kind == "revisit" else hashlib.sha1(body).hexdigest() if whole else None, None if kind == "revisit" else len(body), stated, None if whole else bytes(body)))
                held += 0 if whole else len(body)
                if held > 4 << 20 or len(out) >= 5000:
                    yield _batch(_READ, out)
                    out, held = [], 0
            if out:
                yield _batch(_READ, out)


def _joined(batches):
    """One row for each segmented record; rows come ordered by record and segment, those of repeated pages side by side."""
    now: dict | None = None

    def done():
        return _batch(_READ, [(now["record_id"], 0, now["page_id"], "response", None, True, now["sha1"].hexdigest(), now["n"], now["stated"], None)] * now["copies"])

    for b in batches:
        for r in b.to_pylist():
            if now is None or r["record_id"] != now["record_id"]:
                if now:
                    yield done()
                now = r | {"chunk_no": -1, "copies": 0, "sha1": hashlib.sha1(), "n": 0}
            now["copies"] += r["chunk_no"] == 0
            if r["chunk_no"] != now["chunk_no"]:
                now["chunk_no"] = r["chunk_no"]
                now["sha1"].update(r["body"])
                now["n"] += len(r["body"])
    if now:
        yield done()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record of the archives below path."""
    parsed = written(spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, _READ_DDL), "records")
    whole = parsed.where("whole").drop("body")
    parts = parsed.where("not whole").repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_joined, _READ_DDL).drop("body")
    every = whole.unionByName(parts)
    bad = F.raise_error(F.concat(F.lit("payload digest of "), "record_id"))
    every = every.withColumn("digest", F.when(F.col("digest") == F.col("stated"), F.col("digest")).otherwise(bad))
    held = written(every.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "digest", F.col("size").alias("held")).distinct(), "responses")
    revisits = every.where("record_type = 'revisit'").join(held, ["refers_to", "digest"], "left").withColumn("size", F.col("held"))
    columns = ["page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"]
    return every.where("record_type = 'response'").select(*columns).union(revisits.select(*columns))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/strandloom/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    return read_warc(spark, path)

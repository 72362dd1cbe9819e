"""WARC archives of pages as chunked record tables: written and read back as streams of bounded chunks.

An archive is a table of rows (record, chunk, data, sha1, bytes, record_id, digest): the WARC/1.1 byte stream of a record, cut so that
chunk 0 holds the WARC and HTTP headers and every later chunk at most CHUNK bytes of payload. Each row carries the
SHA-1 and the length of the payload up to its end, so a reader can check every chunk as it comes, stop at the first bad
one, and hold no more than one chunk of a record however long it is. The table is written in the shared folder by Spark.

Of pages with equal payloads of at least REVISIT_BYTES bytes the one with the largest page_id is a ``response``; the
others are ``revisit`` records without payload that refer to it by its record id. Who refers to whom is settled on digests
and ids alone. Responses are written first, with their ids and digests beside their first chunks; revisits follow, joined
to the ids that stand in the archive by then.

Defined cases: null html is an empty payload; page_ids that tie for the largest are all responses; a null page_id never
wins, and revisits the winner of its payload if there is one; repeated rows are records of their own, told apart by the number after the page in their record id; an empty table
gives an empty archive; other columns are ignored; a record whose bytes do not match its headers is read with ``valid``
false.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, saved, shared_dir

REVISIT_BYTES = 1000
CHUNK = 64 * 1024
END = b"\r\n\r\n"
ARCHIVE = "record long, chunk int, data binary, sha1 string, bytes long, record_id string, digest string"


def payload(html: Column) -> Column:
    return F.coalesce(html.cast("string"), F.lit(""))


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, digest, size, refers_to): a row for each page whose payload a larger page_id has too."""
    body = payload(F.col("html"))
    slim = pages.select("page_id", F.col("url").cast("string"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("size")).filter(F.col("size") >= least)
    top = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1 and refers_to is not null").drop("copies")
    return slim.join(top, "digest").filter("page_id is null or page_id < refers_to").select("page_id", "url", "digest", "size", "refers_to")


def record_id(page_id: int | None, record: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{record}>"


def headers(page_id: int | None, record: int, url: str | None, sha1: str, size: int, refers_to: str | None) -> bytes:
    """WARC and HTTP headers, up to where the payload begins."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = "".join(c for c in url or "" if c > " ")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, record)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if refers_to is None else 0)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode("utf-8", "replace") + END + http


def cut(pages: DataFrame, known: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(page_id, url, sha1, size, chunk, data): pages that are no revisits as rows of at most ``chunk`` bytes, in order; chunk 0 has
    none. Spark cuts the payloads, so that no more than a batch of chunks reaches a worker."""
    known = known.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest")).distinct()
    body = payload(F.col("html")).cast("binary")
    own = pages.select("page_id", F.col("url").cast("string"), body.alias("body"), F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("size"))
    rows = own.join(known, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("sha1") == F.col("r_digest")), "left_anti")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / chunk).cast("int"))))
    data = F.when(F.col("chunk") > 0, F.substring(F.col("body"), (F.col("chunk") - 1) * chunk + 1, F.lit(chunk)))
    return rows.select("page_id", "url", "sha1", "size", "chunk", data.alias("data"))


def archived(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds)], names=["record", "chunk", "data", "sha1", "bytes", "record_id", "digest"])


def write(pages: DataFrame, path: str, least: int = REVISIT_BYTES, chunk: int = CHUNK) -> None:
    """Archives the pages as a chunked record table at path: responses, then the revisits that refer to them."""

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, running, done = (TaskContext.get().partitionId() << 40) - 1, hashlib.sha1(), 0
        for batch in pieces(batches, 5):
            held = []
            facts = zip(*(batch.column(i).to_pylist() for i in range(5)))
            for (page, url, sha1, size, k), data in zip(facts, batch.column(5)):
                if not k:
                    record, running, done = record + 1, hashlib.sha1(), 0
                    row, name = headers(page, record, url, sha1, size, None) + END * (not size), (record_id(page, record), sha1)
                else:
                    piece = data.as_buffer()
                    running.update(piece)
                    done += len(piece)
                    row, name = piece.to_pybytes() + END * (done == size), (None, None)
                held.append((record, k, row, running.hexdigest(), done, *name))
            yield archived(held)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = ((1 << 21) + TaskContext.get().partitionId() << 40) - 1  # beyond those of the responses
        for batch in batches:
            held = []
            for page, url, sha1, size, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
                record += 1
                held.append((record, 0, headers(page, record, url, sha1, size, refers) + END, hashlib.sha1().hexdigest(), 0, record_id(page, record), sha1))
            yield archived(held)

    spark = pages.sparkSession
    known = saved(revisits(pages, least))
    cut(pages, known, chunk).mapInArrow(responses, ARCHIVE).write.parquet(path)
    page = F.regexp_extract("record_id", "^<urn:page:(-?[0-9]*):", 1)
    wanted = known.select(F.col("digest").alias("w_digest"), F.col("refers_to").cast("string").alias("w_page")).distinct()
    there = spark.read.parquet(path).filter("record_id is not null").select("record_id", F.col("digest").alias("t_digest"), page.alias("t_page"))
    ids = saved(there.join(wanted, (F.col("t_digest") == F.col("w_digest")) & (F.col("t_page") == F.col("w_page"))).groupBy("t_digest").agg(F.min("record_id").alias("refers")))
    known.join(ids, F.col("digest") == F.col("t_digest")).select("page_id", "url", "digest", "size", "refers").mapInArrow(others, ARCHIVE).write.mode("append").parquet(path)


class Reading:
    """One record as its chunks come."""

    def __init__(self):
        self.fields, self.sha1, self.seen, self.valid, self.next = {}, hashlib.sha1(), 0, True, 0

    def add(self, chunk: int, data: memoryview, sha1: str, size: int) -> None:
        self.valid &= chunk == self.next
        self.next += 1
        if chunk == 0:
            text = bytes(data)
            head, _, rest = text.partition(END)
            first, *lines = head.decode("utf-8", "replace").split("\r\n")
            self.valid &= first == "WARC/1.1"
            self.fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
            http, _, rest = rest.partition(END)
            self.left = int(self.fields.get("content-length", 0)) - len(http) - len(END)
            for line in http.decode("latin-1").split("\r\n"):
                if line.lower().startswith("content-length: "):
                    self.size = int(line[16:])
            data = memoryview(rest)
        body = data[: self.left]
        self.left -= len(body)
        self.sha1.update(body)
        self.seen += len(body)
        self.valid &= self.sha1.hexdigest() == sha1 and self.seen == size
        self.tail = bytes(data[len(body) :])

    def row(self) -> tuple:
        number = lambda name: int(x) if (x := self.fields.get(name, "").removeprefix("<urn:page:").removesuffix(">").partition(":")[0]) else None
        digest = base64.b32decode(self.fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        kind = self.fields["warc-type"]
        whole = self.left == 0 and self.tail == END and (kind == "revisit" or (self.seen == self.size and self.sha1.hexdigest() == digest))
        return number("warc-record-id"), self.fields.get("warc-target-uri"), self.size, digest, kind, number("warc-refers-to"), self.valid and whole


def read(archive: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, valid), a row for each record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reading = None, None
        for batch in batches:
            out = []
            data = batch.column(2)
            for i, (record, chunk, sha1, size) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)))):
                if record != current:
                    if reading:
                        out.append(reading.row())
                    current, reading = record, Reading()
                reading.add(chunk, memoryview(data[i].as_buffer()), sha1, size)
            yield table(out)
        if reading:
            yield table([reading.row()])

    def table(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, valid boolean"
    return archive.select("record", "chunk", "data", "sha1", "bytes").repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark.read.parquet(path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


#: What the contract asks of the records, and that each of them is whole.
SQL = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, strlen(h) n, sha1(h) d, max(page_id) over (partition by h) top from p)
select page_id, cast(n as bigint) payload_bytes, d payload_digest,
       case when n >= 1000 and page_id < top then 'revisit' else 'response' end record_type,
       case when n >= 1000 and page_id < top then top end refers_to, true valid
from d
"""

"""Deterministic sharded WARC writer and reader.

Writing:
1. ``sha1`` of each payload; of equal payloads the one with the largest page id
   is the response and the others revisit it (a ``groupBy`` over digests; only
   ids and digests move).
2. Records and the few marks that say "this page revisits that one" are
   range-partitioned by (page id, digest) together and sorted, so a record's
   mark arrives just before it and the payloads are shuffled once.
3. Each task writes its range as archive files, one gzip member a record, and
   begins a new file when the compressed size reaches the limit.  Headers
   (record ids, digests, lengths) are made anew from the row, with a fixed
   date, so the same input gives the same bytes.
4. Files are written under temporary names in ``_temporary``; the tasks return a
   manifest, which Spark stores.  Commit renames exactly the files of the
   manifest and stores the final manifest last.  A task that runs twice leaves
   an extra temporary file that no manifest names; it is deleted with the
   folder.  Readers take the final manifest and nothing else.

Defined results: null html is an empty payload, a null url an empty target URI
and a null id the record id "null" (smaller than any other).  Rows with the
same id and payload are all written alike.  An empty table gives an empty
manifest.  Payloads shorter than ``least`` bytes are always responses.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm.common import batch, located, partitions, remove, saved

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6f1ce6d2-3f0e-5b1d-9d58-0c86b0d9a1f0")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
MANIFEST = "shard string, file string, temporary string, records long, bytes long, sha256 string"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(page_id))}>"


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One uncompressed WARC record."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
            ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("X-Page-ID", "null" if page_id is None else str(page_id)),
            ("WARC-Payload-Digest", digest), ("X-Payload-Length", str(len(payload))),
            ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Shard:
    """Archive files of one task, rolled by compressed size."""

    def __init__(self, uri: str, name: str, roll_bytes: int):
        self.system, self.folder = located(f"{uri}/_temporary")
        self.system.create_dir(self.folder, recursive=True)
        self.name, self.roll_bytes, self.out, self.done, self.part = name, roll_bytes, None, [], 0

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.temporary = f"{self.name}-{self.part:05d}.{uuid.uuid4().hex}.tmp"
            self.out = self.system.open_output_stream(f"{self.folder}/{self.temporary}")
            self.records, self.size, self.hash = 0, 0, hashlib.sha256()
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.hash.update(member)
        self.records, self.size = self.records + 1, self.size + len(member)
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, f"{self.name}-{self.part:05d}.warc.gz", self.temporary, self.records, self.size, self.hash.hexdigest()))
            self.out, self.part = None, self.part + 1


def write(pages: DataFrame, uri: str, roll_bytes: int = 64 << 20, least: int = 0, shards: int | None = None,
          id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` to archives below ``uri``; returns the final manifest."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha1("html")))
    digests = rows.where(F.octet_length("html") >= least).select("page_id", "digest")
    newest = digests.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = (digests.join(newest, "digest").where("page_id < newest or page_id is null").where("newest is not null")
             .select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "newest").distinct())
    both = rows.select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("newest")).union(marks)
    ranged = (both.repartitionByRange(shards or partitions(spark), "page_id", "digest")
              .sortWithinPartitions("page_id", "digest", F.col("newest").isNull(), "url"))

    def run(batches):
        out, mark, first = None, (None, None, None), True
        for item in batches:
            for page_id, url_, html_, digest, newest_ in zip(*(item.column(c) for c in range(5)), strict=True):
                page_id, digest, newest_ = page_id.as_py(), digest.as_py(), newest_.as_py()
                if first:       # the shard's name: its first key, so equal input gives equal names
                    key = "null" if page_id is None else f"{page_id + (1 << 63):020d}"
                    out, first = _Shard(uri, f"pages-{key}-{digest.hex()[:8]}", roll_bytes), False
                if newest_ is not None:
                    mark = (page_id, digest, newest_)
                    continue
                refers_to = mark[2] if mark[:2] == (page_id, digest) else None
                out.add(record(page_id, url_.as_py(), html_.as_py().encode("utf-8"), refers_to))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out.done, strict=True)], names=["shard", "file", "temporary", "records", "bytes", "sha256"])

    manifest = saved(ranged.mapInArrow(run, MANIFEST), f"{uri}/_written")

    def commit(batches):
        system, folder = located(uri)
        for item in batches:
            for temporary, file in zip(item.column("temporary").to_pylist(), item.column("file").to_pylist(), strict=True):
                source = f"{folder}/_temporary/{temporary}"
                # a renamed file is gone from its old place when the task runs again
                if system.get_file_info(source).type != pafs.FileType.NotFound:
                    system.move(source, f"{folder}/{file}")
            yield item

    final = saved(manifest.mapInArrow(commit, MANIFEST).drop("temporary"), f"{uri}/_manifest")
    remove(f"{uri}/_temporary")
    return final


def _members(stream, chunk: int = 1 << 20):
    """Decompressed gzip members of a file, one by one."""
    left = b""
    while True:
        left = left or stream.read(chunk)
        if not left:
            return
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not left:
                left = stream.read(chunk)
                if not left:
                    raise ValueError("truncated archive member")
            parts.append(unpacker.decompress(left))
            left = unpacker.unused_data if unpacker.eof else b""
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    at = data.index(b"\r\n\r\n")
    version, *lines = data[:at].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in lines)
    return head, data[at + 4:at + 4 + int(head["Content-Length"])]


def read(spark: SparkSession, uri: str, payload: bool = False) -> DataFrame:
    """Records of the committed archives: page_id, url, record_type,
    payload_bytes, payload_digest, refers_to (and the payload).  Digests of
    responses are computed from the payload read and must agree with the
    header; revisits carry them in their header."""
    files = spark.read.parquet(f"{uri}/_manifest").select("file")
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if payload else [])]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def number(text):
        return None if text in (None, "null") else int(text)

    def run(batches):
        system, folder = located(uri)
        for item in batches:
            for file in item.column("file").to_pylist():
                rows, size = [], 0
                with system.open_input_stream(f"{folder}/{file}", compression=None) as stream:
                    for data in _members(stream):
                        head, block = parse(data)
                        body = block[block.index(b"\r\n\r\n") + 4:]
                        digest, length = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                        if head["WARC-Type"] == "response":
                            if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                                raise ValueError(f"{file}: digest of {head['WARC-Record-ID']} does not match")
                            length = len(body)
                        rows.append((number(head["X-Page-ID"]), head["WARC-Target-URI"], head["WARC-Type"], length, digest, number(head.get("X-Refers-To-Page-ID")), body))
                        size += len(body)
                        if len(rows) >= 4096 or size >= 8 << 20:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    def made(rows):
        columns = list(zip(*rows, strict=True))[:len(names)]
        return batch(names, [pa.array(c, t) for c, t in zip(columns, types, strict=False)])

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    # one file a task: the number of files follows the data's size
    count = max(1, files.count())
    return files.repartition(count, "file").mapInArrow(run, schema + (", payload binary" if payload else ""))

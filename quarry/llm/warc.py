r"""Web archives: writing, normalising monolithic gzip files, and reading back.

*Writing.* Each page becomes a WARC 1.1 record whose payload is the page in
UTF-8. Of the records with equal payloads of `least_bytes` or more the one with
the smallest id is a ``response`` and the others are ``revisit`` records that
name it; smaller ones are all responses. A map task writes its records to
archives that are each one gzip stream, as careless writers do: such a file can
only be read from its start.

*Normalising.* Every archive is inflated once, as a stream, and rewritten with
each record as a gzip member of its own, beside an index of offset, length,
type and id per record. The index also comes back as a table.

*Reading* goes by the index: any record is one seek and one member.

Archives lie in the shared folder and are put in place by a rename. A name tells
the task's attempt, so a task that runs again never touches a file that another
attempt has listed; only the listed files count. Any file system that pyarrow can
open by URI will do.

A null page is an empty payload. A null id has no smallest: such a record refers
to a response but is the response only if all ids of the group are null. Rows
that repeat an id are records of their own: of equal payloads all records with the smallest
id are responses. An archive whose gzip stream is cut off is an error. An empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.store import fresh, python_ready, stored

LEAST_BYTES = 100
ARCHIVE_BYTES = 64 << 20            # record bytes after which a task begins a new archive
READ_BYTES = 1 << 20
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
URN = "urn:quarry:page:"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
INDEX = "archive string, offset bigint, length bigint, record_type string, record_id string"
RECORD = "page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def record(page: str, url: str, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit carries the headers only."""
    revisit = refers_to is not None
    http = HTTP % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{URN}{page}>"), ("WARC-Date", date),
              ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        fields += [("WARC-Refers-To", f"<{URN}{refers_to}>"),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    """The named fields of a record's or response's head, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def records_of(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Cut an inflated stream into whole records; memory holds one record and one read."""
    held = bytearray()

    def more() -> bool:
        for data in stream:
            if data:
                held.extend(data)
                return True
        return False
    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record's head")
                return
            while held[:2] == b"\r\n":
                del held[:2]
        if not held.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        need = end + 4 + int(fields_of(bytes(held[:end]))["content-length"])
        while len(held) < need:
            if not more():
                raise ValueError("the archive ends within a record")
        yield bytes(held[:need]) + b"\r\n\r\n"
        del held[:need]


def inflate(source) -> Iterator[bytes]:
    """The content of a gzip file of one member or many, read once."""
    unzip, begun = zlib.decompressobj(wbits=31), False
    while data := source.read(READ_BYTES):
        while data:
            begun = True
            yield unzip.decompress(data)
            data = unzip.unused_data
            if unzip.eof:
                unzip, begun = zlib.decompressobj(wbits=31), False
    if begun:
        raise ValueError("the archive's gzip stream is cut off")


def place(root: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    return pafs.FileSystem.from_uri(root if "://" in root else root.replace("file:", "file://", 1) if root.startswith("file:") else "file://" + root)


class Placed:
    """A file that appears under its name only when it is whole."""

    def __init__(self, root: str, name: str):
        self.fs, folder = place(root)
        self.fs.create_dir(folder, recursive=True)
        self.path, self.draft = f"{folder}/{name}", f"{folder}/.{name}-{uuid.uuid4().hex}"

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.draft, compression=None)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.draft, self.path)
        else:
            self.fs.delete_file(self.draft)


def with_types(pages: DataFrame, key: str, url: str, html: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to): which record revisits which."""
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"),
                        body.alias("html"), F.sha2(body, 256).alias("digest"))
    # payloads that occur twice; their count is combined before the shuffle
    twice = stored(rows.filter(F.octet_length("html") >= least_bytes).groupBy("digest")
                   .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "payloads")
    return rows.join(twice, "digest", "left").select(
        "page_id", "url", "html", "digest",
        F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).cast("string").alias("refers_to"))


def write_archives(typed: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write monolithic archives below `root`; returns (archive) of those written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, number = TaskContext.get(), 0
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))))
        row = next(rows, None)
        while row is not None:
            name, size = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz", 0
            zipper = zlib.compressobj(LEVEL, wbits=31)
            with Placed(root, name) as out:
                while row is not None and size < archive_bytes:
                    page, url, html, digest, refers_to = row
                    data = record("" if page is None else page, url, html.encode(), digest, refers_to, date)
                    size += len(data)
                    out.write(zipper.compress(data))
                    row = next(rows, None)
                out.write(zipper.flush())
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"])], ["archive"])
    page = F.col("page_id").cast("string").alias("page_id")
    return typed.select(page, "url", "html", "digest", "refers_to").mapInArrow(run, "archive string")


def normalise(archives: DataFrame, root: str) -> DataFrame:
    """Rewrite archives below `root` with a member per record and a sidecar index each; returns the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("archive").to_pylist()):
            fs, source = place(path)
            name, offset, entries = os.path.basename(source), 0, []
            with fs.open_input_stream(source, compression=None) as raw, Placed(root, name) as out:
                for data in records_of(inflate(raw)):
                    zipper = zlib.compressobj(LEVEL, wbits=31)
                    member = zipper.compress(data) + zipper.flush()
                    out.write(member)
                    head = fields_of(data[:data.index(b"\r\n\r\n")])
                    entries.append((f"{root}/{name}", offset, len(member), head.get("warc-type"), head.get("warc-record-id")))
                    offset += len(member)
            with Placed(root, f"{name}.index.jsonl") as out:
                for _, at, n, kind, rid in entries:
                    out.write((json.dumps({"offset": at, "length": n, "type": kind, "id": rid}) + "\n").encode())
            if entries:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*entries), kinds)],
                                                 ["archive", "offset", "length", "record_type", "record_id"])
    return archives.mapInArrow(run, INDEX)


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per index entry, read at its offset; a response's digest and length are those of its payload."""

    def one(data: bytes) -> tuple:
        cut = data.index(b"\r\n\r\n")
        head = fields_of(data[:cut])
        page = head["warc-record-id"].strip("<>").removeprefix(URN)
        block = data[cut + 4:cut + 4 + int(head["content-length"])]
        payload = block[block.index(b"\r\n\r\n") + 4:]
        url, digest = head.get("warc-target-uri"), head["warc-payload-digest"].removeprefix("sha256:")
        if head["warc-type"] == "revisit":
            return page or None, url, "revisit", head["warc-refers-to"].strip("<>").removeprefix(URN), int(head["x-payload-length"]), digest, None
        found = hashlib.sha256(payload).hexdigest()
        if found != digest:
            raise ValueError(f"payload of {page} does not have its digest")
        return page or None, url, "response", None, len(payload), found, payload if with_payload else None

    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for b in batches:
            rows, held = [], 0
            for path, offset, length in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if path != opened:
                    fs, at = place(path)
                    opened, source = path, fs.open_input_file(at)
                source.seek(offset)
                rows.append(one(zlib.decompress(source.read(length), wbits=31)))
                held += rows[-1][4]
                if held > READ_BYTES * 8:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
    return index.mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", root: str | None = None,
                  least_bytes: int = LEAST_BYTES) -> tuple[str, DataFrame]:
    """Write `pages`, normalise the archives; returns the folder of the normalised ones and their index."""
    spark: SparkSession = pages.sparkSession
    python_ready(spark)
    root = root or fresh(spark, "warc")
    typed = with_types(pages, key, url, html, least_bytes)
    written = stored(write_archives(typed, f"{root}/raw"), "archives")
    return f"{root}/members", stored(normalise(written.repartition(max(1, written.count())), f"{root}/members"), "index")

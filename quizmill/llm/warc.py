"""Operator 8, WARC: writing archives, and a normaliser of monolithic gzip files.

Pages become WARC/1.1 records; of equal payloads the largest page_id is the
response and the others are revisits. A writer task streams its records into
archives that are one gzip stream each. The normaliser inflates every such
archive once, front to back, rewrites each record as a gzip member of its own
and writes a sidecar index (offset, length, type, id, URI per line), after which
any record can be read by a single seek. The reader uses the index only.

All files go to the shared folder, under names of their own for every task
attempt; only names that a finished task returned are used, so lost executors
and repeated attempts leave at most unused files.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import new_path, table, written

#: Smaller payloads are never revisits.
LEAST_REVISIT = 1_000
#: A writer starts its next archive after so many bytes of records.
ARCHIVE_BYTES = 64 << 20
WRITE_LEVEL, MEMBER_LEVEL = 1, 5
READ_BYTES = 1 << 20
#: Pages have no fetch time; the date that records carry.
RECORD_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to: every page with its place in its group of equal payloads."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = written(groups.select(F.col("digest").alias("_digest"), "first"), "warc-groups")
    both = rows.join(groups, rows["digest"] == groups["_digest"], "left")
    return both.select("page_id", "url", "payload", "digest", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, and so the payload's length, without the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", RECORD_DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _write_archives(folder: str):
    """Streams rows into monolithic gzip archives; returns the paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        out, packer, size, paths = None, None, 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    paths.append(f"{folder}/mono-{attempt}-{len(paths)}-{uuid.uuid4().hex}.warc.gz")
                    store, at = _opened(paths[-1])
                    store.create_dir(at.rpartition("/")[0])
                    out, packer, size = store.open_output_stream(at, compression=None), zlib.compressobj(WRITE_LEVEL, zlib.DEFLATED, 31), 0
                data = record(*row)
                size += len(data)
                out.write(packer.compress(data))
                if size >= ARCHIVE_BYTES:
                    out.write(packer.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["archive"])

    return run


class _Inflated:
    """The bytes of a gzip file (one member or many), inflated as they are read, a bounded piece at a time."""

    def __init__(self, raw):
        self.raw, self.engine, self.packed = raw, zlib.decompressobj(31), b""
        self.ready, self.at = b"", 0

    def _more(self) -> bool:
        data = self.packed or self.raw.read(READ_BYTES)
        if self.engine.eof and data:
            self.engine = zlib.decompressobj(31)
        if data:
            piece = self.engine.decompress(data, 4 * READ_BYTES)
            self.packed = self.engine.unused_data if self.engine.eof else self.engine.unconsumed_tail
        else:
            piece = b"" if self.engine.eof else self.engine.flush()
        self.ready, self.at = self.ready[self.at :] + piece, 0
        return bool(data or piece)

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer only at the end."""
        while len(self.ready) - self.at < n and self._more():
            pass
        got = self.ready[self.at : self.at + n]
        self.at += len(got)
        return got

    def line(self) -> bytes:
        """Up to and with the next newline."""
        while (end := self.ready.find(b"\n", self.at)) < 0 and self._more():
            pass
        return self.take(end + 1 - self.at if end >= 0 else len(self.ready) - self.at)


def records(stream: _Inflated) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields, header bytes, block) of every record."""
    while first := stream.line():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:60]!r}")
        head, fields = [first], {}
        while (line := stream.line()).strip():
            head.append(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.take(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("a record is cut off")
        yield fields, b"".join(head) + b"\r\n", block


def normalise(archive: str, folder: str) -> tuple[str, str, int]:
    """(normalised archive, sidecar index, records): one gzip member per record."""
    name = uuid.uuid4().hex
    path, index = f"{folder}/members-{name}.warc.gz", f"{folder}/members-{name}.idx"
    store, at = _opened(archive)
    target, to = _opened(path)
    target.create_dir(to.rpartition("/")[0])
    offset, count = 0, 0
    with store.open_input_stream(at, compression=None) as raw, target.open_output_stream(to, compression=None) as out, target.open_output_stream(_opened(index)[1], compression=None) as lines:
        for fields, head, block in records(_Inflated(raw)):
            packer = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, 31)
            member = packer.compress(head + block + b"\r\n\r\n") + packer.flush()
            out.write(member)
            entry = {"offset": offset, "length": len(member), "type": fields["warc-type"], "id": fields["warc-record-id"], "uri": fields.get("warc-target-uri")}
            lines.write((json.dumps(entry) + "\n").encode())
            offset, count = offset + len(member), count + 1
    return path, index, count


def _normalise(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([normalise(a, folder) for a in pdf["archive"]], columns=["archive", "index_file", "records"])

    return run


def read_member(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in a normalised archive."""
    source.seek(offset)
    fields, _, block = next(records(_Inflated(io.BytesIO(source.read(length)))))
    return fields, block


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for pdf in frames:
        for archive, index in zip(pdf["archive"], pdf["index_file"], strict=True):
            store, at = _opened(archive)
            rows = []
            with store.open_input_stream(_opened(index)[1], compression=None) as lines, store.open_input_file(at) as source:
                for line in io.TextIOWrapper(io.BufferedReader(lines), "utf-8"):
                    entry = json.loads(line)
                    fields, block = read_member(source, entry["offset"], entry["length"])
                    head, _, payload = block.partition(b"\r\n\r\n")
                    if fields["warc-type"] == "response":
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    else:
                        size = int(head.lower().partition(b"content-length:")[2].split()[0])
                        digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                    number = lambda name, fields=fields: int(fields[name]) if name in fields else None
                    rows.append((number("x-page-id"), size, digest, fields["warc-type"], number("x-refers-to-page-id")))
                    if len(rows) == 10_000:
                        yield _frame(rows, columns)
                        rows = []
            yield _frame(rows, columns)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=columns)
    return pdf.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive): paths of monolithic archives that hold a record per row of ``pages``.

    ``pages`` needs page_id, url and html; other columns are ignored. Null and
    empty html are an empty payload, a null url leaves the record without a target,
    a null page_id without a page id. A payload of any length is one record, written
    as it streams by. Repeated rows give a record each; of equal payloads the
    largest page_id is the response, and rows that repeat it all are. No rows give
    no archives.
    """
    folder = new_path(pages.sparkSession, "warc")
    return written(planned(pages).mapInArrow(_write_archives(folder), "archive string"), "warc-archives")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """(archive, index_file, records): the normalised archives with their sidecar indexes."""
    spark = archives.sparkSession
    folder = new_path(spark, "warc-members")
    spread = archives.repartition(max(1, archives.count()), "archive")
    return written(spread.mapInPandas(_normalise(folder), "archive string, index_file string, records long"), "warc-members")


def read_archives(members: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, by the indexes."""
    spread = members.repartition(max(1, members.count()), "archive")
    return spread.mapInPandas(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark, sf_dir: str) -> DataFrame:
    return read_archives(normalise_archives(write_archives(table(spark, sf_dir, "pages"))))


SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND first_id <> page_id THEN first_id END AS refers_to
FROM w
"""

"""WARC archives: writing, normalising monolithic gzip, and reading back by index.

A monolithic archive is one gzip stream over all records, of which nothing can
be read without inflating everything before it.  The normaliser inflates such a
stream once, in pieces, writes every record as a gzip member of its own, and
writes a sidecar index (a line of JSON for each record: offset and length of
its member, its id, type and digest).  After that any record is read with one
seek.  A stream cannot be split, so an archive is one task's work; it is read
and written record by record, so an archive of any size passes through the
memory that its largest record takes.

Of records with equal payloads (of `least` bytes at least) the one of the
smallest page id is a response and the others are revisits that carry no
payload.  Only ids and digests meet for that; pages are shuffled once, by id.

Defined results: a null html is the empty payload; a null url has no target
URI; rows that repeat id and payload of a response are responses, too; a row
with a null id is a revisit if a row with an id has its payload, else a
response.  A damaged archive yields the whole records before the damage, and
the error in the list of archives; the query, which reads archives of its own,
fails on such an error, and on a record that is not read back as it was
written.  A store that can't be read or written fails the task.  Other columns
are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import join_hot
from .shared import cut, fresh_dir, landed, put_stream, small_batches
from .words import blocks

#: Bytes of payload in an archive; zlib's level; payload bytes from which equal ones are revisits.
ARCHIVE_BYTES, LEVEL, LEAST = 16 << 20, 4, 0
DATE = "1970-01-01T00:00:00Z"  # no table has the time of a fetch
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def urn(page: int | None) -> str:
    return f"<urn:orrery:page:{'' if page is None else page}>"


def page_of(name: str | None) -> int | None:
    tail = (name or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(page: int | None, url: str | None, payload: bytes, refers: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A whole record; a revisit has the headers of the response and not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", urn(page)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(0x21, 0x7F))))))
    head += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers))]
    body = http if revisit else http + payload
    head.append(("Content-Length", str(len(body))))
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode("utf-8") + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a whole record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = headers(head)
    return fields, rest[: int(fields["content-length"])]


def headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def records(stream: BinaryIO) -> Iterator[bytes]:
    """Whole records of an inflated stream, one at a time."""
    while True:
        first = stream.readline()
        while first in (b"\r\n", b"\n"):
            first = stream.readline()
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        lines, size = [first], None
        while (line := stream.readline()) not in (b"\r\n", b""):
            lines.append(line)
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                size = int(value)
        if size is None or not line:
            raise EOFError("the stream ends within a record's headers")
        body = stream.read(size + 4)
        if len(body) < size:
            raise EOFError("the stream ends within a record")
        yield b"".join([*lines, b"\r\n", body[:size], b"\r\n\r\n"])


class _Unread(Exception):
    """A read of the file failed, for the reason in its cause."""


class _Source(io.RawIOBase):
    """A file whose failures can't be taken for damage of what it holds."""

    def __init__(self, file: BinaryIO) -> None:
        self.file = file

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        try:
            return self.file.read(size)
        except Exception as e:
            raise _Unread from e


def normalise_into(source: BinaryIO, archive: BinaryIO, index: BinaryIO, level: int = LEVEL) -> tuple[int, str | None]:
    """Write every record of the source as a member of its own, and its line of the index; how many there were, and what was wrong with the source, if anything.

    Only damage within the source is returned; what fails in reading or writing
    the files is raised.
    """
    at = n = 0
    found = records(gzip.GzipFile(fileobj=_Source(source)))
    while True:
        try:
            if (raw := next(found, None)) is None:
                return n, None
            fields = headers(raw.partition(b"\r\n\r\n")[0])
        except _Unread as e:
            raise e.__cause__ from None
        except (gzip.BadGzipFile, EOFError, ValueError, zlib.error) as e:
            return n, f"{type(e).__name__}: {e}"
        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = pack.compress(raw) + pack.flush()
        entry = {"offset": at, "length": len(member), "id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "digest": fields.get("warc-payload-digest")}
        archive.write(member)
        index.write(f"{json.dumps(entry)}\n".encode())
        at, n = at + len(member), n + 1


def normalise_stream(source: BinaryIO, level: int = LEVEL) -> tuple[bytes, list[dict], str | None]:
    """`normalise_into` for a small archive: the new one, its index, and the error."""
    archive, index = io.BytesIO(), io.BytesIO()
    _, error = normalise_into(source, archive, index, level)
    return archive.getvalue(), [json.loads(line) for line in index.getvalue().splitlines()], error


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, url, payload, revisit, refers) of every page.  A payload that very many pages have is joined apart."""
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    small = cut(rows.filter(F.octet_length("payload") >= least).select("id", "sha"))
    first = cut(small.groupBy("sha").agg(F.min("id").alias("refers"), F.count("*").alias("n")).filter("n > 1 AND refers IS NOT NULL"))
    again = join_hot(small, first, "sha", "n", small.count()).filter(~F.col("id").eqNullSafe(F.col("refers"))).select(F.col("id").alias("again_id"), F.col("sha").alias("again_sha"), "refers").distinct()
    return rows.join(again, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("sha") == F.col("again_sha")), "left").select("id", "url", "payload", F.col("again_sha").isNotNull().alias("revisit"), "refers")


def write_archives(decided: DataFrame, uri: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Monolithic archives, one gzip stream each, in the folder uri; (archive, n) of each.  A task holds archive_bytes of payloads, or one payload."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, block in enumerate(blocks(batches, "payload", archive_bytes)):
            pack, name = zlib.compressobj(level, zlib.DEFLATED, 31), f"whole-{part:06d}-{k:04d}.warc.gz"
            with put_stream(uri, name) as out:
                for i in range(block.num_rows):
                    page, url, payload, revisit, refers = (c[i].as_py() for c in block.columns)
                    out.write(pack.compress(record(page, url, payload, refers, revisit)))
                out.write(pack.flush())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block.num_rows])], ["archive", "n"])

    return decided.mapInArrow(write, "archive string, n long")


def _each(names: DataFrame) -> DataFrame:
    """Archives dealt out evenly; each is a task's work."""
    return names.repartition(max(names.sparkSession.sparkContext.defaultParallelism, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "archive")


def normalise(archives: DataFrame, uri: str, level: int = LEVEL) -> DataFrame:
    """Normalised archives and their indexes beside them; (archive, index, n, error) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                to = f"members-{name}"
                with fs.open_input_stream(f"{path}/{name}", compression=None) as source, put_stream(uri, to) as archive, put_stream(uri, f"{to}.idx") as index:
                    n, error = normalise_into(source, archive, index, level)
                yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([f"{to}.idx"]), pa.array([n]), pa.array([error], pa.string())], ["archive", "index", "n", "error"])

    return _each(archives).mapInArrow(run, "archive string, index string, n long, error string")


def read_back(archives: DataFrame, uri: str) -> DataFrame:
    """A row for each record, read by its entry in the index: (id, type, refers, digest, size, payload_ok).

    digest and size are those of the full payload: computed from a response,
    taken from the headers of a revisit.
    """
    kind = "id long, type string, refers long, digest string, size long, payload_ok boolean"

    def entries(fs: pafs.FileSystem, name: str) -> Iterator[dict]:
        with fs.open_input_stream(name, compression=None) as f:
            yield from map(json.loads, io.BufferedReader(f))

    def one(raw: bytes) -> tuple:
        fields, block = parse(raw)
        head, _, payload = block.partition(b"\r\n\r\n")
        said = fields["warc-payload-digest"].removeprefix("sha1:")
        revisit = fields["warc-type"] == "revisit"
        size = int(headers(head)["content-length"])
        found = said if revisit else digest(payload)
        return page_of(fields["warc-record-id"]), fields["warc-type"], page_of(fields.get("warc-refers-to")), found, size if revisit else len(payload), found == said and (revisit or size == len(payload))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["id", "type", "refers", "digest", "size", "payload_ok"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, index, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, seen = [], 0
                with fs.open_input_file(f"{path}/{name}") as f:
                    for e in entries(fs, f"{path}/{index}"):
                        rows.append(one(zlib.decompress(f.read_at(e["length"], e["offset"]), 31)))
                        seen += 1
                        if len(rows) == 1000:
                            yield batch_of(rows)
                            rows = []
                if seen != n:
                    raise RuntimeError(f"{index} lists {seen} records of {n}")
                yield batch_of(rows)

    return _each(archives.select("archive", "index", "n")).mapInArrow(run, kind)


def warc_query(pages: DataFrame) -> DataFrame:
    """Write all pages, normalise the archives, read every record back."""
    small_batches(pages.sparkSession)
    uri = fresh_dir(pages.sparkSession, "warc")
    whole = landed(write_archives(decide(pages), uri), uri, "whole")
    members = landed(normalise(whole, uri), uri, "members")
    ends = members.join(whole.select(F.concat(F.lit("members-"), "archive").alias("archive"), F.col("n").alias("written")), "archive", "full")  # a row for each archive
    bad = ends.filter("error IS NOT NULL OR NOT n <=> written").first()
    if bad is not None:
        raise RuntimeError(f"{bad.archive} holds {bad.n} records of {bad.written}: {bad.error}")
    found = read_back(members, uri).filter(F.when(F.col("payload_ok"), True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("a record is not as it was written: page"), F.col("id"))).cast("boolean")))
    return found.select(F.col("id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").alias("refers_to"))

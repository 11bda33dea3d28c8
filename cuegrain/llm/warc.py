"""WARC archives with a two-level capture index.

Every page becomes one gzipped WARC record. Captures are sorted by their reversed-host key, cut
into compressed blocks, and every index file ends in a sparse directory with the first key of
each block. A look-up finds the index file in a short root table, the block by binary search in
that file's directory and the capture by binary search in the block, all by range reads; then it
reads just the bytes of the record.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salted_join

#: Bytes of one archive, captures of one block, bytes of ranges that one read joins, and of what one task reads.
ARCHIVE_BYTES, BLOCK_ROWS, READ_BYTES, TASK_BYTES = 64 << 20, 256, 4 << 20, 32 << 20
#: Repeated payloads up to which their digests (100 bytes each) are broadcast; beyond, they are joined.
FEW_DIGESTS = 100_000
#: Fixed value: revisit profile of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query; scheme and fragment are left out."""
    try:
        u = urlsplit((url or "").strip())
        host, port = u.hostname or "", f":{u.port}" if u.port else ""
    except ValueError:
        return ")" + (url or "")
    return ",".join(reversed(host.split("."))) + port + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with a response or revisit record; a revisit has no payload but says how long it was."""
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {' '.join((url or 'urn:none').split())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    body = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and HTTP payload of one record."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing


def judged(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """key (hash of the payload), page_id, url, payload, refers_to, revisit: of equal payloads the largest page_id is the response."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("key", F.sha2("payload", 256))
    groups = base.groupBy("key").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = scratch.save(groups, "repeated")
    n, rows = groups.agg(F.count(F.lit(1)), F.sum("n")).first()
    # Payloads only move where too many of them repeat for their digests to be sent to every task.
    if n <= FEW_DIGESTS:
        out = base.join(F.broadcast(groups), "key", "left")
    else:
        out = salted_join(base, groups, "key", "n", rows, F.col("page_id"), "left")
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return out.select("key", "page_id", "url", "payload", F.when(revisit, F.col("top")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, root: str, scratch: Scratch, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records of ``judged`` pages below root; returns the captures: surt, page_id, key, file, offset, length.

    A file's name is new with every attempt of a task, and only files that the captures name
    count: attempts that were lost leave nothing that is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(root)
        files.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for b in batches:
            rows = []
            for key, page_id, url, payload, refers_to, revisit in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "url", "payload", "refers_to", "revisit")), strict=True):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                member = record(page_id, url, payload, _digest(payload), refers_to, revisit)
                out.write(member)
                rows.append((surt(url), page_id, key, name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["surt", "page_id", "key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return scratch.save(pages.mapInArrow(run, "surt string, page_id bigint, key string, file string, offset bigint, length bigint"), "captures")


def write_index(captures: DataFrame, root: str, scratch: Scratch, parts: int, block_rows: int = BLOCK_ROWS) -> list[tuple[tuple, str, int, int]]:
    """Write sorted index files; returns the root table: (first key, file, offset and length of its directory), one row a file.

    Keys are (surt, page_id, hash of the payload), so that rows that repeat the first two keep captures of their own; they are dealt by range into ``parts`` files, so the root table is as
    short as the number of files, which the caller sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(root)
        files.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.cdx"
        out, at, directory, block = None, 0, [], []

        def flush() -> None:
            nonlocal at
            packed = zlib.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in block).encode())
            directory.append((block[0][:3], at, len(packed)))
            out.write(packed)
            at += len(packed)
            block.clear()

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("surt", "page_id", "key", "file", "offset", "length")), strict=True):
                if out is None:
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                block.append(r)
                if len(block) == block_rows:
                    flush()
        if out is None:
            return
        if block:
            flush()
        packed = zlib.compress(json.dumps(directory, ensure_ascii=False).encode())
        out.write(packed)
        out.close()
        first = directory[0][0]
        yield pa.RecordBatch.from_arrays([pa.array([x]) if x is not None else pa.array([x], pa.int64()) for x in (*first, name, at, len(packed))], ["surt", "page_id", "key", "file", "offset", "length"])

    ordered = captures.repartitionByRange(parts, "surt", F.col("page_id").asc_nulls_first(), "key").sortWithinPartitions("surt", F.col("page_id").asc_nulls_first(), "key")
    rows = scratch.save(ordered.mapInArrow(run, "surt string, page_id bigint, key string, file string, offset bigint, length bigint"), "root").collect()
    return sorted(((r["surt"], NO_PAGE if r["page_id"] is None else r["page_id"], r["key"]), r["file"], r["offset"], r["length"]) for r in rows)


NO_PAGE = -(1 << 63)


# ---------------------------------------------------------------- reading


class Index:
    """Look-ups by a task: the root table is given, directories and blocks are read once and kept."""

    def __init__(self, root: str, table: list, kept_blocks: int = 64):
        self.files, self.path = _open(root)
        self.table, self.first = table, [t[0] for t in table]
        self.directories: dict[str, tuple] = {}
        self.blocks: dict[tuple, tuple] = {}
        self.kept = kept_blocks

    def _range(self, file: str, offset: int, length: int) -> bytes:
        with self.files.open_input_file(f"{self.path}/{file}") as f:
            return zlib.decompress(f.read_at(length, offset))

    def _block(self, key: tuple[str, int, str], side) -> tuple | None:
        k = side(self.first, key) - 1
        if k < 0:
            return None
        _, file, offset, length = self.table[k]
        if file not in self.directories:
            if len(self.directories) >= self.kept:
                self.directories.clear()
            got = json.loads(self._range(file, offset, length))
            self.directories[file] = ([(s, NO_PAGE if p is None else p, d) for (s, p, d), _, _ in got], got)
        keys, got = self.directories[file]
        _, at, size = got[max(0, side(keys, key) - 1)]
        if (file, at) not in self.blocks:
            if len(self.blocks) >= self.kept:
                self.blocks.clear()
            rows = [json.loads(x) for x in self._range(file, at, size).decode().split("\n")]
            self.blocks[file, at] = ([(r[0], NO_PAGE if r[1] is None else r[1], r[2]) for r in rows], rows)
        return self.blocks[file, at]

    def find(self, key: str, page_id: int | None, payload: str) -> tuple[str, int, int] | None:
        """(file, offset, length) of a capture, or None. Of captures with equal keys, the last."""
        want = (key, NO_PAGE if page_id is None else page_id, payload)
        block = self._block(want, bisect.bisect_right)
        if block is None:
            return None
        k = bisect.bisect_right(block[0], want) - 1
        return tuple(block[1][k][3:6]) if k >= 0 and block[0][k] == want else None


def look_up(queries: DataFrame, root: str, table: list) -> DataFrame:
    """queries (surt, page_id, key; other columns stay) with file, offset and length of the capture, null where there is none."""
    held = queries.sparkSession.sparkContext.broadcast(table)  # one row an index file
    names = [*queries.columns, "file", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(root, held.value)
        for b in batches:
            got = [index.find(*k) or (None, None, None) for k in zip(*(b.column(c).to_pylist() for c in ("surt", "page_id", "key")), strict=True)]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
    return queries.mapInArrow(run, fields + ", file string, offset bigint, length bigint")


def read_records(found: DataFrame, root: str, parts: int) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload: from the archives' bytes.

    Rows of found (file, offset, length) are read in the order of their places; ranges that lie
    together are read at once, READ_BYTES at most. The places are few bytes for what they stand
    for, so the number of tasks is given: it follows the size of the archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(root)
        name, handle, base, chunk = None, None, 0, b""
        for b in batches:
            out, size = [], 0
            for file, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    if handle is not None:
                        handle.close()
                    name, handle, chunk = file, files.open_input_file(f"{path}/{file}"), b""
                if not base <= offset <= offset + length <= base + len(chunk):
                    base, chunk = offset, handle.read_at(max(length, READ_BYTES), offset)
                head, payload = parse(chunk[offset - base : offset - base + length])
                revisit = head["WARC-Type"] == "revisit"
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if not revisit and _digest(payload) != digest:
                    raise ValueError(f"{file}: record at {offset} is damaged")
                page, refers = head["X-Page-Id"], head.get("X-Refers-To-Page", "")
                out.append((int(page) if page else None, int(head["X-Payload-Length"]) if revisit else len(payload), digest, head["WARC-Type"], int(refers) if refers else None, head["WARC-Target-URI"], None if revisit else payload))
                size += len(payload)
                if size > READ_BYTES:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    placed = found.where("file IS NOT NULL").select("file", "offset", "length").repartition(parts, "file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary")


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Archive pages (page_id, url, html), index them, look every page up and read its record back.

    Null html is an empty payload, which counts like any other. Of equal payloads, rows with the
    largest page_id are responses and all others revisit them; null page_ids never are the
    largest unless all are null. Rows that repeat a (url, page_id) are looked up one by one, each
    with its own payload; rows that repeat all three lead to one of their captures. Null urls have
    a key of their own. No rows: no rows.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession)
    archives, indexes = scratch.path("archives"), scratch.path("index")
    captures = write_archives(judged(pages, scratch), archives, scratch, archive_bytes)
    n, size = captures.agg(F.count(F.lit(1)), F.sum("length")).first()
    parts = max(1, min(2000, n // 20_000 + 1))
    table = write_index(captures, indexes, scratch, parts, block_rows)

    @F.pandas_udf("string")
    def sort_key(url: pd.Series) -> pd.Series:
        return url.map(surt)

    payload = F.sha2(F.coalesce(F.col("html").cast("binary"), F.lit(b"")), 256)
    queries = pages.select(sort_key(F.col("url").cast("string")).alias("surt"), F.col("page_id").cast("long"), payload.alias("key"))
    by = ("surt", "page_id", "key")
    queries = queries.repartitionByRange(max(parts, spark.sparkContext.defaultParallelism), *by).sortWithinPartitions(*by)
    return read_records(look_up(queries, indexes, table), archives, max(spark.sparkContext.defaultParallelism, (size or 0) // TASK_BYTES))


def op6_warc_index(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("payload", "url")

"""AVI files as a Spark data source that reads ranges: stream headers, shares of the index, packets, entries of both kinds of file with what the header says, and a stream of packets of files that still grow.

Tasks read the header of a file (its lists by their sizes) and then their share of the index or the
headers of its chunks; payloads stay where they are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .files import Ranges, folders, listed

#: Bytes of a file for which its index is one share; smaller files are read many to a task.
SHARE = 256 << 20
#: Tasks that small shares are put together for, and the most bytes that are.
TASKS, TOGETHER = 256, 64 << 20
#: Rows of a batch of entries, which holds those of several small files.
ROWS = 1 << 14
#: Bytes that a header list has at most.
HEADER = 4 << 20
#: Packets that a scan of a growing file reads: at least and at most in the first, then at most.
FIRST_LEAST, FIRST_MOST, LATER_MOST = 10, 300, 1000
#: A scan ends where less than so many times the largest packet is left of what has arrived.
MARGIN = 8

SCHEMAS = {
    "streams": "file string, stream int, kind string, handler string, compression string, scale bigint, rate bigint, start bigint, length bigint, sample_size bigint, block_align int, channels int, width int, height int, n_streams int, indexed boolean",
    "index": "file string, place bigint, stream int, kind string, keyframe boolean, pos bigint, size bigint",
    "packets": "file string, place bigint, stream int, kind string, pos bigint, size bigint",
    "first": "file string, place bigint, stream int, kind string, pos bigint, size bigint",
    # entries of the index or, of files without one, packets; with their stream's header, the file's video codes and its first packet
    "entries": "file string, place bigint, stream int, keyframe boolean, pos bigint, size bigint, indexed boolean, kind string, scale bigint, sample_size bigint, block_align int, codes array<string>, n_streams int, first_stream int, first_pos bigint",
}
ENTRIES = pa.schema([("file", pa.string()), ("place", pa.int64()), ("stream", pa.int32()), ("keyframe", pa.bool_()), ("pos", pa.int64()), ("size", pa.int64()), ("indexed", pa.bool_()), ("kind", pa.string()), ("scale", pa.int64()), ("sample_size", pa.int64()), ("block_align", pa.int32()), ("codes", pa.list_(pa.string())), ("n_streams", pa.int32()), ("first_stream", pa.int32()), ("first_pos", pa.int64())])
ENTRY = np.dtype([("id", "S4"), ("flags", "<u4"), ("pos", "<u4"), ("size", "<u4")])
KEY = 0x10


@dataclass
class Layout:
    """Where the parts of a file are: (begin, end) of the packets, and of the index."""

    declared: int
    streams: list[dict]
    packets: tuple[int, int] | None
    index: tuple[int, int] | None


def _streams(data: bytes) -> list[dict]:
    """Rows of the stream lists of a header list."""
    out: list[dict] = []

    def walk(at: int, end: int, row: dict | None) -> None:
        while at + 8 <= end:
            tag, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body, stop = at + 8, min(end, at + 8 + size)
            if tag == b"LIST" and data[body : body + 4] == b"strl":
                out.append({"stream": len(out), "kind": "", "handler": "", "compression": None, "scale": 1, "rate": 1, "start": 0, "length": 0, "sample_size": 0, "block_align": None, "channels": None, "width": None, "height": None})
                walk(body + 4, stop, out[-1])
            elif tag == b"strh" and row is not None and stop - body >= 48:
                scale, rate, start, length, _, _, sample = struct.unpack_from("<7I", data, body + 20)
                row |= {"kind": data[body : body + 4].decode("latin-1"), "handler": data[body + 4 : body + 8].decode("latin-1"), "scale": scale or 1, "rate": rate or 1, "start": start, "length": length, "sample_size": sample}
            elif tag == b"strf" and row is not None and row["kind"] == "vids" and stop - body >= 20:
                row |= {"width": struct.unpack_from("<i", data, body + 4)[0], "height": struct.unpack_from("<i", data, body + 8)[0], "compression": data[body + 16 : body + 20].decode("latin-1")}
            elif tag == b"strf" and row is not None and row["kind"] == "auds" and stop - body >= 14:
                row |= {"channels": struct.unpack_from("<H", data, body + 2)[0], "block_align": struct.unpack_from("<H", data, body + 12)[0]}
            at = body + size + (size & 1)

    walk(0, len(data), None)
    return out


def layout(f: Ranges) -> Layout | None:
    """Where the parts of a file are, from the sizes of its lists; None for files of other kinds."""
    top = f.at(0, 12)
    if len(top) < 12 or top[:4] != b"RIFF" or top[8:] != b"AVI ":
        return None
    out = Layout(8 + int.from_bytes(top[4:8], "little"), [], None, None)
    at = 12
    while at + 12 <= min(f.size, out.declared):
        head = f.at(at, 12)
        tag, size = head[:4], int.from_bytes(head[4:8], "little")
        if tag == b"LIST" and head[8:] == b"hdrl" and size <= HEADER:
            out.streams = _streams(f.at(at + 12, size - 4))
        elif tag == b"LIST" and head[8:] == b"movi":
            out.packets = (at + 12, at + 8 + size if size else out.declared)
            if not size:
                break
        elif tag == b"idx1":
            out.index = (at + 8, min(f.size, at + 8 + size))
        at += 8 + size + (size & 1)
    return out


def _chunk(f: Ranges, at: int, end: int) -> tuple[int, str, int, int, int] | None:
    """(stream, kind, place of the payload, size, place of the next chunk) of the next packet that has arrived whole; lists of packets are entered, other chunks passed."""
    while at + 8 <= min(end, f.size):
        head = f.at(at, 8)
        tag, size = head[:4], int.from_bytes(head[4:], "little")
        if tag == b"LIST":
            at += 12
            continue
        behind = at + 8 + size + (size & 1)
        if tag[:2].isdigit():
            return (int(tag[:2]), tag[2:].decode("latin-1"), at + 8, size, behind) if at + 8 + size <= f.size else None
        at = behind
    return None


def chunks(f: Ranges, at: int, end: int) -> Iterator[tuple[int, str, int, int, int]]:
    """All packets from a place on, by the headers of their chunks alone."""
    while (got := _chunk(f, at, end)) is not None:
        yield got
        at = got[-1]


class Files(InputPartition):
    """Shares (file, which share, of how many) that one task reads."""

    def __init__(self, shares: list[tuple[str, int, int]]):
        self.shares = shares

    def files(self) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """(file, its shares): each file is opened once."""
        for path, own in groupby(self.shares, lambda x: x[0]):
            yield path, [x[1:] for x in own]


def shares(files: list[tuple[str, int]], size: int, split: bool) -> list[Files]:
    """Files of more than ``size`` bytes in several shares, if ``split``. A task gets shares of ``size`` bytes together, of more if they are small and many: about TASKS tasks then. No file is opened here."""
    enough = max(size, min(TOGETHER, sum(length for _, length in files) // TASKS))
    out, held, n = [], [], 0
    for path, length in files:
        parts = max(1, -(-length // size)) if split else 1
        for i in range(parts):
            held.append((path, i, parts))
            n += length * (i + 1) // parts - length * i // parts
            if n >= enough or (parts == 1 and len(held) >= 1000) or (parts > 1 and enough == size):
                out.append(Files(held))
                held, n = [], 0
    return out + ([Files(held)] if held else [])


class Folders(InputPartition):
    """Folders whose files one task lists and reads."""

    def __init__(self, paths: list[str], suffix: str | tuple[str, ...]):
        self.paths, self.suffix = paths, suffix

    def files(self) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        for folder in self.paths:
            for path, _ in listed(folder, self.suffix):
                yield path, [(0, 1)]


def by_folders(path: str, suffix: str | tuple[str, ...]) -> list[Folders]:
    """The folders right below a folder, dealt to 4 * TASKS tasks at most. No file is listed here."""
    found = folders(path)
    n = min(len(found), 4 * TASKS)
    return [Folders(found[i::n], suffix) for i in range(n)] or [Folders([], suffix)]


def _said(path: str, found: Layout, first: tuple[int, int] | None, table: list) -> pa.RecordBatch:
    """A batch of ENTRIES from columns place, stream, keyframe, pos, size; those of streams that the header lacks are left out."""
    there = table[1] < len(found.streams)
    place, stream, keyframe, pos, size = (None if x is None else x[there] for x in table)
    n, all_ = len(place), pa.array(np.zeros(len(place), np.int64))
    of = lambda name, kind: pa.array([s[name] for s in found.streams], kind).take(pa.array(stream))
    same = lambda value, kind: pa.array([value], kind).take(all_)
    codes = [s[x] for s in found.streams if s["kind"] == "vids" for x in ("handler", "compression") if s[x] is not None]
    columns = [
        same(path, pa.string()), place, pa.array(stream, pa.int32()), pa.nulls(n, pa.bool_()) if keyframe is None else keyframe, pos, size, same(found.index is not None, pa.bool_()),
        of("kind", pa.string()), of("scale", pa.int64()), of("sample_size", pa.int64()), of("block_align", pa.int32()), same(codes, pa.list_(pa.string())), same(len(found.streams), pa.int32()),
        same(first and first[0], pa.int32()), same(first and first[1], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=ENTRIES)


def _entries(f: Ranges, path: str, found: Layout, own: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Entries of a file's shares of its index; without an index the first share has all packets."""
    packets = chunks(f, *found.packets) if found.packets else iter(())
    if found.index is None:
        first, n = None, 0
        if all(part for part, _ in own):
            return
        while held := list(islice(packets, ROWS)):
            stream, pos, size = (np.array([x[i] for x in held], np.int64) for i in (0, 2, 3))
            first = first or (held[0][0], held[0][2])
            yield _said(path, found, first, [np.arange(n, n + len(held)), stream, None, pos, size])
            n += len(held)
        return
    first = next(((x[0], x[2]) for x in packets), None)
    begin, end = found.index
    n = (end - begin) // ENTRY.itemsize
    for part, parts in own:
        for at in range(n * part // parts, stop := n * (part + 1) // parts, ROWS):
            table = np.frombuffer(f.at(begin + at * ENTRY.itemsize, min(stop - at, ROWS) * ENTRY.itemsize), ENTRY)
            tag = table["id"].copy().view("u1").reshape(-1, 4)
            ours = np.flatnonzero(((tag[:, :2] >= 48) & (tag[:, :2] <= 57)).all(axis=1) & (tag[:, 3] > 0))
            table, tag = table[ours], tag[ours].astype(np.int64)
            yield _said(path, found, first, [at + ours, tag[:, 0] * 10 + tag[:, 1] - 528, (table["flags"] & KEY) > 0, table["pos"].astype(np.int64), table["size"].astype(np.int64)])


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ROWS rows or more, but for the last."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class AviReader(DataSourceReader):
    """With the option folders the files of each folder below are listed by a task, for so many files that planning would take long; all of them are in such folders then."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.table = options["path"], options.get("table", "packets")
        self.size = int(options.get("share", SHARE))
        self.folders = options.get("folders") == "true"
        self.schema = schema

    def partitions(self) -> list[Files] | list[Folders]:
        if self.folders:
            return by_folders(self.path, ".avi")
        return shares(listed(self.path, ".avi"), self.size, self.table in ("index", "entries"))

    def read(self, partition: Files | Folders) -> Iterator:
        return together(self._batches(partition)) if self.table == "entries" else self._tuples(partition)

    @staticmethod
    def _batches(partition: Files | Folders) -> Iterator[pa.RecordBatch]:
        for path, own in partition.files():
            with Ranges(path) as f:
                found = layout(f)
                if found is not None:
                    yield from _entries(f, path, found, own)

    def _tuples(self, partition: Files | Folders) -> Iterator[tuple]:
        for path, own in partition.files():
            with Ranges(path) as f:
                found = layout(f)
                if found is None:
                    continue
                if self.table == "streams":
                    for s in found.streams:
                        yield (path, *s.values(), len(found.streams), found.index is not None)
                elif self.table == "index":
                    for part, parts in own:
                        yield from self._index(f, path, found, part, parts)
                elif found.packets:
                    for n, (stream, kind, pos, size, _) in enumerate(chunks(f, *found.packets)):
                        yield path, n, stream, kind, pos, size
                        if self.table == "first":
                            break

    @staticmethod
    def _index(f: Ranges, path: str, found: Layout, part: int, parts: int) -> Iterator[tuple]:
        if found.index is None:
            return
        begin, end = found.index
        n = (end - begin) // ENTRY.itemsize
        at, stop = n * part // parts, n * (part + 1) // parts
        while at < stop:
            step = min(stop - at, 1 << 16)
            table = np.frombuffer(f.at(begin + at * ENTRY.itemsize, step * ENTRY.itemsize), ENTRY)
            for i, (tag, flags, pos, size) in enumerate(table.tolist()):
                if len(tag) == 4 and tag[:2].isdigit():
                    yield path, at + i, int(tag[:2]), tag[2:].decode("latin-1"), bool(flags & KEY), pos, size
            at += step


@dataclass
class Turn:
    """Packets of one file from place ``at``, number ``n``, up to place ``end``."""

    path: str
    at: int
    n: int
    end: int


@dataclass
class Turns(InputPartition):
    """Turns of several files that one task reads."""

    turns: list[Turn]


class AviStreamReader(DataSourceStreamReader):
    """Packets of files that grow. Each turn (``latestOffset``) admits, for each file, the packets that have arrived whole.

    The first turn of a file admits ``least`` to ``first`` packets, later ones up to ``most``. Reading
    ends where, after ``least`` packets, less than MARGIN times the largest packet so far is left of
    what has arrived, until the file has the length that it declares: so no turn waits for bytes.
    Offsets hold the next place, the packets read and the largest one of each file; a restart goes
    on from the offsets of the last batch in the checkpoint.
    """

    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"]
        self.least, self.first, self.most = (int(options.get(k, d)) for k, d in (("least", FIRST_LEAST), ("first", FIRST_MOST), ("most", LATER_MOST)))
        self.now: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.now = dict(self.now or {})
        for path, size in listed(self.path, ".avi"):
            old = self.now.get(path)
            if old and old["done"]:
                continue
            if old and size == old["size"] and old["waits"]:
                continue
            if (new := self._admitted(path, old)) is not None:
                self.now[path] = new
        return self.now

    def _admitted(self, path: str, old: dict | None) -> dict | None:
        with Ranges(path) as f:
            found = layout(f)
            if found is None or found.packets is None:
                return None
            new = dict(old) if old else {"at": found.packets[0], "n": 0, "largest": 0}
            least, most = (0, self.most) if old else (self.least, self.first)
            end, read, waits = found.packets[1], 0, False
            while read < most:
                near = f.size < found.declared and f.size - new["at"] < MARGIN * new["largest"]
                if read >= least and near:
                    waits = True
                    break
                got = _chunk(f, new["at"], end)
                if got is None:
                    waits = True
                    break
                read += 1
                new |= {"at": got[-1], "n": new["n"] + 1, "largest": max(new["largest"], got[3])}
            return new | {"size": f.size, "waits": waits, "done": waits and f.size >= found.declared}

    def partitions(self, start: dict, end: dict) -> list[Turns]:
        """The turns of the files that have new packets, dealt to TASKS tasks at most."""
        if self.now is None:  # a restart: the last batch of the checkpoint is planned again
            self.now = end
        before = {p: x for p, x in start.items()}
        out = []
        for path, x in end.items():
            n = before[path]["n"] if path in before else 0
            if x["n"] > n:
                out.append(Turn(path, before[path]["at"] if path in before else 0, n, x["at"]))
        return [Turns(out[i::TASKS]) for i in range(min(TASKS, len(out)))]

    def read(self, partition: Turns) -> Iterator[tuple]:
        for turn in partition.turns:
            with Ranges(turn.path) as f:
                at = turn.at or layout(f).packets[0]
                for n, (stream, kind, pos, size, _) in enumerate(chunks(f, at, turn.end), turn.n):
                    yield turn.path, n, stream, kind, pos, size

    def commit(self, end: dict) -> None:
        if self.now is None:
            self.now = end


class AviSource(DataSource):
    """Format "avi" with the option table: streams, index, packets, first (the first packet of each file) or entries."""

    @classmethod
    def name(cls) -> str:
        return "avi"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "packets")]

    def reader(self, schema: StructType) -> AviReader:
        return AviReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> AviStreamReader:
        return AviStreamReader(dict(self.options), schema)


def read_avi(spark: SparkSession, path: str, table: str, **options: int | bool) -> DataFrame:
    """One of the tables of ``SCHEMAS`` of all .avi files below a folder. Options: share, folders."""
    spark.dataSource.register(AviSource)
    return spark.read.format("avi").options(table=table, **options).load(path)


def stream_avi(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """The packets of all .avi files below a folder as a stream that follows files while they grow."""
    spark.dataSource.register(AviSource)
    return spark.readStream.format("avi").options(**options).load(path)

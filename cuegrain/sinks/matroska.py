"""Export to Matroska files: frames are sorted and cut into clusters by many tasks, whose parts are linked into one file a movie.

1. Frames are range-partitioned by (file, cluster), so a long movie is spread over tasks, and
   interleaved: smallest time first, lower track first among equals.
2. Each task encodes its clusters and writes one part a file, with the places of its key frames
   beside it. The commit moves the parts and writes their list; an abort removes them.
3. One task a file links its parts: the sizes in the list give every place in the file, so header,
   clusters and cues are written once, front to back, without going back. The files are moved into
   place by the commit of this second job.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import codecs
from ..sources import containers as c
from ..sources.files import address, opened
from .files import FilesWriter, Written

#: Milliseconds of a cluster, and bytes after which another one is begun.
CLUSTER_MS, CLUSTER_BYTES = 5000, 8 << 20
#: Bytes that are copied at once.
COPIED = 4 << 20
#: Identifiers that only a writer needs, from the public format description.
CUE_POINT, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
VIDEO, AUDIO, PIXEL_WIDTH, PIXEL_HEIGHT, RATE, CHANNELS, TRACK_UID, VERSION = 0xE0, 0xE1, 0xB0, 0xBA, 0xB5, 0x9F, 0x73C5, 0x4287
WRITING_APP, MUXING_APP = c.WRITER, 0x4D80
#: Fixed value: the identifier of pictures that are described by a bitmap header.
BITMAP = "V_MS/VFW/FOURCC"

FRAMES = "file string, track bigint, dts bigint, pts bigint, keyframe boolean, data binary"
TRACKS = "file string, number bigint, type int, codec_id string, codec_private binary, width int, height int, rate double, channels int"


def element(ident: int, body: bytes) -> bytes:
    """An element with its size in eight bytes."""
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + (len(body) | 1 << 56).to_bytes(8, "big") + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(8, "big"))


def track_number(n: int) -> bytes:
    size = next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * size).to_bytes(size, "big")


def simple_block(track: int, offset: int, key: bool, data: bytes) -> bytes:
    return element(c.SIMPLE, track_number(track) + struct.pack(">hB", offset, 0x80 if key else 0) + data)


@dataclass
class Cluster:
    """Blocks from one time on."""

    slot: int
    at: int
    blocks: list[bytes] = field(default_factory=list)
    size: int = 0
    key: tuple[int, int] | None = None  # (time, track) of the first key frame
    last: int = 0

    def takes(self, slot: int, pts: int, n: int) -> bool:
        return slot == self.slot and -0x8000 <= pts - self.at <= 0x7FFF and (not self.blocks or self.size + n <= CLUSTER_BYTES)

    def add(self, track: int, pts: int, key: bool, data: bytes) -> None:
        self.blocks.append(simple_block(track, pts - self.at, key, data))
        self.size += len(data)
        self.last = max(self.last, pts)
        if key and self.key is None:
            self.key = (pts, track)

    def encoded(self) -> bytes:
        return element(c.CLUSTER, number(c.TIMECODE, self.at) + b"".join(self.blocks))


@dataclass
class Parts(WriterCommitMessage):
    """The parts of a task: file, first slot, paths of the clusters and of their places, bytes, last time."""

    rows: list[dict]


class PartsWriter(DataSourceWriter):
    """Step 2. Rows come sorted by file and time; one cluster is held at a time."""

    def __init__(self, folder: str, slot: int):
        self.folder, self.slot = folder.rstrip("/"), slot
        self.own = f"{self.folder}/_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Parts:
        system, own = opened(self.own)
        attempt = f"{own}/{uuid.uuid4().hex}"
        system.create_dir(attempt, recursive=True)
        done: list[dict] = []
        part: dict | None = None
        cluster: Cluster | None = None
        out = places = None

        def flush() -> None:
            nonlocal cluster
            if cluster is not None:
                data = cluster.encoded()
                if cluster.key:
                    places.write(struct.pack("<qqq", part["bytes"], *cluster.key))
                out.write(data)
                part["bytes"] += len(data)
                part["last"] = max(part["last"], cluster.last)
            cluster = None

        def close() -> None:
            nonlocal part, out, places
            if part is not None:
                flush()
                out.close()
                places.close()
                done.append(part)
            part = out = places = None

        try:
            for row in iterator:
                slot, pts, data = row["dts"] // self.slot, row["pts"], bytes(row["data"] or b"")
                if part is None or part["file"] != row["file"]:
                    close()
                    path = f"{attempt}/{len(done):06d}"
                    part = {"file": row["file"], "slot": slot, "clusters": f"{path}.clusters", "places": f"{path}.places", "bytes": 0, "last": 0}
                    out, places = system.open_output_stream(part["clusters"]), system.open_output_stream(part["places"])
                if cluster is not None and not cluster.takes(slot, pts, len(data)):
                    flush()
                if cluster is None:
                    cluster = Cluster(slot, max(0, pts))
                cluster.add(row["track"], pts, row["keyframe"], data)
            close()
        finally:
            for f in (out, places):
                if f is not None and not f.closed:
                    f.close()
        return Parts(done)

    def commit(self, messages: list[Parts | None]) -> None:
        """The list of all parts, a line each; only lists of names pass here."""
        system, folder = opened(self.folder)
        with system.open_output_stream(f"{folder}/parts.json") as f:
            for m in messages:
                for row in m.rows if m else []:
                    f.write((json.dumps(row) + "\n").encode())

    def abort(self, messages: list[Parts | None]) -> None:
        system, own = opened(self.own)
        if system.get_file_info(own).type != fs.FileType.NotFound:
            system.delete_dir(own)


class PartsSink(DataSource):
    """Format "cuegrain_matroska_parts"."""

    @classmethod
    def name(cls) -> str:
        return "cuegrain_matroska_parts"

    def schema(self) -> str:
        return FRAMES

    def writer(self, schema: StructType, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["path"], int(self.options.get("slot", CLUSTER_MS)))


def track_entry(row) -> bytes:
    body = number(c.NUMBER, row["number"]) + number(TRACK_UID, row["number"]) + number(c.TYPE, row["type"]) + number(c.LACING, 0) + element(c.CODEC, (row["codec_id"] or "").encode())
    if row["codec_private"] is not None:
        body += element(c.PRIVATE, bytes(row["codec_private"]))
    if row["type"] == 1 and row["width"] is not None:
        body += element(VIDEO, number(PIXEL_WIDTH, row["width"]) + number(PIXEL_HEIGHT, row["height"] or 0))
    if row["type"] == 2 and row["rate"] is not None:
        body += element(AUDIO, element(RATE, struct.pack(">d", row["rate"])) + number(CHANNELS, row["channels"] or 1))
    return element(c.TRACK, body)


def head(tracks: list, clusters: int, last: int) -> bytes:
    """What stands in the segment before the clusters, of which there are so many bytes."""
    info = element(c.INFO, number(c.SCALE, 1_000_000) + element(c.DURATION, struct.pack(">d", float(last))) + element(MUXING_APP, b"cuegrain") + element(WRITING_APP, b"cuegrain"))
    table = element(c.TRACKS, b"".join(track_entry(t) for t in sorted(tracks, key=lambda t: t["number"])))

    def seeks(base: int) -> bytes:
        at = {c.INFO: base, c.TRACKS: base + len(info), c.CUES: base + len(info) + len(table) + clusters}
        return element(c.SEEK_HEAD, b"".join(element(c.SEEK, element(c.SEEK_ID, k.to_bytes(4, "big")) + number(c.SEEK_POSITION, v)) for k, v in at.items()))

    return seeks(len(seeks(0))) + info + table


def cue_point(time: int, track: int, place: int) -> bytes:
    return element(CUE_POINT, number(CUE_TIME, time) + element(CUE_PLACES, number(CUE_TRACK, track) + number(CUE_CLUSTER, place)))


#: Bytes of a cue point, whatever it says.
CUE = len(cue_point(0, 1, 0))


class LinkWriter(FilesWriter):
    """Step 3. Each row is a movie: its tracks and the list of its parts; bytes are copied piece by piece."""

    def write(self, iterator: Iterator) -> Written:
        system, _, own = self.system()
        attempt = f"{own}/{uuid.uuid4().hex}"
        system.create_dir(attempt, recursive=True)
        files = []
        for n, row in enumerate(iterator):
            path = f"{attempt}/{n}.mkv"
            self._link(system, path, row)
            files.append((path, f"{row['file']}.mkv"))
        return Written(files)

    @staticmethod
    def _link(system: fs.FileSystem, path: str, row) -> None:
        parts = sorted(row["parts"], key=lambda p: p["slot"])
        size = sum(p["bytes"] for p in parts)
        points = sum(system.get_file_info(p["places"]).size // 24 for p in parts)
        before = head(row["tracks"], size, max((p["last"] for p in parts), default=0))
        cues = (points * CUE | 1 << 56).to_bytes(8, "big")
        whole = len(before) + size + 12 + points * CUE
        with system.open_output_stream(path) as out:
            out.write(element(c.EBML, number(VERSION, 2) + number(c.READ_VERSION, 2) + element(c.DOC_TYPE, b"matroska")))
            out.write(c.SEGMENT.to_bytes(4, "big") + (whole | 1 << 56).to_bytes(8, "big") + before)
            for p in parts:
                with system.open_input_stream(p["clusters"]) as f:
                    while data := f.read(COPIED):
                        out.write(data)
            out.write(c.CUES.to_bytes(4, "big") + cues)
            at = len(before)
            for p in parts:
                with system.open_input_stream(p["places"]) as f:
                    while data := f.read(24 * 4096):
                        out.write(b"".join(cue_point(time, track, at + place) for place, time, track in struct.iter_unpack("<qqq", data)))
                at += p["bytes"]


class LinkSink(DataSource):
    """Format "cuegrain_matroska"."""

    @classmethod
    def name(cls) -> str:
        return "cuegrain_matroska"

    def schema(self) -> str:
        return "file string"

    def writer(self, schema: StructType, overwrite: bool) -> LinkWriter:
        return LinkWriter(self.options["path"])


def export_matroska(frames: DataFrame, tracks: DataFrame, folder: str, slot: int = CLUSTER_MS) -> None:
    """Write ``folder``/<file>.mkv for each file of ``tracks`` (TRACKS) with its frames (FRAMES, times in milliseconds).

    A file without frames has headers only; frames of tracks that are not in ``tracks`` are left
    out. Equal times of one track keep no order but that of their presentation time and bytes.
    """
    spark = frames.sparkSession
    for sink in (PartsSink, LinkSink):
        spark.dataSource.register(sink)
    stage = f"{folder.rstrip('/')}/_parts-{uuid.uuid4().hex}"
    names = [x.split()[0] for x in FRAMES.split(", ")]
    known = tracks.select("file", F.col("number").alias("track")).distinct()
    rows = frames.join(known, ["file", "track"], "left_semi").withColumn("_slot", F.expr(f"floor(dts / {slot})"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "file", "_slot").sortWithinPartitions("file", "dts", "track", "pts", "data").select(*names)
    system, root = opened(stage)
    system.create_dir(root, recursive=True)
    try:
        ordered.write.format("cuegrain_matroska_parts").option("slot", slot).mode("append").save(stage)
        listed = spark.read.schema("file string, slot long, clusters string, places string, bytes long, last long").json(address(stage, f"{root}/parts.json"))
        of_file = listed.groupBy("file").agg(F.collect_list(F.struct("slot", "clusters", "places", "bytes", "last")).alias("parts"))
        entries = tracks.groupBy("file").agg(F.collect_list(F.struct(*(x.split()[0] for x in TRACKS.split(", ")[1:]))).alias("tracks"))
        movies = entries.join(of_file, "file", "left").select("file", "tracks", F.coalesce("parts", F.expr("CAST(array() AS array<struct<slot: long, clusters: string, places: string, bytes: long, last: long>>)")).alias("parts"))
        movies.write.format("cuegrain_matroska").mode("append").save(folder)
    finally:
        if system.get_file_info(root).type != fs.FileType.NotFound:
            system.delete_dir(root)


def encoder_tracks(rows: DataFrame, order: str) -> DataFrame:
    """Track entries of streams that are encoded anew, from rows (file, media, fourcc, private, width, height, rate, channels).

    Pictures have the identifier of their code (the last row of the table that has it), else that of
    bitmap headers if they have one (then it goes along), else the stream is left out; sound
    without an identifier has an empty one. Other media are left out. Tracks are numbered from 1.
    """
    coded = codecs.matroska_id(rows.where(F.col("media").isin("vide", "soun")))
    video = F.col("media") == "vide"
    bitmap = video & F.col("codec_id").isNull()
    kept = coded.where(~bitmap | F.col("private").isNotNull())
    number_ = F.row_number().over(Window.partitionBy("file").orderBy(order)).cast("long")
    return kept.select(
        "file", number_.alias("number"), F.when(video, 1).otherwise(2).alias("type"), F.coalesce("codec_id", F.when(video, BITMAP).otherwise("")).alias("codec_id"), F.when(bitmap, F.col("private")).alias("codec_private"),
        F.when(video, F.col("width")).alias("width"), F.when(video, F.col("height")).alias("height"), F.when(~video, F.col("rate")).alias("rate"), F.when(~video, F.col("channels")).alias("channels"),
    )

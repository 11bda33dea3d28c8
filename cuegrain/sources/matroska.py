"""Matroska files as a Spark data source that reads ranges.

Tables of a file are reached by its seek index, past the clusters; frames are read in shares of
bytes, each from its first cluster on, by the heads of blocks alone. So a file may have any size,
is spread over tasks, and its payloads stay where they are.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from ..functions import codecs
from . import containers as c
from .avi import Files, Folders, by_folders, shares
from .files import Ranges, listed

#: Bytes of a share; files of so many bytes at most are read at once.
SHARE, SMALL = 64 << 20, 1 << 16
SUFFIXES = (".mkv", ".webm", ".mka", ".mks")
#: The tables of the walk, and tracks with the scale of their segment (null: none).
SCHEMAS = c.SCHEMAS | {"tracks": c.SCHEMAS["tracks"] + ", entry bigint", "scaled": c.SCHEMAS["tracks"] + ", entry bigint, scale bigint"}
VOID, CRC = 0xEC, 0xBF
KNOWN = c.LEVEL_ONE | {c.SEEK_HEAD, c.CUES, c.TAGS, VOID, CRC}


class Lazy:
    """Bytes of a file that are read as they are asked for."""

    def __init__(self, f: Ranges):
        self.f = f

    def __len__(self) -> int:
        return self.f.size

    def __getitem__(self, at):
        if isinstance(at, slice):
            first, stop, _ = at.indices(self.f.size)
            return self.f.at(first, max(0, stop - first))
        one = self.f.at(at, 1)
        if not one:
            raise IndexError(at)
        return one[0]

    def find(self, mark: bytes, at: int, end: int, step: int = 1 << 16) -> int:
        """The first place of a mark, as of ``bytes``; a piece at a time."""
        while at < end:
            held = self.f.at(at, min(step, end - at))
            place = held.find(mark)
            if place >= 0:
                return at + place
            at += max(1, len(held) - len(mark) + 1)
            if end - at < len(mark):
                break
        return -1


def opened(data: Lazy) -> tuple[int, int] | None:
    """(first byte, end) of the segment; None for files of other kinds, or of later versions."""
    try:
        top = [next(c.elements(data, 0, len(data)))]
        if top[0][0] != c.EBML:
            return None
        head = c._children(data, *top[0][1:])
        kind = c._text(data, *head[c.DOC_TYPE]) if c.DOC_TYPE in head else "matroska"
        if kind not in ("matroska", "webm") or (c.READ_VERSION in head and c._uint(data, *head[c.READ_VERSION]) > 2):
            return None
        return next(((a, b) for ident, a, b in c.elements(data, top[0][2], len(data)) if ident == c.SEGMENT), None)
    except StopIteration:
        return None


def heads(data: Lazy) -> tuple[dict[str, list[dict]], tuple[int, int] | None, int]:
    """(tables of the headers, the segment, place of the first cluster or the segment's end).

    What stands before the first cluster is read in order. The rest is reached by the seek index;
    a file without one is gone through by the sizes of its clusters.
    """
    out: dict[str, list[dict]] = {k: [] for k in SCHEMAS}
    segment = opened(data)
    if segment is None:
        return out, None, 0
    at, end, seen, read = segment[0], segment[1], set(), set()
    first = end
    while at < end:
        got = next(c.elements(data, at, end), None)
        if got is None or (got[0] not in KNOWN and got[0] < 1 << 8):  # damage
            at = c.resync(data, at + 1, end)
            continue
        ident, a, b = got
        if ident == c.CLUSTER:
            first = min(first, at)
            if out["seeks"]:
                break
            b = c._cluster_end(data, a, b, end)
        elif ident == c.SEEK_HEAD:
            c._seeks(data, segment[0], end, at, read, out["seeks"])
        else:
            c.level_one(data, ident, a, b, seen, out)
        at = b
    for seek in out["seeks"]:
        place = segment[0] + seek["position"]
        got = next(c.elements(data, place, end), None) if first <= place < end else None
        if got and got[0] == seek["ident"] and got[0] in c.LEVEL_ONE - {c.CLUSTER}:
            c.level_one(data, *got, seen, out)
    c.finish(out)
    return out, segment, first


#: What stands in clusters besides blocks: checksums, filling, places and sizes.
INSIDE = {c.TIMECODE, c.SIMPLE, c.GROUP, CRC, VOID, 0xA7, 0xAB}


def first_cluster(data: Lazy, at: int, end: int) -> int:
    """The first place from ``at`` on where a cluster begins: its mark, and two elements behind it that stand in clusters (or one that fills it)."""
    mark = c.CLUSTER.to_bytes(4, "big")
    while True:
        at = data.find(mark, at, end)
        if at < 0:
            return end
        got = next(c.elements(data, at, end), None)
        if got is not None:
            inner = c.elements(data, got[1], got[2])
            one, two = next(inner, None), next(inner, None)
            if one and one[0] in INSIDE - {c.SIMPLE, c.GROUP} and (two[0] in INSIDE | KNOWN if two else one[2] >= got[2]):
                return at
        at += 1


def frames(data: Lazy, part: int, parts: int) -> Iterator[dict]:
    """Frames of the clusters that begin in one of ``parts`` shares of the file."""
    size = len(data)
    lo, hi = size * part // parts, size * (part + 1) // parts
    segment = opened(data)
    if segment is None:
        return
    end = segment[1]
    at = first_cluster(data, max(lo, segment[0]), end)
    while at < min(hi, end):
        got = next(c.elements(data, at, end), None)
        if got is None or got[0] not in KNOWN:
            at = first_cluster(data, at + 1, end)
            continue
        ident, a, b = got
        if ident == c.CLUSTER:
            b = c._cluster_end(data, a, b, end)
            out: list[dict] = []
            c._cluster(data, a, b, out)
            yield from out
        at = b


def _rows(data: Lazy | bytes, table: str) -> list[dict]:
    tables = heads(data)[0]
    if table != "scaled":
        return tables[table]
    scale = tables["segment"][0]["scale"] if tables["segment"] else None
    return [r | {"scale": scale} for r in tables["tracks"]]


class MatroskaReader(DataSourceReader):
    """With the option folders the files of each folder below are listed by a task, for so many files that planning would take long; all of them are in such folders then."""

    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "frames")
        self.size = int(options.get("share", SHARE))
        self.folders = options.get("folders") == "true"

    def partitions(self) -> list[Files] | list[Folders]:
        if self.folders:
            return by_folders(self.path, SUFFIXES)
        return shares(listed(self.path, SUFFIXES), self.size, self.table == "frames")

    def read(self, partition: Files | Folders) -> Iterator[tuple]:
        names = [x.split()[0] for x in SCHEMAS[self.table].split(", ")][1:]
        for path, own in partition.files():
            with Ranges(path) as f:
                data = f.at(0, f.size) if f.size <= SMALL else Lazy(f)
                for part, parts in own:
                    rows = frames(data, part, parts) if self.table == "frames" else _rows(data, self.table)
                    for n, r in enumerate(rows):
                        r = r | {"entry": n}
                        yield path, *(decimal.Decimal(r[k]) if k in ("uid", "parent") and r[k] is not None else r[k] for k in names)


class MatroskaSource(DataSource):
    """Format "matroska" with the option table: one of SCHEMAS."""

    @classmethod
    def name(cls) -> str:
        return "matroska"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "frames")]

    def reader(self, schema: StructType) -> MatroskaReader:
        return MatroskaReader(dict(self.options))


def read_matroska(spark: SparkSession, path: str, table: str, **options: int | bool) -> DataFrame:
    """One of the tables of SCHEMAS for all files below a folder, read by ranges. Options: share, folders."""
    spark.dataSource.register(MatroskaSource)
    return spark.read.format("matroska").options(table=table, **options).load(path)


#: Kinds of tracks, by their numbers in files.
KINDS = {1: "video", 2: "audio", 17: "subtitle"}


def track_groups(tracks: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """tracks with place (the order in which they are added: pictures and sound, then subtitles), kind, language (a number), alternate_of, shown, frame_duration.

    Of each kind the first track's language counts: a track in another one is an alternate of the last
    one before it in that language. If no track of a kind is enabled, the last one in that
    language is. frame_duration is the default one in units of the segment (segments: path, scale; without it tracks have their scale).
    Tracks of other kinds are left out.
    """
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    tracks = tracks.repartition("path")  # for all windows
    rows = codecs.language_number(tracks.where(F.col("type").isin(*KINDS)).withColumn("kind", F.element_at(kind, F.col("type").cast("int"))))
    own = Window.partitionBy("path", "type").orderBy("entry")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_lead", F.col("language") == F.first("language").over(own))
    leading = F.when(F.col("_lead"), F.col("number"))
    before = F.last(leading, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    none = ~F.max("enabled").over(whole)
    last = F.last(F.when(F.col("_lead"), F.col("entry")), ignorenulls=True).over(whole)
    place = F.row_number().over(Window.partitionBy("path").orderBy((F.col("type") == 17).cast("int"), "entry"))
    out = rows.withColumns({"alternate_of": F.when(~F.col("_lead"), before), "shown": F.col("enabled") | (none & (F.col("entry") == last)), "place": place})
    scaled = out if segments is None else out.join(segments.select("path", "scale"), "path", "left")
    scaled = scaled.withColumn("scale", F.coalesce("scale", F.lit(1_000_000)))
    return scaled.withColumn("frame_duration", F.floor(F.col("default_duration") / F.col("scale") + 0.5)).drop("_lead", "scale")

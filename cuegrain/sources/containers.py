"""Matroska and RIFF files as tables: the files are read by Spark, each is walked once in a task."""

from __future__ import annotations

import decimal
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifiers of the Matroska elements that are read, from the public format description.
EBML, DOC_TYPE, READ_VERSION = 0x1A45DFA3, 0x4282, 0x4285
SEGMENT, INFO, SCALE, DURATION, TITLE, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x7BA9, 0x5741
TRACKS, TRACK, NUMBER, TYPE, CODEC, PRIVATE, LANGUAGE, NAME, DEFAULT_DURATION, LACING, ENABLED = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86, 0x63A2, 0x22B59C, 0x536E, 0x23E383, 0x9C, 0xB9
CLUSTER, TIMECODE, GROUP, BLOCK, BLOCK_DURATION, REFERENCE, SIMPLE = 0x1F43B675, 0xE7, 0xA0, 0xA1, 0x9B, 0xFB, 0xA3
CHAPTERS, EDITION, ATOM, UID, START, HIDDEN, DISPLAY, CHAPTER_TEXT = 0x1043A770, 0x45B9, 0xB6, 0x73C4, 0x91, 0x98, 0x80, 0x85
ATTACHMENTS, FILE, FILE_NAME, FILE_MIME, FILE_DATA = 0x1941A469, 0x61A7, 0x466E, 0x4660, 0x465C
MASTERS = {SEGMENT, INFO, TRACKS, TRACK, CLUSTER, GROUP, CHAPTERS, EDITION, ATOM, DISPLAY, ATTACHMENTS, FILE, EBML}
LEVEL_ONE = {INFO, TRACKS, CLUSTER, CHAPTERS, ATTACHMENTS}
SEEK_HEAD, CUES, TAGS = 0x114D9B74, 0x1C53BB6B, 0x1254C367
SEEK, SEEK_ID, SEEK_POSITION = 0x4DBB, 0x53AB, 0x53AC
#: Kinds of attached fonts, and names of cover pictures.
FONTS, COVERS = ("application/x-truetype-font", "application/x-font-otf"), ("cover.jpg", "cover.png")


def _number(data: bytes, at: int, keep_mark: bool) -> tuple[int | None, int]:
    """A variable-length number and the place behind it; None for the unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError("no number here")
    n = 9 - data[at].bit_length()
    raw = data[at : at + n]
    if len(raw) < n:
        raise ValueError("cut short")
    value = int.from_bytes(raw, "big")
    if not keep_mark:
        value -= 1 << (7 * n)
        if value == (1 << (7 * n)) - 1:
            value = None
    return value, at + n


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(identifier, first byte, end) of each child between two places; stops at damage."""
    while at < end:
        try:
            ident, body = _number(data, at, True)
            size, body = _number(data, body, False)
        except ValueError:
            return
        stop = end if size is None else min(end, body + size)
        yield ident, body, stop
        at = stop


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _text(data: bytes, a: int, b: int) -> str:
    return data[a:b].rstrip(b"\0").decode("utf-8", "replace")


def _children(data: bytes, a: int, b: int) -> dict[int, tuple[int, int]]:
    out: dict[int, tuple[int, int]] = {}
    for ident, x, y in elements(data, a, b):
        out.setdefault(ident, (x, y))
    return out


def resync(data: bytes, at: int, end: int) -> int:
    """The next place that looks like a level-one element: where reading goes on after damage."""
    marks = [i for m in LEVEL_ONE if (i := data.find(m.to_bytes(4, "big"), at, end)) >= 0]
    return min(marks, default=end)


def lace_sizes(data: bytes, at: int, kind: int, end: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block (kind 0 none, 1 Xiph, 2 fixed, 3 EBML) and where the first one begins."""
    if not kind:
        return [end - at], at
    n = data[at] + 1
    at += 1
    if kind == 2:
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for i in range(n - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            size += data[at]
            at += 1
        else:
            first = at
            raw, at = _number(data, at, False)
            bias = (1 << (7 * (at - first) - 1)) - 1
            size = raw if not i else sizes[-1] + raw - bias
        sizes.append(size)
    return [*sizes, end - at - sum(sizes)], at


def level_one(data: bytes, ident: int, a: int, b: int, seen: set[int], out: dict[str, list[dict]]) -> None:
    """Adds the rows of one element of the first level; each of them counts once."""
    if ident in seen:
        return
    seen.add(ident)
    if ident == INFO:
        c = _children(data, a, b)
        raw = data[slice(*c[DURATION])] if DURATION in c else b""
        out["segment"].append({"scale": _uint(data, *c[SCALE]) if SCALE in c else 1_000_000, "duration": struct.unpack(">d" if len(raw) == 8 else ">f", raw)[0] if len(raw) in (4, 8) else None, "title": _text(data, *c[TITLE]) if TITLE in c else None, "writer": _text(data, *c[WRITER]) if WRITER in c else None})
    elif ident == TRACKS:
        for i, x, y in elements(data, a, b):
            if i == TRACK:
                c = _children(data, x, y)
                num = lambda k, d, c=c: _uint(data, *c[k]) if k in c else d
                txt = lambda k, d, c=c: _text(data, *c[k]) if k in c else d
                out["tracks"].append({"number": num(NUMBER, 0), "type": num(TYPE, 0), "codec_id": txt(CODEC, ""), "lang": txt(LANGUAGE, "eng"), "name": txt(NAME, None), "enabled": bool(num(ENABLED, 1)), "lacing": bool(num(LACING, 1)), "default_duration": num(DEFAULT_DURATION, 0), "codec_private": data[slice(*c[PRIVATE])] if PRIVATE in c else None})
    elif ident == CHAPTERS:
        for i, x, y in elements(data, a, b):
            if i == EDITION:
                for j, p, q in elements(data, x, y):
                    if j == ATOM:
                        _chapter(data, p, q, None, out["chapters"])
    elif ident == ATTACHMENTS:
        for i, x, y in elements(data, a, b):
            if i == FILE:
                c = _children(data, x, y)
                name, mime = (_text(data, *c[k]) if k in c else "" for k in (FILE_NAME, FILE_MIME))
                first, behind = c.get(FILE_DATA, (0, 0))
                role = "font" if mime in FONTS and not re.fullmatch(r"DF.*\.ttc", name) else "cover" if name in COVERS else None
                out["attachments"].append({"name": name, "mime": mime, "role": role, "offset": first, "size": behind - first})


def walk_matroska(data: bytes, headers_only: bool = False) -> dict[str, list[dict]]:
    """Rows of each table of one file: segment, tracks, frames, chapters, attachments, seeks. A file that isn't Matroska or WebM of read version 2 or less gives none."""
    out: dict[str, list[dict]] = {k: [] for k in ("segment", "tracks", "frames", "chapters", "attachments", "seeks")}
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        return out
    head = _children(data, *top[0][1:])
    kind = _text(data, *head[DOC_TYPE]) if DOC_TYPE in head else "matroska"
    if kind not in ("matroska", "webm") or (READ_VERSION in head and _uint(data, *head[READ_VERSION]) > 2):
        return out
    seg = next((x for x in top if x[0] == SEGMENT), None)
    if seg is None:
        return out
    at, end, seen, heads = seg[1], seg[2], set(), set()
    while at < end:
        got = next(elements(data, at, end), None)
        if got is None or (got[0] not in MASTERS and got[0] < 1 << 8):
            nxt = resync(data, at + 1, end)
            if nxt >= end:
                break
            at = nxt
            continue
        ident, a, b = got
        if ident == CLUSTER:
            b = _cluster_end(data, a, b, end)
            if not headers_only:  # tables that a SeekHead would point to may stand behind the clusters
                _cluster(data, a, b, out["frames"])
        elif ident == SEEK_HEAD:
            _seeks(data, seg[1], end, at, heads, out["seeks"])
        else:
            level_one(data, ident, a, b, seen, out)
        at = b
    finish(out)
    return out


def finish(out: dict[str, list[dict]]) -> None:
    """Leaves out chapters that begin behind the end, and sorts the seek index."""
    if out["segment"] and out["segment"][0]["duration"]:  # chapters that begin behind the end are left out
        last = out["segment"][0]["duration"]
        out["chapters"] = [c for c in out["chapters"] if c["start"] // (out["segment"][0]["scale"] or 1) <= last]
    out["seeks"].sort(key=lambda x: (x["position"], x["ident"]))


def _seeks(data: bytes, base: int, end: int, at: int, heads: set[int], out: list[dict]) -> None:
    """Adds the entries of a SeekHead, and of those that it points to; none is read twice."""
    got = next(elements(data, at, end), None)
    if at in heads or got is None or got[0] != SEEK_HEAD:
        return
    heads.add(at)
    for ident, a, b in elements(data, *got[1:]):
        c = _children(data, a, b) if ident == SEEK else {}
        if SEEK_ID in c and SEEK_POSITION in c:
            entry = {"ident": _uint(data, *c[SEEK_ID]), "position": _uint(data, *c[SEEK_POSITION])}
            if entry not in out:
                out.append(entry)
            if entry["ident"] == SEEK_HEAD:
                _seeks(data, base, end, base + entry["position"], heads, out)


def _cluster_end(data: bytes, a: int, b: int, end: int) -> int:
    """Where a cluster ends: one of unknown size goes on to the next level-one element."""
    if b < end:
        return b
    at = a
    for ident, _, stop in elements(data, a, b):
        if ident in LEVEL_ONE or ident in (SEEK_HEAD, CUES, TAGS):
            return at
        at = stop
    return b


def _cluster(data: bytes, a: int, b: int, out: list[dict]) -> None:
    base = 0
    for ident, x, y in elements(data, a, b):
        if ident == TIMECODE:
            base = _uint(data, x, y)
        elif ident == SIMPLE:
            _block(data, x, y, base, None, None, out)
        elif ident == GROUP:
            c = _children(data, x, y)
            if BLOCK in c:
                _block(data, *c[BLOCK], base, REFERENCE not in c, _uint(data, *c[BLOCK_DURATION]) if BLOCK_DURATION in c else None, out)


def _block(data: bytes, a: int, b: int, base: int, key: bool | None, duration: int | None, out: list[dict]) -> None:
    try:
        track, at = _number(data, a, False)
        tc = base + struct.unpack(">h", data[at : at + 2])[0]
        flags = data[at + 2]
        sizes, at = lace_sizes(data, at + 3, flags >> 1 & 3, b)
    except (ValueError, IndexError, struct.error):
        return
    for i, size in enumerate(sizes):
        out.append({"track": track, "tc": tc, "lace": i, "n_frames": len(sizes), "keyframe": bool(flags & 0x80) if key is None else key, "discardable": key is None and bool(flags & 1), "duration": duration, "offset": at, "size": size})
        at += size


def _chapter(data: bytes, a: int, b: int, parent: int | None, out: list[dict]) -> bool:
    """Adds an atom's visible leaves: an atom stands for itself only if no child is shown. Says whether anything was added."""
    c = _children(data, a, b)
    if HIDDEN in c and _uint(data, *c[HIDDEN]):
        return False
    uid = _uint(data, *c[UID]) if UID in c else 0
    if any([_chapter(data, x, y, uid, out) for i, x, y in elements(data, a, b) if i == ATOM]):
        return True
    title = None
    if DISPLAY in c:
        d = _children(data, *c[DISPLAY])
        title = _text(data, *d[CHAPTER_TEXT]) if CHAPTER_TEXT in d else None
    out.append({"uid": uid, "parent": parent, "start": _uint(data, *c[START]) if START in c else 0, "title": title})
    return True


SCHEMAS = {
    "segment": "path string, scale bigint, duration double, title string, writer string",
    "tracks": "path string, number bigint, type bigint, codec_id string, lang string, name string, enabled boolean, lacing boolean, default_duration bigint, codec_private binary",
    "frames": "path string, track bigint, tc bigint, lace bigint, n_frames bigint, keyframe boolean, discardable boolean, duration bigint, offset bigint, size bigint",
    "chapters": "path string, uid decimal(20,0), parent decimal(20,0), start bigint, title string",
    "attachments": "path string, name string, mime string, role string, offset bigint, size bigint",
    "seeks": "path string, ident bigint, position bigint",
}


#: Rows of small files that a task gives back together.
HELD = 10_000


def _tables(batches: Iterator[pd.DataFrame], table: str) -> Iterator[pd.DataFrame]:
    """Rows of one table of files (path, content), those of many small files in one frame."""
    names = [x.split()[0] for x in SCHEMAS[table].split(", ")]
    for pdf in batches:
        held: list[dict] = []
        for p, content in zip(pdf["path"], pdf["content"], strict=True):
            rows = walk_matroska(bytes(content), headers_only=table != "frames")[table]
            if table == "chapters":
                rows = [r | {k: None if r[k] is None else decimal.Decimal(r[k]) for k in ("uid", "parent")} for r in rows]
            held += [r | {"path": p} for r in rows]
            if len(held) >= HELD:
                yield pd.DataFrame(held, columns=names, dtype=object)
                held = []
        if held:
            yield pd.DataFrame(held, columns=names, dtype=object)


def matroska_rows(files: DataFrame, table: str) -> DataFrame:
    """One of the tables of ``SCHEMAS`` for all files (path, content). Payloads stay in the files: frames hold their places."""
    return files.select("path", "content").mapInPandas(lambda batches: _tables(batches, table), SCHEMAS[table])


def read_matroska(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One of the tables of ``SCHEMAS`` for all files below path."""
    return matroska_rows(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), table)


#: Video codes inside AVI files that other software plays, in lower case.
REFUSED = ("mjpg", "dvsd", "dvhd", "dvsl", "msvc", "cram", "raw ", "rle ", "mrle")


def riff_codes(data: bytes) -> list[str]:
    """Handler codes of the video streams of an AVI file; lists that hold no stream headers are skipped."""
    out: list[str] = []

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            tag, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body = at + 8
            if tag in (b"RIFF", b"LIST"):
                if data[body : body + 4] in (b"AVI ", b"hdrl", b"strl"):
                    walk(body + 4, min(end, body + size))
            elif tag == b"strh" and data[body : body + 4] == b"vids":
                out.append(data[body + 4 : body + 8].decode("latin-1"))
            at = body + size + (size & 1)

    walk(0, len(data))
    return out


def probe(content: Column) -> Column:
    """struct(format by the first bytes, video codes, accepted: whether the file is one to import)."""

    @F.pandas_udf("format string, codes array<string>, accepted boolean")
    def run(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            c = bytes(c or b"")
            kind = "avi" if c[:4] == b"RIFF" and c[8:12] == b"AVI " else "flv" if c[:3] == b"FLV" else "tta" if c[:4] == b"TTA1" else "nuv" if c[:12] in (b"NuppelVideo\0", b"MythTVVideo\0") else None
            codes = riff_codes(c) if kind == "avi" else []
            rows.append((kind, codes, kind is not None and not any(x.lower() in REFUSED for x in codes)))
        return pd.DataFrame(rows, columns=["format", "codes", "accepted"])

    return run(content)


#: Columns of a feed's items; given, as versions would be read as numbers otherwise.
ITEM = "title string, pubDate string, version string, link string, description string, enclosure struct<_url: string, _version: string, _length: bigint, _VALUE: string>"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS feeds."""
    return spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)


def feed_items(texts: DataFrame) -> DataFrame:
    """The same items from texts (file, text) in a table, with the number of each in its feed."""
    items = texts.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)(<item\b.*?</item>)"), F.lit(1))).alias("num", "item"))
    return items.select("file", "num", F.from_xml("item", ITEM).alias("item")).select("file", "num", "item.*")


def attributes(tag: Column) -> Column:
    """A tag's attributes as a map; of repeated names the last counts."""
    pairs = F.regexp_extract_all(tag, F.lit(r"""([\w:-]+\s*=\s*(?:"[^"]*"|'[^']*'))"""), F.lit(1))
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^([\w:-]+)", 1).alias("key"), F.regexp_replace(x, r"""(?s)^[^=]*=\s*.|.$""", "").alias("value")))
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def inventory(files: DataFrame, folders: list[tuple[str, str, str]]) -> DataFrame:
    """kind, dir, name of components: files (dir, name) in one of the folders (kind, dir, extension) with its extension."""
    rows = files.sparkSession.createDataFrame(folders, "kind string, dir string, ext string")
    named = files.withColumn("ext", F.element_at(F.split("name", r"\."), -1))
    return named.join(F.broadcast(rows), ["dir", "ext"]).select("kind", "dir", "name")

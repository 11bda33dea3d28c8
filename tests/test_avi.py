"""AVI files by ranges, and as a stream while they grow."""

import random
import struct
from pathlib import Path

import pytest

from cuegrain.operators import avi_import
from cuegrain.plans import avi as made
from cuegrain.plans.catalog import QUERIES
from cuegrain.sinks.files import FilesSink, FilesWriter, write_files
from cuegrain.sources import avi
from cuegrain.sources.files import Ranges, listed


def build(packets, handler=b"DIVX", index=True, base=4, declared=None, lists=False, sizes=True):
    """A file of (stream, payload, key)."""
    movi, entries = b"", b""
    for stream, data, key in packets:
        tag = b"%02d%s" % (stream, b"dc" if stream == 0 else b"wb")
        entries += tag + struct.pack("<III", 0x10 if key else 0, base + len(movi) + (12 if lists else 0), len(data))
        chunk = tag + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
        movi += (b"LIST" + struct.pack("<I", 4 + len(chunk)) + b"rec " + chunk) if lists else chunk
    body = b"AVI " + made.headers(handler) + b"JUNK" + struct.pack("<I", 3) + b"abc\0" + b"LIST" + struct.pack("<I", 4 + len(movi) if sizes else 0) + b"movi" + movi
    if index:
        body += b"idx1" + struct.pack("<I", len(entries)) + entries
    return b"RIFF" + struct.pack("<I", declared or len(body)) + body


def made_packets(seed, n):
    rnd = random.Random(seed)
    return [(rnd.randrange(2), b"01dc"[: rnd.choice([0, 1, 2, 4])] * rnd.choice([1, 1, 7, 50]), rnd.random() < 0.2) for _ in range(n)]


def table(spark, folder, name, **options):
    return avi.read_avi(spark, str(folder), name, **options)


def test_index_shares_and_packets_agree(spark, tmp_path):
    packets = made_packets(1, 500)
    for name, lists in (("plain.avi", False), ("lists.avi", True)):
        (tmp_path / name).write_bytes(build(packets, lists=lists))
    (tmp_path / "other.avi").write_bytes(b"RIFF....WAVE")
    (tmp_path / "empty.avi").write_bytes(b"")
    (tmp_path / "notes.txt").write_bytes(build(packets))
    whole = sorted(map(tuple, table(spark, tmp_path, "index").collect()))
    shared = table(spark, tmp_path, "index", share=1000)
    assert shared.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, shared.collect())) == whole and len(whole) == 1000
    assert [(r[2], r[6], r[4]) for r in whole[500:]] == [(s, len(d), k) for s, d, k in packets]
    found = sorted(map(tuple, table(spark, tmp_path, "packets").collect()))
    for path, _, stream, _, pos, size in found:
        data = open(path, "rb").read()
        assert data[pos - 8 : pos - 6] == b"%02d" % stream and int.from_bytes(data[pos - 4 : pos], "little") == size
    assert [(r[2], r[5]) for r in found[500:]] == [(s, len(d)) for s, d, _ in packets]


def test_tasks_read_ranges_and_not_files(tmp_path):
    path = tmp_path / "large.avi"
    path.write_bytes(build([(0, bytes(500_000), True)] * 40))
    size = path.stat().st_size
    with Ranges(str(path)) as f:
        found = avi.layout(f)
        assert f.spent < 40_000 and found.index[1] - found.index[0] == 640
        assert sum(1 for _ in avi.chunks(f, *found.packets)) == 40
        assert f.spent < size / 50
    assert listed(str(tmp_path), ".avi") == [(str(path), size)] == listed(str(path), ".avi")


def test_import(spark, tmp_path):
    video = [(0, b"abc", True), (0, b"", False), (0, b"", False), (0, b"de", False), (1, bytes(12), True), (0, b"f", False), (0, b"", False), (1, bytes(8), True)]
    (tmp_path / "absolute.avi").write_bytes(build(video, base=4 + 5000))  # places count from anywhere
    (tmp_path / "plain.avi").write_bytes(build(video, index=False, sizes=False))
    (tmp_path / "refused.avi").write_bytes(build(video, handler=b"MJPG"))
    rows = avi_import.import_avi(spark, str(tmp_path)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.file, r.offset)):
        by.setdefault(r.file.rpartition("/")[2], []).append(r)
    assert sorted(by) == ["absolute.avi", "plain.avi"]
    assert [(r.stream, r.k, r["size"], r.samples, r.duration, r.keyframe) for r in by["absolute.avi"]] == [(0, 0, 3, 1, 120, True), (0, 3, 2, 1, 40, False), (1, 0, 12, 3, 1, True), (0, 4, 1, 1, 80, False), (1, 1, 8, 2, 1, True)]
    assert [(r.duration, r.keyframe) for r in by["plain.avi"]] == [(40, None), (40, None), (1, True), (40, None), (1, True)]
    for name, own in by.items():
        data = (tmp_path / name).read_bytes()
        assert [int.from_bytes(data[r.offset - 4 : r.offset], "little") for r in own] == [r["size"] for r in own]
    streams = table(spark, tmp_path, "streams")
    ends = {r.file.rpartition("/")[2]: r.ends for r in avi_import.movie_ends(streams, avi_import.import_avi(spark, str(tmp_path))).collect()}
    assert ends == {"absolute.avi": 240 * 600 // 1000, "plain.avi": 120 * 600 // 1000}


def test_files_with_too_many_streams_are_refused(spark):
    rows = [("a", i, "vids", "DIVX", None, 15) for i in range(15)] + [("b", i, "vids", "DIVX", None, 16) for i in range(16)] + [("c", 0, "vids", "DIVX", "raw ", 1)]
    df = spark.createDataFrame(rows, "file string, stream int, kind string, handler string, compression string, n_streams int")
    assert {r.file for r in avi_import.accepted(df).collect()} == {"a"}


def run_once(spark, folder, out):
    rows = avi.stream_avi(spark, str(folder), least=3, first=5, most=8)
    run = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(processingTime="0 seconds").start()
    try:
        run.processAllAvailable()
        return [p["numInputRows"] for p in run.recentProgress]
    finally:
        run.stop()


def test_stream_of_growing_files(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    whole = {f"{n}.avi": build(made_packets(n, 60), index=n != 2) for n in (1, 2)}
    for name, share in (("1.avi", 0.5), ("2.avi", 0.05)):
        (folder / name).write_bytes(whole[name][: int(len(whole[name]) * share)])
    read = lambda: sorted((r.file.rpartition("/")[2], r.place, r.stream, r.pos, r["size"]) for r in spark.read.schema(avi.SCHEMAS["packets"]).parquet(f"{out}/rows").collect())
    turns = run_once(spark, folder, out)
    assert max(turns) <= 8 * 2
    first = read()
    assert {x[0] for x in first} == {"1.avi"}
    last = max(x[3] + x[4] for x in first)
    assert 0 < len(whole["1.avi"]) // 2 - last < len(whole["1.avi"]) // 2  # it has stopped before the end of what is there
    run_once(spark, folder, out)
    assert read() == first  # a restart alone repeats nothing
    (folder / "1.avi").write_bytes(whole["1.avi"][: int(len(whole["1.avi"]) * 0.8)])
    (folder / "2.avi").write_bytes(whole["2.avi"])
    run_once(spark, folder, out)
    second = read()
    assert len(set(second)) == len(second) > len(first)
    (folder / "1.avi").write_bytes(whole["1.avi"])
    run_once(spark, folder, out)
    batch = sorted((r.file.rpartition("/")[2], r.place, r.stream, r.pos, r["size"]) for r in table(spark, folder, "packets").collect())
    assert read() == batch and len(batch) == 120


def test_margin(tmp_path):
    packets = [(0, bytes(100), True)] * 40
    data = build(packets, index=False)
    path = tmp_path / "x.avi"
    path.write_bytes(data[: len(data) // 2])
    reader = avi.AviStreamReader({"path": str(tmp_path), "least": "2", "first": "1000"}, None)
    state = reader.latestOffset()[str(path)]
    left = len(data) // 2 - state["at"]
    assert state["waits"] and not state["done"] and left < 800 <= left + 108
    assert reader.latestOffset()[str(path)] == state
    path.write_bytes(data)
    assert reader.latestOffset()[str(path)] | {"size": 0} == {"at": len(data), "n": 40, "largest": 100, "size": 0, "waits": True, "done": True}


def test_files_appear_with_the_commit(spark, tmp_path):
    rows = spark.createDataFrame([("a", b"1"), ("d/b", b""), ("c", None)], "name string, content binary").repartition(3)
    write_files(rows, str(tmp_path / "out"))
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {"a": b"1", "d/b": b"", "c": b""}
    writer = FilesWriter(str(tmp_path / "out"))
    writer.write(iter([{"name": "lost", "content": b"x"}]))
    writer.abort([None])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "c", "d"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(FilesSink)
    rows = spark.range(0, 20, 1, 4).selectExpr("CAST(id AS string) AS name", "CASE WHEN id = 17 THEN CAST(raise_error('broken') AS binary) ELSE CAST('x' AS binary) END AS content")
    with pytest.raises(Exception, match="broken"):
        rows.write.format("cuegrain_files").mode("append").save(str(tmp_path / "out"))
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == []


def test_entries_are_those_of_the_other_tables(tmp_path, monkeypatch):
    monkeypatch.setattr(avi, "ROWS", 7)
    packets = made_packets(3, 300)
    for name, index in (("a/index.avi", True), ("a/plain.avi", False), ("b/more.avi", True), ("b/none.avi", False)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(build([(5, b"x", True), *packets] if name == "b/more.avi" else packets * (name != "b/none.avi"), index=index, base=77))

    def rows(table, **options):
        reader = avi.AviReader({"path": str(tmp_path), "table": table} | options, None)
        return [r for p in reader.partitions() for r in reader.read(p)]

    first = {r[0]: (r[2], r[4]) for r in rows("first")}
    streams = {(r[0], r[1]): r for r in rows("streams")}
    said = {k: (s[15], s[2], s[5], s[9], s[10], ["DIVX", "DIVX"], 2, *first.get(k[0], ())) for k, s in streams.items()}
    want = [(r[0], r[1], r[2], r[4], r[5], r[6], *said[r[0], r[2]]) for r in rows("index") if r[2] < 2]
    want += [(r[0], r[1], r[2], None, r[4], r[5], *said[r[0], r[2]]) for r in rows("packets") if not streams[r[0], 0][15]]
    assert len(want) == 900
    for options in ({}, {"share": "1000"}, {"folders": "true"}):
        batches = rows("entries", **options)
        assert sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=str) == sorted(want, key=str)
    assert max(b.num_rows for b in batches) < 2 * 7


def test_samples_are_read_once_and_by_folders(spark, tmp_path, monkeypatch):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("the driver's tables are not here")
    monkeypatch.setattr(made, "new_folder", lambda _: f"file://{tmp_path}/0")
    df = QUERIES["avi_samples"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("RelationV2") == 1  # for each one the driver plans the reading of all files
    n = len({r.file for r in spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("l_suppkey AS file").collect()})
    assert n == len(list(tmp_path.glob("0/avi/*/*.avi"))) == len(list(tmp_path.rglob("*.avi")))
    monkeypatch.setattr(avi, "listed", None)  # planning lists no files
    assert 0 < len(avi.AviReader({"path": f"{tmp_path}/0/avi", "table": "entries", "folders": "true"}, None).partitions()) <= 8

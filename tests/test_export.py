"""Export to Matroska files: what is written is read back, failures leave nothing."""

import random

import pytest
from pyspark.sql import functions as F

from cuegrain.sinks import matroska
from cuegrain.sources import containers

FILE_FRAMES = matroska.FRAMES


def made(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        dts = i * 37
        out.append((rnd.choice("abc"), rnd.randint(1, 200), dts, dts + rnd.choice([0, 40, -20 if dts else 0]), rnd.random() < 0.3, bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 5, 300])))))
    return out


def tracks_of(spark, rows):
    own = sorted({(f, t) for f, t, *_ in rows})
    return spark.createDataFrame([(f, t, t % 2 + 1, f"X_{t}", None if t % 3 else b"p%d" % t, 640, 480, 44100.0, 2) for f, t in own], matroska.TRACKS)


def read(folder):
    out = {}
    for p in sorted(folder.glob("*.mkv")):
        out[p.stem] = (p.read_bytes(), containers.walk_matroska(p.read_bytes()))
    return out


@pytest.mark.parametrize("slot,bytes_", [(5000, 8 << 20), (1000, 400), (10**9, 8 << 20)])
def test_frames_read_back(spark, tmp_path, monkeypatch, slot, bytes_):
    monkeypatch.setattr(matroska, "CLUSTER_BYTES", bytes_)  # of this process; tasks keep their own
    rows = made(slot % 97, 600)
    df = spark.createDataFrame(rows, FILE_FRAMES).repartition(5)
    matroska.export_matroska(df, tracks_of(spark, rows), str(tmp_path), slot)
    found = read(tmp_path)
    assert sorted(found) == ["a", "b", "c"] and sorted(p.name for p in tmp_path.iterdir()) == ["a.mkv", "b.mkv", "c.mkv"]
    for name, (data, tables) in found.items():
        own = sorted((r for r in rows if r[0] == name), key=lambda r: (r[2], r[1], r[3], r[5]))
        got = [(f["track"], f["tc"], f["keyframe"], data[f["offset"] : f["offset"] + f["size"]]) for f in tables["frames"]]
        assert got == [(r[1], r[3], r[4], r[5]) for r in own]  # all of them, interleaved by time
        assert [t["number"] for t in tables["tracks"]] == sorted({r[1] for r in own})
        assert all(t["codec_private"] == (None if t["number"] % 3 else b"p%d" % t["number"]) for t in tables["tracks"])
        assert tables["segment"][0]["duration"] == max(r[3] for r in own)


def test_seek_heads_and_cues_point_at_what_they_name(spark, tmp_path):
    rows = made(5, 900)
    matroska.export_matroska(spark.createDataFrame(rows, FILE_FRAMES).repartition(7), tracks_of(spark, rows), str(tmp_path), 2000)
    for data, tables in read(tmp_path).values():
        top = list(containers.elements(data, 0, len(data)))
        assert [x[0] for x in top] == [containers.EBML, containers.SEGMENT] and top[-1][2] == len(data)
        base = top[1][1]
        level = list(containers.elements(data, *top[1][1:]))
        at = {ident: a for ident, a, _ in level}
        for seek in tables["seeks"]:
            place = base + seek["position"]
            assert data[place : place + 4] == seek["ident"].to_bytes(4, "big") and place + 12 == at[seek["ident"]]
        assert {s["ident"] for s in tables["seeks"]} == {containers.INFO, containers.TRACKS, containers.CUES}
        clusters = {a - 12 - base: (a, b) for ident, a, b in level if ident == containers.CLUSTER}
        cues = next((a, b) for ident, a, b in level if ident == containers.CUES)
        points = []
        for _, a, b in containers.elements(data, *cues):
            point = containers._children(data, a, b)
            inner = containers._children(data, *point[matroska.CUE_PLACES])
            time, track, place = (int.from_bytes(data[slice(*x)], "big") for x in (point[matroska.CUE_TIME], inner[matroska.CUE_TRACK], inner[matroska.CUE_CLUSTER]))
            frames = [f for f in tables["frames"] if clusters[place][0] <= f["offset"] <= clusters[place][1]]
            assert next((f["tc"], f["track"]) for f in frames if f["keyframe"]) == (time, track)
            points.append(place)
        assert points == sorted(set(points)) and len(points) > 5


def test_a_movie_without_frames_and_frames_without_a_track(spark, tmp_path):
    rows = [("a", 1, 0, 0, True, b"x"), ("a", 9, 0, 0, True, b"lost"), ("gone", 1, 0, 0, True, b"lost")]
    tracks = spark.createDataFrame([("a", 1, 1, "V", None, None, None, None, None), ("empty", 3, 2, None, None, None, None, None, None)], matroska.TRACKS)
    matroska.export_matroska(spark.createDataFrame(rows, FILE_FRAMES), tracks, str(tmp_path))
    found = read(tmp_path)
    assert sorted(found) == ["a", "empty"] and [len(t["frames"]) for _, t in found.values()] == [1, 0]
    matroska.export_matroska(spark.createDataFrame([], FILE_FRAMES), tracks.where("false"), str(tmp_path / "none"))
    assert not list((tmp_path / "none").rglob("*.mkv"))


def test_large_clusters_are_cut_and_far_times_open_new_ones():
    cluster = matroska.Cluster(0, 100)
    assert cluster.takes(0, 100, 1 << 30)
    cluster.add(1, 100, False, bytes(10))
    assert not cluster.takes(0, 100, matroska.CLUSTER_BYTES) and not cluster.takes(1, 100, 1) and not cluster.takes(0, 100 + 0x8000, 1) and cluster.takes(0, 99, 1)
    assert matroska.track_number(126) == b"\xfe" and matroska.track_number(127) == b"\x40\x7f" and containers._number(matroska.track_number(20000), 0, False) == (20000, 3)


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = made(1, 200)
    df = spark.createDataFrame(rows, FILE_FRAMES).withColumn("data", F.when(F.col("dts") == 37 * 150, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="broken"):
        matroska.export_matroska(df, tracks_of(spark, rows), str(tmp_path))
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []


def test_an_aborted_job_leaves_nothing(tmp_path):
    writer = matroska.PartsWriter(str(tmp_path), 5000)
    names = [x.split()[0] for x in FILE_FRAMES.split(", ")]
    message = writer.write(iter([dict(zip(names, r, strict=True)) for r in sorted(made(2, 20))]))
    assert len(message.rows) == 3 and any(p.is_file() for p in tmp_path.rglob("*"))
    writer.abort([message, None])
    assert list(tmp_path.iterdir()) == []

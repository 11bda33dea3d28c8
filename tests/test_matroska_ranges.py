"""Matroska files by ranges against the walk over whole files."""

import random

import pytest

from cuegrain.sinks import matroska as sink
from cuegrain.sources import containers
from cuegrain.sources import matroska as src
from cuegrain.sources.files import Ranges


def movie(seed, n, index=True, unknown=False, junk=False):
    """Bytes of a file: seek index, clusters, and behind them info, tracks, chapters."""
    rnd = random.Random(seed)
    clusters = b""
    for k in range(n):
        blocks = b"".join(sink.simple_block(rnd.randint(1, 3), i, rnd.random() < 0.3, bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 3, 700])))) for i in range(rnd.randrange(4)))
        one = sink.element(containers.CLUSTER, sink.number(containers.TIMECODE, k * 100) + blocks)
        if unknown and k % 2:
            one = one[:4] + b"\x01" + b"\xff" * 7 + one[12:]
        clusters += one
        if junk and k % 3 == 0:
            clusters += b"\x00\x00junk\x00"
    info = sink.element(containers.INFO, sink.number(containers.SCALE, 500_000) + sink.element(containers.TITLE, b"film"))
    tracks = sink.element(containers.TRACKS, b"".join(sink.track_entry({"number": t, "type": t, "codec_id": f"X{t}", "codec_private": b"p", "width": 1, "height": 2, "rate": None, "channels": None}) for t in (1, 2)))
    chapters = sink.element(containers.CHAPTERS, sink.element(containers.EDITION, sink.element(containers.ATOM, sink.number(containers.UID, 7) + sink.number(containers.START, 5))))
    seek = lambda base: sink.element(containers.SEEK_HEAD, b"".join(sink.element(containers.SEEK, sink.element(containers.SEEK_ID, i.to_bytes(4, "big")) + sink.number(containers.SEEK_POSITION, at)) for i, at in ((containers.INFO, base), (containers.TRACKS, base + len(info)), (containers.CHAPTERS, base + len(info) + len(tracks)))))
    head = seek(len(seek(0)) + len(clusters)) if index else b""
    return sink.element(containers.EBML, sink.element(containers.DOC_TYPE, b"matroska")) + sink.element(containers.SEGMENT, head + clusters + info + tracks + chapters)


@pytest.mark.parametrize("options", [{}, {"index": False}, {"unknown": True}, {"junk": True}, {"index": False, "junk": True}])
def test_ranges_equal_the_walk(spark, tmp_path, options):
    for seed in (1, 2):
        (tmp_path / f"{seed}.mkv").write_bytes(movie(seed, 25, **options))
    (tmp_path / "other.mkv").write_bytes(b"RIFF" * 30)
    (tmp_path / "empty.mkv").write_bytes(b"")
    for table in ("frames", "segment", "tracks", "chapters", "seeks"):
        want = sorted((f"{seed}.mkv", *(str(r[k]) for k in sorted(r))) for seed in (1, 2) for r in containers.walk_matroska(movie(seed, 25, **options))[table])
        for share in (1 << 26, 3000):
            df = src.read_matroska(spark, str(tmp_path), table, share=share).drop("entry")
            got = sorted((r["path"].rpartition("/")[2], *(str(r[k]) for k in sorted(set(df.columns) - {"path"}))) for r in df.collect())
            assert got == want, (table, share)
            assert got or table == "seeks"


def test_shares_are_tasks_and_few_bytes_are_read(spark, tmp_path):
    data = [sink.element(containers.CLUSTER, sink.number(containers.TIMECODE, k) + sink.simple_block(1, 0, True, bytes(200_000))) for k in range(60)]
    head = movie(1, 0)
    cut = head.index(containers.SEGMENT.to_bytes(4, "big"))
    body = b"".join(data)
    info = sink.element(containers.INFO, sink.number(containers.SCALE, 9))
    seek = lambda at: sink.element(containers.SEEK_HEAD, sink.element(containers.SEEK, sink.element(containers.SEEK_ID, containers.INFO.to_bytes(4, "big")) + sink.number(containers.SEEK_POSITION, at)))
    path = tmp_path / "long.mkv"
    path.write_bytes(head[:cut] + sink.element(containers.SEGMENT, seek(len(seek(0)) + len(body)) + body + info))
    with Ranges(str(path)) as f:
        tables, segment, first = src.heads(src.Lazy(f))
        assert tables["segment"][0]["scale"] == 9 and f.spent < 40_000  # straight to what stands behind the clusters
        f.spent = 0
        assert sum(1 for _ in src.frames(src.Lazy(f), 0, 1)) == 60 and f.spent < path.stat().st_size / 20
    df = src.read_matroska(spark, str(tmp_path), "frames", share=1_000_000)
    assert df.rdd.getNumPartitions() == 13 and df.count() == 60


def test_groups(spark):
    rows = [("f", 1, 1, "eng", False, 0), ("f", 2, 1, "ger", False, 1), ("f", 3, 1, "eng", False, 2), ("f", 4, 1, "fre", False, 3), ("f", 5, 17, "eng", True, 4), ("f", 6, 2, "eng", False, 5), ("g", 1, 2, "zzz", False, 0), ("g", 2, 18, "eng", True, 1)]
    tracks = spark.createDataFrame([(*r, 1_400_000) for r in rows], "path string, number long, type long, lang string, enabled boolean, entry long, default_duration long")
    got = {(r.path, r.number): (r.place, r.alternate_of, r.shown, r.frame_duration) for r in src.track_groups(tracks, spark.createDataFrame([("f", 500_000)], "path string, scale long")).collect()}
    assert got == {("f", 1): (1, None, False, 3), ("f", 2): (2, 1, False, 3), ("f", 3): (3, None, True, 3), ("f", 4): (4, 3, False, 3), ("f", 6): (5, None, True, 3), ("f", 5): (6, None, True, 3), ("g", 1): (1, None, True, 1)}

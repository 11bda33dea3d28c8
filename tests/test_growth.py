"""Steps whose cost is to grow with their input and no faster."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cuegrain.functions import machines
from cuegrain.operators import encodings
from cuegrain.plans import formats
from cuegrain.sources import avi
from cuegrain.sources import containers as c


def test_nested_elements_name_their_content_once(spark):
    digits = "hex('MARK')"
    for _ in range(8):
        digits = formats._el(c.ATOM, digits)
    assert digits.count("MARK") == 1
    data = bytes(spark.range(1).select(F.expr(f"unhex({digits})")).first()[0])
    at, end = 0, len(data)
    for _ in range(8):
        ((ident, at, end),) = c.elements(data, at, end)
        assert ident == c.ATOM
    assert data[at:end] == b"MARK"


def test_rows_of_small_files_come_together(spark):
    digits = formats._movie(formats._el(c.TRACKS, formats._el(c.TRACK, formats._num(c.NUMBER, "id"))))
    files = spark.range(0, 30, 1, 1).withColumn("p_size", F.lit(1)).select(F.col("id").cast("string").alias("path"), F.expr(f"unhex(concat({digits}))").alias("content"))
    rows = c.matroska_rows(files, "tracks")
    assert sorted((int(r.path), r.number) for r in rows.collect()) == [(i, i) for i in range(30)]
    frames = list(c._tables(iter([files.toPandas()]), "tracks"))
    assert len(frames) == 1 and list(frames[0]["number"]) == list(range(30))


def test_many_small_shares_are_dealt_to_few_tasks():
    files = [("a", 40_000_000), ("b", 7), ("c", 3_000_000), *((f"s{i}", 9_000) for i in range(3000))]
    tasks = avi.shares(files, 2000, True)
    assert 100 < len(tasks) < 400
    dealt = [x for t in tasks for x in t.shares]
    assert dealt == [(p, i, -(-n // 2000)) for p, n in files for i in range(-(-n // 2000))]  # each share once
    assert [len(t.shares) for t in avi.shares([("a", 10_000)], 2000, True)] == [1] * 5
    assert len(avi.shares([("a", 64 << 40)], 64 << 20, True)) == 1 << 20  # large shares stay what they are
    assert [p for t in tasks for p, _ in t.files()].count("b") == 1


def test_turns_of_many_files_are_dealt_to_few_tasks():
    reader = avi.AviStreamReader({"path": "unused"}, None)
    end = {f"f{i}": {"at": 900, "n": 4, "largest": 9, "size": 900, "waits": True, "done": True} for i in range(1000)}
    tasks = reader.partitions({"f7": {"at": 300, "n": 1}}, end)
    assert len(tasks) == avi.TASKS
    assert sorted((x.path, x.at, x.n, x.end) for t in tasks for x in t.turns) == sorted((f, 300 if f == "f7" else 0, 1 if f == "f7" else 0, 900) for f in end)
    assert reader.partitions(end, end) == []


def test_pairs_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(encodings, "COUNTED", 10)
    texts = ["", None, "a", "abcabcabcab", "x" * 35, "\U0001f600e" * 7, "0123456789"]
    want, got, sizes = Counter(), Counter(), []
    for t in texts:
        want.update(zip(t or "", [*(t or "")[1:], None], strict=False))
    for pairs, n in encodings.counted_pairs(texts):
        sizes.append(int(n.sum()))
        for p, k in zip(pairs.tolist(), n.tolist(), strict=True):
            b = p & encodings.NOTHING
            got[chr(p >> 21), None if b == encodings.NOTHING else chr(b)] += k
    assert got == want and max(sizes) < 20


def test_packets_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from cuegrain.plans import streams
    from cuegrain.plans.catalog import QUERIES

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("the driver's tables are not here")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(streams, "new_folder", lambda _, n=iter(range(9)): f"file://{tmp_path}/{next(n)}")
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = sorted(map(tuple, QUERIES["packed_stream"](spark, data).collect()))
        assert len(list((tmp_path / "0" / "packets").glob("part-*"))) > 8
    finally:
        spark.conf.set(key, before)
    assert got == sorted(map(tuple, QUERIES["packed_table"](spark, data).collect()))


def test_bands_come_from_all_clean_documents(spark, monkeypatch):
    from cuegrain.llm import quality_rules

    monkeypatch.setattr(quality_rules, "SAMPLE_ROWS", 10, raising=False)
    words = lambda i: " ".join(f"{(i * 7919 + k * 104729) % 99991:x}" for k in range(40))
    df = spark.createDataFrame([(i, words(i)) for i in range(300)], "doc_id long, text string")
    whole, _ = quality_rules.fit_bands(df, df.selectExpr("doc_id", "1 AS quality"))
    assert whole != quality_rules.BANDS


def test_commit_and_plan_of_many_files_take_a_step_a_folder(spark, tmp_path, monkeypatch):
    from cuegrain.plans import ranges
    from cuegrain.sinks import files as sink
    from cuegrain.sources import matroska

    monkeypatch.setattr(sink, "FOLDER", 10)
    writer = sink.FilesWriter(str(tmp_path / "mkv"), apart=True)
    done = [writer.write(iter([{"name": f"{k:08d}.mkv", "content": ranges.movie(k % 50 + 1)} for k in range(lo, lo + 25)])) for lo in (0, 25)]
    assert [len(m.files) for m in done] == [3, 3]  # what the commit moves
    writer.commit([*done, None])
    assert len(list(tmp_path.glob("mkv/*/*.mkv"))) == 50 and len(list(tmp_path.iterdir())) == 1
    reader = matroska.MatroskaReader({"path": str(tmp_path / "mkv"), "table": "scaled", "folders": "true"})
    monkeypatch.setattr(matroska, "listed", None)  # planning lists no files
    assert len(reader.partitions()) == 6
    monkeypatch.undo()
    tracks, segments = (matroska.read_matroska(spark, str(tmp_path / "mkv"), t) for t in ("tracks", "segment"))
    got = matroska.track_groups(matroska.read_matroska(spark, str(tmp_path / "mkv"), "scaled", folders=True))
    want = matroska.track_groups(tracks, segments)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())) and got.count() == 250


@pytest.mark.parametrize("name", machines.MACHINES)
def test_machines_compose_few_vectors_for_blocks_together(name, monkeypatch):
    plain = b"a quick brown fox, and then some plain words " * 200
    data = [b"", plain, b"~", plain + b"\x1b$B" + plain, b"\x1b", b"", "é漢".encode() + plain, b"\xe3\x81" + plain, b"x", plain + b"~{~{", b""]
    machines.classes(name)
    rows, take = [], np.take_along_axis
    monkeypatch.setattr(machines.np, "take_along_axis", lambda a, *rest: rows.append(len(a)) or take(a, *rest))
    states, stops = machines.blocks(name, data)
    assert sum(rows) < sum(map(len, data)) // (2 if name.startswith("iso") else 1) and len(rows) < 20  # not twenty steps a block
    rules = machines.table(name)
    for k, text in enumerate(data):
        for first in range(len(rules) - 2):
            state, stop = first, -1
            for i, byte in enumerate(text):
                state = int(rules[state, byte])
                if state >= len(rules) - 2:
                    stop = i
                    break
            assert (int(states[k, first]), int(stops[k, first])) == (state, stop), (k, first)

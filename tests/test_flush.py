"""End of input by event time: timers, late cues, restarts."""

import pytest

from cuegrain.plans.streams import rocks
from cuegrain.streaming import flush

CUE = "file long, num long, begin long, end long, line string, at long"


def steps(spark, tmp_path, batches, late="truncate"):
    """Packets after each batch; each batch is a run of its own that goes on from the checkpoint."""
    inp, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    found, before = [], []
    with rocks(spark):
        for rows in batches:
            spark.createDataFrame(rows, CUE).selectExpr("file", "num", "begin", "end", "line", "timestamp_millis(at) AS ts").coalesce(1).write.mode("append").parquet(inp)
            stream = spark.readStream.schema("file long, num long, begin long, end long, line string, ts timestamp").parquet(inp)
            run = flush.flushed_packets(stream, 1000, late=late).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            run.awaitTermination()
            now = sorted(tuple(r) for r in spark.read.schema(flush.PACKETS).parquet(out).collect())
            found.append([x for x in now if x not in before])
            before = now
    return found


BATCHES = [
    [(1, 0, 0, 10, "a", 100), (1, 1, 5, 12, "b", 100), (1, 2, 20, 30, "c", 100), (2, 0, 5, 5, "nothing", 100)],  # c closes a and b
    [(1, 3, 8, 25, "late", 200), (1, 4, 2, 9, "too late", 200), (2, 1, 3, 6, "x\n", 5000)],
    [(3, 0, 0, 1, "", 9000)],  # time passes the timer of file 1
    [(1, 5, 28, 40, "after", 9100), (4, 0, 0, 1, "z", 99_000)],
    [(4, 1, 50, 60, "z", 199_000)],
]


def test_cues_are_cut(spark, tmp_path):
    got = steps(spark, tmp_path, BATCHES)
    assert got[0] == [(1, 0, 5, "a\n", 0), (1, 5, 10, "a\nb\n", 0), (1, 10, 12, "b\n", 0)]
    seen = [x for step in got for x in step]
    one = sorted(x for x in seen if x[0] == 1)[3:]
    # late begins at 12, is cut there and stands beside c; what comes behind the flush begins at its end
    assert one == [(1, 12, 20, "late\n", 2), (1, 20, 25, "late\nc\n", 2), (1, 25, 30, "c\n", 2), (1, 30, 40, "after\n", 3)]
    assert [x for x in seen if x[0] == 2] == [(2, 0, 3, "\n", 0), (2, 3, 6, "x\n", 0)]
    assert [x for x in seen if x[0] == 3] == [(3, 0, 1, "\n", 0)]
    times = {}
    for file, begin, end, *_ in sorted(seen):
        assert begin == times.get(file, 0) and end > begin
        times[file] = end


def test_cues_are_dropped(spark, tmp_path):
    seen = [x for step in steps(spark, tmp_path, BATCHES, "drop") for x in step if x[0] == 1]
    assert seen[3:] == [(1, 12, 20, "\n", 2), (1, 20, 30, "c\n", 2)]


def test_wrong_treatment(spark):
    with pytest.raises(ValueError, match="never"):
        flush.flushed_packets(spark.createDataFrame([], CUE), 1, late="never")

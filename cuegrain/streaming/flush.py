"""Release of packets with an end of input by event time: a file from which nothing has come for a while is flushed by a timer, cues that come too late are counted."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .release import sweep

PACKETS = "file long, begin long, end long, text string, late long"
CUE = "begin long, num long, end long, line string"


class FlushProcessor(StatefulProcessor):
    """State of a file: the end of what has left, late cues so far and its timer; and the cues of the open cluster, one row each."""

    def __init__(self, gap: int, cut: bool):
        self.gap, self.cut = gap, cut

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "done long, late long, timer long")
        self.held = handle.getListState("held", CUE)

    def _packets(self, key, cues: list[tuple], done: int, late: int) -> Iterator[Row]:
        for begin, end, text in sweep(cues, done):
            yield Row(file=key[0], begin=begin, end=end, text=text, late=late)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done, late, timer = self.place.get() if self.place.exists() else (0, 0, 0)
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        top, seen = max((x[2] for x in held), default=0), 0
        for row in sorted(rows, key=lambda r: (r["begin"], r["num"])):
            begin, end, line = row["begin"], row["end"], row["line"] or ""
            seen = max(seen, row["at"])
            if begin >= end:
                continue
            if held and begin >= top:
                yield from self._packets(key, held, done, late)
                done, held = top, []
            if begin < done:
                late += 1
                if not self.cut or end <= done:
                    continue
                begin = done
            held.append((begin, row["num"], end, line if line.endswith("\n") else line + "\n"))
            top = max(x[2] for x in held)
        if timer:
            self.handle.deleteTimer(timer)
        timer = max(timer, seen + self.gap, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.place.update((done, late, timer))
        self.held.put(held) if held else self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        done, late, _ = self.place.get()
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        if held:
            yield from self._packets(key, held, done, late)
            done = max(x[2] for x in held)
            self.held.clear()
        self.place.update((done, late, 0))

    def close(self) -> None:
        pass


def flushed_packets(cues: DataFrame, gap: int, delay: str = "0 seconds", late: str = "truncate") -> DataFrame:
    """A stream of cues (file, num, begin, end, line, ts) as packets (file, begin, end, text, late).

    A cluster of overlapping cues leaves when a cue begins at or behind its end, or when the
    watermark of ts (with ``delay``) is ``gap`` milliseconds behind the file's last cue: that is the end
    of its input. A cue that begins before what has left is counted in ``late``, which packets carry
    as of their release, and cut to begin there ("truncate") or left out ("drop"). What comes
    behind a flush goes on from its end, so time never runs backward.
    """
    if late not in ("truncate", "drop"):
        raise ValueError(f"no such treatment of late cues: {late}")
    at = "CAST(unix_millis(ts) AS BIGINT) AS at"
    rows = cues.withWatermark("ts", delay).selectExpr("CAST(file AS BIGINT) AS file", "CAST(num AS BIGINT) AS num", "CAST(begin AS BIGINT) AS begin", "CAST(end AS BIGINT) AS end", "line", at, "ts")
    return rows.groupBy("file").transformWithState(FlushProcessor(gap, late == "truncate"), PACKETS, "Append", "EventTime")

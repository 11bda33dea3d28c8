"""Release of finished packets from a stream of cues, and the state of files that still arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PACKETS = "file long, begin long, end long, text string"


def sweep(cues: list[tuple[int, int, int, str]], start: int) -> list[tuple[int, int, str]]:
    """Packets of cues (begin, num, end, line) from ``start`` on; the same rule as the batch operator's."""
    times = sorted({start, *(t for b, _, e, _ in cues for t in (b, e) if t > start)})
    order, i, on, out = sorted(cues, key=lambda x: (x[0], x[1])), 0, [], []
    for a, b in zip(times, times[1:], strict=False):
        while i < len(order) and order[i][0] <= a:
            on.append(order[i])
            i += 1
        on = [x for x in on if x[2] >= b]
        out.append((a, b, "".join(x[3] for x in on) or "\n"))
    return out


def release_packets(cues: DataFrame, late: str = "truncate", idle: str | None = None) -> DataFrame:
    """A stream of cues (file, num, begin, end, line) as finished packets (file, begin, end, text).

    A cluster of overlapping cues is finished when a cue arrives that begins at or after the
    cluster's end; its packets then leave, with the gap before it. A cue that begins before what
    has left is cut to begin there (late="truncate") or left out (late="drop"); one that ends
    there as well is always left out, so time never runs backward. ``idle`` (such as "10 seconds")
    flushes a file from which nothing has come for so long; the last cluster stays open without it.
    State of a file: its last end and the cues of one open cluster.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held = (state.get[0], [tuple(x) for x in json.loads(state.get[1])]) if state.exists else (0, [])
        out: list[tuple[int, int, str]] = []

        def close() -> None:
            nonlocal done, held
            out.extend(sweep(held, done))
            done = max(x[2] for x in held)
            held = []

        if state.hasTimedOut:
            if held:
                close()
            state.remove()
        else:
            rows = sorted((int(b), int(n), int(e), s) for pdf in batches for b, n, e, s in zip(pdf["begin"], pdf["num"], pdf["end"], pdf["line"], strict=True))
            for b, n, e, s in rows:
                if b >= e:
                    continue
                if held and b >= max(x[2] for x in held):
                    close()
                if b < done:
                    if late == "drop" or e <= done:
                        continue
                    b = done
                held.append((b, n, e, s if s.endswith("\n") else s + "\n"))
            state.update((done, json.dumps(held)))
            if idle:
                state.setTimeoutDuration(int(float(idle.split()[0]) * 1000))
        if out:
            yield pd.DataFrame([(key[0], *p) for p in out], columns=["file", "begin", "end", "text"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return cues.groupBy("file").applyInPandasWithState(run, PACKETS, "done long, held string", "append", timeout)


def load_state(loaded: str = "loaded", duration: str = "duration", eta: str = "eta"):
    """Where a growing file stands: complete, playable through (10 s loaded, the rest sooner than 85 % of it plays), playable, or loading."""
    a, d, e = F.col(loaded), F.col(duration), F.col(eta)
    return F.when(a >= d, "complete").when((a > 10_000) & (e < d * 0.85), "playthrough").when(a > 0, "playable").otherwise("loading")


def publish_now(idles: str = "idles", paused: str = "paused", ahead: str = "ahead", most: int = 20):
    """Whether what is read is shown now: after ``most`` idle turns while paused, or with less than five seconds ahead."""
    return (F.col(paused) & (F.col(idles) > most)) | (F.col(ahead) < 5000)

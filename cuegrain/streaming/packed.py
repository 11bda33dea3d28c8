"""Packed bitstreams: packets that hold a picture and the ones shown after it, or come a packet late.

The same rule for one packet after another runs over a stream, with typed state for each file, and
over tables, whose files are read in order by sorted partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Packets (file, n, pictures): the kinds of a packet's pictures, one letter each (I, P, B, N: not coded), and their sizes.
PACKET = "file long, n long, kinds string, sizes array<int>"
#: What each packet shows: the kind, the picture (packet.place), the picture that must be decoded before it, and whether pictures come a packet late.
SHOWN = "file long, n long, kind string, shown string, needs string, late boolean"
STATE = "n long, late boolean, last string, future string, kind string, rest array<struct<id: string, kind: string, size: int>>"
#: Bytes behind a picture that don't count as another one.
SLACK = 16

Picture = tuple[str, str, int]  # (packet.place, kind, size)


@dataclass
class Order:
    """Where a stream stands. ``late``: pictures are shown when the next one comes; ``future``: the kind of the picture that waits to be shown by an empty packet."""

    n: int = -1
    late: bool = False
    last: str | None = None
    future: str | None = None
    kind: str = "I"
    rest: list[Picture] = field(default_factory=list)

    def step(self, n: int, pictures: list[Picture]) -> tuple[str | None, str | None, str | None]:
        """(kind, shown, needs) of packet ``n``."""
        jumped = n != self.n + 1
        if jumped:
            self.kind, self.rest, self.last = "I", [], None
        self.n = n
        have = self.rest or pictures
        if not have or (have[0][1] == "N" and self.future):
            kind, self.future = self.future, None
            return kind, self.last if kind else None, None
        (shown, kind, size), whole, before = have[0], sum(p[2] for p in have), self.last
        if kind == "B" and not self.late and not self.future:
            self.late = True  # it comes when it should have been shown
        elif self.late and size < whole - SLACK:
            self.late = False
        needs = None if kind == "I" else before
        if kind != "B":
            self.last = shown
            if self.late and not jumped:
                shown = before
        if self.late:
            kind, self.kind = self.kind, kind
        elif kind == "I":
            self.future = None
        if size >= sum(p[2] for p in pictures):
            self.rest = []
            return kind, shown, needs
        self.rest = have[1:]
        if self.rest and self.rest[0][1] == "B":  # the picture that follows is shown now, the first one later
            self.future, self.last, needs = kind, shown, shown
            shown, kind = self.rest[0][0], "B"
            self.rest = self.rest[1:]
        return kind, shown, needs


def pictures(n: int, kinds: str | None, sizes) -> list[Picture]:
    return [(f"{n}.{k}", kind, int(size)) for k, (kind, size) in enumerate(zip(kinds or "", sizes if sizes is not None else [], strict=True))]


class PackedProcessor(StatefulProcessor):
    """State of a file: one ``Order``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("order", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        order = Order()
        if self.state.exists():
            n, late, last, future, kind, rest = self.state.get()
            order = Order(n, late, last, future, kind, [(r[0], r[1], r[2]) for r in rest])
        for row in sorted(rows, key=lambda r: r["n"]):
            kind, shown, needs = order.step(row["n"], pictures(row["n"], row["kinds"], row["sizes"]))
            yield Row(file=key[0], n=row["n"], kind=kind, shown=shown, needs=needs, late=order.late)
        self.state.update((order.n, order.late, order.last, order.future, order.kind, order.rest))

    def close(self) -> None:
        pass


def packed_stream(packets: DataFrame) -> DataFrame:
    """SHOWN of a stream of packets that come in order, each file's in one batch after another.

    The session's state store must be one that transformWithState supports (RocksDB).
    """
    return packets.groupBy("file").transformWithState(PackedProcessor(), SHOWN, "Append", "None")


def packed_table(packets: DataFrame) -> DataFrame:
    """The same of a table. Files are dealt to partitions and read in order, a batch at a time; only one file's state is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, order = None, Order()
        for pdf in batches:
            out = []
            for f, n, kinds, sizes in zip(pdf["file"], pdf["n"], pdf["kinds"], pdf["sizes"], strict=True):
                if f != file:
                    file, order = f, Order()
                out.append((f, n, *order.step(n, pictures(n, kinds, sizes)), order.late))
            yield pd.DataFrame(out, columns=["file", "n", "kind", "shown", "needs", "late"])

    return packets.repartition("file").sortWithinPartitions("file", "n").mapInPandas(run, SHOWN)

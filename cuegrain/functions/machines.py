"""Coding machines as vectors of transitions.

A machine's table says to which state a byte leads from each state. A block of bytes is then one
vector, the state behind it for each state before it, and blocks are composed in any grouping: so a
long text is spread over tasks block by block and put together from the vectors.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: State 0 begins a character; the last state but one is FOUND (an escape sequence was read), the last one ERROR. Neither is left again.
START = 0

Rules = list[list[tuple[int, int, int]]]  # of each state: bytes from, to, next state

_ASCII = (0x00, 0x7F, 0)
_GR = (0xA1, 0xFE)

#: The byte ranges of the encodings, from their public descriptions.
CODINGS: dict[str, Rules] = {
    "utf-8": [
        [_ASCII, (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
        [(0x80, 0xBF, 0)], [(0x80, 0xBF, 1)], [(0x80, 0xBF, 2)], [(0xA0, 0xBF, 1)], [(0x80, 0x9F, 1)], [(0x90, 0xBF, 2)], [(0x80, 0x8F, 2)],
    ],
    "shift_jis": [[_ASCII, (0xA1, 0xDF, 0), (0x81, 0x9F, 1), (0xE0, 0xFC, 1)], [(0x40, 0x7E, 0), (0x80, 0xFC, 0)]],
    "euc-jp": [[_ASCII, (*_GR, 1), (0x8E, 0x8E, 2), (0x8F, 0x8F, 3)], [(*_GR, 0)], [(0xA1, 0xDF, 0)], [(*_GR, 1)]],
    "euc-kr": [[_ASCII, (*_GR, 1)], [(*_GR, 0)]],
    "euc-tw": [[_ASCII, (*_GR, 1), (0x8E, 0x8E, 2)], [(*_GR, 0)], [(0xA1, 0xB0, 3)], [(*_GR, 1)]],
    "big5": [[_ASCII, (0x81, 0xFE, 1)], [(0x40, 0x7E, 0), (0xA1, 0xFE, 0)]],
    "gb18030": [[_ASCII, (0x81, 0xFE, 1)], [(0x40, 0x7E, 0), (0x80, 0xFE, 0), (0x30, 0x39, 2)], [(0x81, 0xFE, 3)], [(0x30, 0x39, 0)]],
}

#: The sequences by which encodings of seven bits are known.
ESCAPES: dict[str, tuple[bytes, ...]] = {
    "iso-2022-jp": (b"\x1b(J", b"\x1b$@", b"\x1b$B", b"\x1b$(D"),
    "iso-2022-kr": (b"\x1b$)C",),
    "iso-2022-cn": (b"\x1b$)A", b"\x1b$)G", b"\x1b$*H"),
    "hz-gb-2312": (b"~{",),
}


@cache
def table(name: str) -> np.ndarray:
    """next[state, byte] of a machine, with FOUND and ERROR as the last two states."""
    if name in CODINGS:
        rules = CODINGS[name]
        n = len(rules)
        out = np.full((n + 2, 256), n + 1, np.uint8)
        for state, ranges in enumerate(rules):
            for lo, hi, after in ranges:
                out[state, lo : hi + 1] = after
    else:  # states are the beginnings of the sequences; bytes of the upper half are errors
        starts = sorted({s[:k] for s in ESCAPES[name] for k in range(len(s))}, key=lambda s: (len(s), s))
        n = len(starts)
        out = np.full((n + 2, 256), n + 1, np.uint8)
        for state, held in enumerate(starts):
            for byte in range(128):
                text = held + bytes([byte])
                if text in ESCAPES[name]:
                    out[state, byte] = n
                else:  # the longest end that is a beginning
                    out[state, byte] = starts.index(next(text[k:] for k in range(len(text) + 1) if text[k:] in starts))
    out[n], out[n + 1] = n, n + 1
    return out


MACHINES = (*CODINGS, *ESCAPES)


@cache
def classes(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector of each class of bytes, class of each byte, whether a class does the same twice as once)."""
    columns, of = np.unique(table(name).T, axis=0, return_inverse=True)
    return columns, of.ravel(), (np.take_along_axis(columns, columns.astype(np.intp), 1) == columns).all(1)


def _padded(vectors: np.ndarray, have: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of each block, filled up with identities to as many as wanted, first place of each block)."""
    first = np.cumsum(want) - want
    out = np.tile(np.arange(vectors.shape[1], dtype=np.uint8), (int(want.sum()), 1))
    out[np.arange(len(vectors)) + np.repeat(first - np.cumsum(have) + have, have)] = vectors
    return out, first


def blocks(name: str, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(state behind the bytes, place of the byte that led to FOUND or ERROR or -1) of each block, for each state before it.

    Of neighbours that do what the first one does the first one stands for all. The others are
    composed pair by pair, those of all blocks at once; the place is found on the way back down.
    """
    columns, of, same = classes(name)
    n = columns.shape[1]
    lens = np.fromiter(map(len, data), np.int64, len(data))
    begin = np.cumsum(lens) - lens
    kind = of[np.frombuffer(b"".join(data), np.uint8)]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | ~same[kind[1:]]
    keep[begin[lens > 0]] = True
    at = np.flatnonzero(keep)
    have = np.diff(np.searchsorted(at, np.r_[begin, len(kind)]))
    own = np.cumsum(have) - have
    end, _ = _padded(columns[kind[at]], have, np.maximum(have, 1))
    have, levels = np.maximum(have, 1), []
    while have.max(initial=0) > 1:
        levels.append(_padded(end, have, have + have % 2))
        end = np.take_along_axis(levels[-1][0][1::2], levels[-1][0][::2].astype(np.intp), 1)
        have = (have + 1) // 2
    stop = np.full(end.shape, -1)
    block, first = np.nonzero((end >= n - 2) & (np.arange(n) < n - 2))
    state, node = first, np.zeros(len(block), np.int64)
    for vectors, places in reversed(levels):
        node = 2 * node
        after = vectors[places[block] + node, state]
        on = after < n - 2
        state, node = np.where(on, after, state), node + on
    stop[block, first] = at[own[block] + node] - begin[block]
    return end, stop


def block(name: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``blocks`` of one."""
    end, stop = blocks(name, [data])
    return end[0], stop[0]

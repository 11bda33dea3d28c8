"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file. The normaliser reads characters and writes those of
its rules (the model's character map, the longest first), the mark for a space and the leading
mark. The piece machine is a tree of arcs by character whose final arcs write a piece and weigh
its negative score. The byte machine has an arc for every character that is no piece of its own;
it weighs more than any piece and writes the character's bytes, or the unknown piece. A text is
composed with the normaliser; each stretch that no piece crosses is then composed with the union
of the other two, arc by arc as it is read, and the path of least weight in the tropical semiring
is found by relaxing the arcs from place to place.

A unigram model's composed machine has one state a place. A BPE model's is composed with one more
machine, which remembers the last piece: going from piece a to piece b weighs 0 if the merges
applied to the letters of a and b give back just these two pieces, and is infinite otherwise. A
sequence of pieces is what the merges give for a text exactly if each neighbouring pair passes, so
one path of finite weight is left.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Stretches and pairs that a worker remembers before it starts anew.
CACHE = 400_000
MARK = "▁"
#: Model types in a model file's trainer settings, what an unknown character weighs beyond the worst piece, what a user's piece is worth.
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY, USER_BONUS = 10.0, 0.1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def _rules(blob: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(bytes, bytes they become) of a compiled character map: a double-array tree and the strings that its leaves point to."""
    if not blob:
        return
    size = struct.unpack_from("<I", blob)[0]
    units, strings = struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size :]
    step = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    todo = [(b"", step(units[0]))]
    while todo:
        path, at = todo.pop()
        for c in range(1, 256):
            u = units[at ^ c] if at ^ c < len(units) else 0
            if u & 0x800000FF != c:
                continue
            below = (at ^ c) ^ step(u)
            if u >> 8 & 1:
                begin = units[below] & 0x7FFFFFFF
                yield path + bytes([c]), strings[begin : strings.index(b"\0", begin)]
            todo.append((path + bytes([c]), below))


class Normaliser:
    """Machine from characters to characters: arcs of the rules' tree, and one that copies any other character."""

    def __init__(self, spec: dict, users: list[str]):
        self.prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.arcs: dict = {}
        for source, target in _rules(spec.get(2, b"")):
            try:
                self._add(source.decode(), target.decode())
            except UnicodeDecodeError:  # a rule for part of a character never matches text
                continue
        for piece in users:  # stay as they are
            self._add(piece, piece)

    def _add(self, source: str, target: str) -> None:
        node = self.arcs
        for c in source:
            node = node.setdefault(c, {})
        node[""] = target

    def written(self, text: str) -> str:
        """What the rules make of a text, the longest one at each place."""
        if not self.arcs:
            return text
        out, at = [], 0
        while at < len(text):
            node, k, end, best = self.arcs, at, at + 1, text[at]
            while k < len(text) and (node := node.get(text[k])) is not None:
                k += 1
                if "" in node:
                    end, best = k, node[""]
            out.append(best)
            at = end
        return "".join(out)

    def __call__(self, text: str) -> str:
        text = self.written(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).lstrip(" ")
        if text and self.prefix:
            text = " " + text
        if self.escape:
            text = text.replace(" ", MARK)
        return text.rstrip(MARK if self.escape else " ") if self.squeeze else text


class Transducer:
    """A compiled model. Built once a worker from the bytes of the model file."""

    def __init__(self, model: bytes):
        top = dict(_fields(model))
        trainer = dict(_fields(top.get(2, b"")))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.text, self.bytes_, self.out = [], {}, []
        self.arcs: dict = {}
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.unknown = sp.unk_id()
        pieces = [dict(_fields(v)) for n, v in _fields(model) if n == 1]
        users, plain = [], []
        for i, fields in enumerate(pieces):
            piece, kind = fields[1].decode(), fields.get(3, 1)  # 1 normal, 2 unknown, 3 control, 4 user's, 5 unused, 6 byte
            self.text.append(piece)
            if kind == 6:
                self.bytes_[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif kind in (1, 4):
                self.out.append(piece.replace(MARK, " ").encode())
                self.id[piece] = i
                self.score[piece] = sp.get_score(i)
                (users if kind == 4 else plain).append(piece)
            else:
                self.out.append(" ⁇ ".encode() if kind == 2 else b"")
        best, worst = (f((self.score[p] for p in plain), default=0.0) for f in (max, min))
        if users and self.kind == BPE:
            raise ValueError("BPE models with pieces of the user's are not supported")
        for p in users:
            self.score[p] = len(p) * best - USER_BONUS
        for p, i in self.id.items():
            node = self.arcs
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (p, -self.score[p])
        self.normalise = Normaliser(dict(_fields(top.get(3, b""))), users)
        self.other = -(worst - UNKNOWN_PENALTY)  # weight of an arc of the byte machine
        self.pairs: dict[tuple[str, str], float] = {}
        self.spines: dict[str, tuple] = {}
        # Stretches that no piece crosses: before the mark, where none has it behind another character, and around white space in no piece.
        letters = {c for p in self.id for c in p}
        alone = "".join(c for c in "\t\n\v\f\r" if c not in letters)
        whole = any(MARK in p.lstrip(MARK) for p in self.id) or any(" " in p for p in self.id)
        self.cut = (lambda s: [s] if s else []) if whole else re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else "")).findall
        transducer = self

        class Memory(dict):
            def __missing__(self, stretch: str) -> bytes:
                if len(self) >= CACHE:
                    self.clear()
                got = np.array(transducer.ids(transducer.shortest(stretch)), np.int32).tobytes()
                self[stretch] = got
                return got

        self.memory = Memory()

    def merged(self, s: str, edge: tuple[set[str], set[str]] | None = None) -> list[str]:
        """Pieces that the merges make of the letters of s, best score first, leftmost among equals.

        ``edge`` gathers what stands first and what stands last on the way.
        """
        parts = list(s)
        if edge:
            edge[0].add(parts[0])
            edge[1].add(parts[-1])
        while len(parts) > 1:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and score > best:
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if edge:
                edge[0].add(parts[0])
                edge[1].add(parts[-1])
        return parts

    def edges(self, a: str) -> tuple[bool, set[str], set[str]]:
        """Whether merging the letters of piece a gives it back; its first and its last parts on the way."""
        got = self.spines.get(a)
        if got is None:
            edge: tuple[set[str], set[str]] = (set(), set())
            got = self.spines[a] = (self.merged(a, edge) == [a], *edge)
        return got

    def next_to(self, a: str, b: str) -> float:
        """Weight of piece b behind piece a (none: at the start) in the machine of the merges: 0 or infinite."""
        ok, heads, _ = self.edges(b)
        if not a or not ok:
            return 0.0 if ok else math.inf
        ok, _, tails = self.edges(a)
        if not ok:
            return math.inf
        if not any(x + y in self.id for x in tails for y in heads):  # no merge can cross
            return 0.0
        return 0.0 if self.merged(a + b) == [a, b] else math.inf

    def shortest(self, s: str) -> list[str]:
        """Pieces and other characters along the path of least weight; the first found stays among equals."""
        n, bpe, pairs, other = len(s), self.kind == BPE, self.pairs, self.other
        cost, last, back = [math.inf] * (n + 1), [""] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for at in range(n):
            so_far = cost[at]
            if so_far == math.inf:
                continue
            state, node, k = last[at], self.arcs, at
            while k < n:
                node = node.get(s[k])
                k += 1
                final = None if node is None else node.get("")
                if final is None:
                    if k > at + 1:
                        if node is None:
                            break
                        continue
                    final = (s[at], other)  # the byte machine's arc
                    node = node or {}
                piece, w = final
                if bpe:
                    if cost[k] < math.inf:  # a text has one path, and so has each beginning
                        continue
                    w = pairs.get((state, piece))
                    if w is None:
                        if len(pairs) >= CACHE:
                            pairs.clear()
                        w = pairs[state, piece] = self.next_to(state, piece)
                w += so_far
                if w < cost[k]:
                    cost[k], last[k], back[k] = w, piece, at
        out, k = [], n
        while k:
            out.append(last[k])
            k = back[k]
        return out[::-1]

    def weight(self, pieces: list[str]) -> float:
        """What a path of these pieces and other characters weighs in a unigram model."""
        return sum(-self.score[p] if p in self.score else self.other for p in pieces)

    def ids(self, pieces: list[str]) -> list[int]:
        """What the arcs write: a piece's identifier, or those of a character's bytes, or the unknown one."""
        out: list[int] = []
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes_:
                out += [self.bytes_[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> np.ndarray:
        ids = np.frombuffer(b"".join(map(self.memory.__getitem__, self.cut(self.normalise(text)))), np.int32)
        if not self.bytes_:  # unknown characters in a row are one piece
            ids = ids[np.r_[True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)][: len(ids)]]
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of identifiers; the leading mark goes, and where the normaliser drops spaces each one before the first other character's piece."""
        ids = ids.tolist()
        parts = [self.out[i] for i in ids]
        if self.normalise.prefix or self.normalise.squeeze:
            for k, i in enumerate(ids):
                marked = self.text[i].startswith(MARK)
                parts[k] = parts[k][marked:]
                if parts[k] or marked and not self.normalise.squeeze:
                    break
        return b"".join(parts)


_held: dict[int, Transducer] = {}


def _machine(model: bytes) -> Transducer:
    """The worker's own machine: it and its memory outlive a task."""
    key = hash(model)
    if key not in _held:
        _held.clear()
        _held[key] = Transducer(model)
    return _held[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _broadcast(spark, model: str | None):
    with open(model or default_model(), "rb") as f:  # on the driver; tasks get its bytes
        return spark.sparkContext.broadcast(f.read())


def transduce(docs: DataFrame, model: str | None = None, decode: bool = False, rows: int = 256) -> DataFrame:
    """docs (column text) with ids, an array of piece identifiers, and with ``decode`` the text that they stand for, as decoded.

    Null texts give null, empty ones an empty array; no rows give no rows. Bytes that are not UTF-8 are read as U+FFFD.
    Columns of docs by these names are replaced; all others and repeated rows stay as they are.
    Results leave a task ``rows`` at a time, so that its memory doesn't grow with a batch.
    """
    held = _broadcast(docs.sparkSession, model)
    docs = docs.drop("ids", *["decoded"] * decode)
    names = [*docs.columns, "ids", *["decoded"] * decode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _machine(held.value)
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                ids = [None if t is None else m.encode(t.decode("utf-8", "replace")) for t in texts]
                out = [pa.array(ids, pa.list_(pa.int32()))]
                if decode:
                    out.append(pa.array([None if x is None else m.decode(x).decode("utf-8", "replace") for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names)

    schema = StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType())), *[StructField("decoded", StringType())] * decode])
    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, model: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the text that the identifiers stand for; null for null."""
    held = _broadcast(df.sparkSession, model)

    @F.pandas_udf("binary")
    def text(ids: pd.Series) -> pd.Series:
        m = _machine(held.value)
        return pd.Series([None if x is None else m.decode(x) for x in ids], dtype=object)

    return df.withColumn(out_col, text(F.col(ids_col)).cast("string"))


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_hash (XXH64 over the identifiers, seed 42), round_trip: what encoding and decoding gave."""
    out = transduce(docs.select("doc_id", "text"), model, decode=True)
    return out.select("doc_id", F.coalesce(F.size("ids").cast("long"), F.lit(0)).alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))

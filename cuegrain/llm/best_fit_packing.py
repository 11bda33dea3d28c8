"""Best-fit packing: documents into sequences of a fixed number of tokens by bin completion.

Only the lengths of pieces decide which sequence they go to, and there are at most as many lengths
as a sequence has tokens. So Spark counts the pieces of each length, the driver solves that table
of ``capacity`` rows at most by branch and bound, whatever the size of the corpus, and Spark deals
the pieces out to the sequences of the solution by their number among the pieces of equal length.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

CAPACITY = 4096
#: Id that closes each document.
END_ID = 1
#: Steps of the search, and fillings looked at for each largest piece; the best solution found by then holds.
NODES, FILLINGS = 20_000, 256

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it) in one sequence


# ---------------------------------------------------------------- ids

#: Words kept by a task, and the bytes that a kept word has at most.
MEMO, MEMO_WORD = 400_000, 64
#: Bytes of a text that are taken apart at once.
SLICE = 1 << 20

_blank = re.compile(rb"[\x20\x09-\x0D]")
_printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Bytes that don't print are written as characters from 256 on, in order.
_as_characters = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _printed)}


class WordIds(dict):
    """Ids of a text, equal to those of the library's ``encode``, put together from the ids of its words.

    The model's normaliser and splitter see no further than blanks, so that a word (what stands
    between blanks) has the same ids in every text. Words of small letters, and the marks behind
    them, go to the model itself, others through the whole library; the ids of a bounded number of
    words are kept. Texts with the model's special strings go to the library in one piece.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the short cuts hold for models that lower case, drop blanks and write bytes as characters
        self.plain = self._library("Aa b é".encode()) == b"".join(map(self._model, ("aa", "b", "é")))
        self.old: dict[bytes, bytes] = {}

    def _library(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([word.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _model(self, letters: str) -> bytes:
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_as_characters)
        return array("I", [k.id for k in self.tokenizer.model.tokenize(letters)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            body = word.rstrip(b".,;:!?")
            letters = body.decode("utf-8", "replace")
            if len(body) > MEMO_WORD or not letters.isalpha() or letters != letters.lower() or not is_normalized("NFC", letters):
                ids = self._library(word)
            elif body == word:
                ids = self._model(letters)
            else:
                ids = self[body] + self[word[len(body) :]]
        if len(word) <= MEMO_WORD:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        whole, out, lo = text.encode("utf-8", "replace"), [], 0
        raw = whole.lower()
        if not self.plain or any(s in raw for s in self.special):
            return self._library(whole)
        while lo < len(raw):
            hi = lo + SLICE
            blank = _blank.search(raw, hi) if hi < len(raw) else None
            hi = blank.start() if blank else len(raw)
            out.append(b"".join(map(self.__getitem__, raw[lo:hi].split())))
            lo = hi
        return b"".join(out)


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One of each model a worker: later tasks of the worker find its words."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit numbers) of each piece of each row.

    A document is the ids of its text and then ``end_id``; a null text is an empty one, so that
    each row has a piece at least. Longer documents than ``capacity`` are cut; rows that repeat a
    doc_id, and those without one, are documents of their own. Very long texts are taken apart
    slice by slice. Other columns are left out. ``path`` is the model's file on each machine.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path).of

        def batch(rows: list[tuple], held: list, doc_ids: pa.Array) -> pa.RecordBatch:
            n, start, length = (np.fromiter((r[k] for r in rows), np.int64, len(rows)) for k in range(3))
            at = pa.array(np.fromiter((r[3] for r in rows), np.int64, len(rows)))
            return pa.RecordBatch.from_arrays([doc_ids.take(at), pa.array(n.astype(np.int32)), pa.array(start), pa.array(length), pa.array(held, pa.binary())], names=[f.name for f in schema])

        for b in batches:
            doc_ids, rows, held, size = b.column(0), [], [], 0
            for i, text in enumerate(b.column(1)):
                ids = encode(text.as_py() or "") + end
                for n, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[lo : lo + 4 * capacity]
                    rows.append((n, lo // 4, len(cut) // 4, i))
                    held.append(cut)
                    size += len(cut)
                    if size > 8 << 20:
                        yield batch(rows, held, doc_ids)
                        rows, held, size = [], [], 0
            if rows:
                yield batch(rows, held, doc_ids)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ---------------------------------------------------------------- bin completion


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: pieces over half a sequence never share one, and what is too long for their room comes on top."""
    lengths = np.arange(capacity + 1)
    number = np.concatenate([[0], np.cumsum(counts)])  # pieces shorter than i
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    half, best = capacity // 2, 0
    for k in range(half + 1):
        alone = number[-1] - number[capacity - k + 1]
        large = number[capacity - k + 1] - number[half + 1]
        room = large * capacity - (tokens[capacity - k + 1] - tokens[half + 1])
        rest = tokens[half + 1] - tokens[k]
        best = max(best, int(alone + large + max(0, -((room - rest) // capacity))))
    return best


def best_fit(counts: list[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest pieces first, for all sequences that are alike at once."""
    open_: dict[int, dict[Pattern, int]] = {}  # room: {pattern: sequences}
    rooms = 0  # bit r: there are sequences with room r

    def put(room: int, pattern: Pattern, n: int) -> None:
        nonlocal rooms
        group = open_.setdefault(room, {})
        group[pattern] = group.get(pattern, 0) + n
        rooms |= 1 << room

    for length in range(capacity, 0, -1):
        left = counts[length]
        while left:
            fits = rooms >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                group = open_[room]
                pattern, n = next(iter(group.items()))
                took = min(room // length, left)
                times = min(n, left // took)
                if n == times:
                    del group[pattern]
                    if not group:
                        rooms &= ~(1 << room)
                else:
                    group[pattern] = n - times
            else:
                room, pattern = capacity, ()
                took = min(room // length, left)
                times = left // took
            put(room - took * length, (*pattern, (length, took)), times)
            left -= took * times
    return [(p, n) for group in open_.values() for p, n in group.items()]


def fillings(counts: list[int], room: int, top: int, allowed: int) -> Iterator[tuple[int, list[int]]]:
    """(waste, lengths) of undominated fillings of a room with pieces no longer than ``top``: exact ones as they are found, then the others by their waste.

    A filling is dominated if a longer piece that is left fits in the place of one or two of its own.
    """
    mask = 0
    for length in range(1, min(top, room) + 1):
        if counts[length]:
            mask |= 1 << length
    stack: list[int] = []
    seen, rest, kept = 0, room, []

    def next_below(bound: int) -> int:
        """The longest piece of at most ``bound`` that is left."""
        m = mask & ((2 << bound) - 1) if bound > 0 else 0
        while m:
            length = m.bit_length() - 1
            if counts[length] > stack.count(length):
                return length
            m &= ~(1 << length)
        return 0

    def dominated() -> bool:
        if not rest and len(stack) < 2:
            return False
        for i, x in enumerate(stack):
            if rest and next_below(min(x + rest, top)) > x:
                return True
            for y in stack[:i]:
                if x + y <= top and next_below(min(x + y + rest, top)) >= x + y:
                    return True
        return False

    bound = min(top, room)
    while True:
        x = next_below(min(bound, rest))
        if x:
            stack.append(x)
            rest -= x
            bound = x
            continue
        seen += 1
        if rest <= allowed and not dominated():
            if rest == 0:
                yield 0, stack.copy()
            else:
                kept.append((rest, stack.copy()))
        if not stack or seen >= FILLINGS:
            break
        x = stack.pop()  # the next shorter piece in the place of the last
        rest += x
        bound = x - 1
        while bound == 0 and stack:
            x = stack.pop()
            rest += x
            bound = x - 1
    yield from sorted(kept, key=lambda f: (f[0], [-x for x in f[1]]))


def bin_completion(counts: np.ndarray, capacity: int, nodes: int | None = None) -> list[tuple[Pattern, int]]:
    """(pattern, number of sequences) that hold counts[length] pieces of each length, in as few sequences as the search finds.

    The longest piece left opens a sequence, and each undominated filling of its room is a branch;
    as many sequences as there are pieces for are filled alike at once. A branch ends where the
    room it has wasted is more than what the wanted number of sequences can spare. The wanted
    number starts at the lower bound; best-fit solutions, of the whole and of what a branch has
    left, are the incumbents. After ``nodes`` steps the best incumbent holds.
    """
    budget = NODES if nodes is None else nodes
    start = [int(x) for x in counts]
    tokens = sum(n * x for n, x in enumerate(start))
    best = best_fit(start, capacity)
    used = sum(n for _, n in best)
    low = lower_bound(np.asarray(counts, np.int64), capacity)
    target, closings = low, 64
    while target < used and budget > 0:
        left, spare = start.copy(), target * capacity - tokens
        path: list[tuple[Pattern, int]] = []
        branches: list[Iterator] = []
        wasted: list[int] = []
        top = capacity
        share = max(1000, budget // 4)
        while share > 0 and budget > 0:
            while top and not left[top]:
                top -= 1
            if not top:
                best, used = list(path), sum(n for _, n in path)
                break
            if len(branches) == len(path):
                left[top] -= 1
                branches.append((top, fillings(left, capacity - top, top, spare)))
                left[top] += 1
            length, branch = branches[-1]
            share, budget = share - 1, budget - 1
            left[length] -= 1  # fillings look at what is left beside the longest piece
            found = next(branch, None)
            left[length] += 1
            if found is not None:
                waste, filling = found
                need: dict[int, int] = {length: 1}
                for x in filling:
                    need[x] = need.get(x, 0) + 1
                times = min(left[x] // m for x, m in need.items())
                if waste:
                    times = min(times, max(1, spare // waste))
                for x, m in need.items():
                    left[x] -= m * times
                spare -= waste * times
                wasted.append(waste * times)
                path.append((tuple(need.items()), times))
                continue
            if closings:  # what is left goes by best fit
                closings -= 1
                closed = path + best_fit(left, capacity)
                n = sum(n for _, n in closed)
                if n < used:
                    best, used = closed, n
                    if used <= target:
                        break
            branches.pop()
            if not path:
                break
            pattern, times = path.pop()
            for x, m in pattern:
                left[x] += m * times
            spare += wasted.pop()
            top = pattern[0][0]
        target += 1
    return best


# ---------------------------------------------------------------- packing


def slots(solution: list[tuple[Pattern, int]]) -> pd.DataFrame:
    """For each pattern and length: pieces first..first+times*each-1 of that length go to sequences from ``sequence`` on, ``each`` to one, from ``offset`` on."""
    rows, given, sequence = [], {}, 0
    for pattern, times in solution:
        offset = 0
        for length, each in pattern:
            rows.append((length, given.get(length, 0), each, sequence, offset))
            given[length] = given.get(length, 0) + each * times
            offset += length * each
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "offset"]).astype("int64").sort_values(["length", "first"], ignore_index=True)


def pack(rows: DataFrame, capacity: int = CAPACITY, nodes: int | None = None) -> DataFrame:
    """The rows, each with ``sequence_id`` and ``offset``: no sequence holds more than ``capacity`` tokens, and there are no gaps.

    ``rows`` has a column ``length`` of 1 to ``capacity``; others go along (those named
    sequence_id or offset are replaced). Which of the rows of equal length goes where is settled
    by their places in the written table, so nothing but counts by length reaches the driver:
    ``capacity`` numbers, and a solution of some multiples of that. An empty table has no sequence.
    """
    spark = rows.sparkSession
    rows = rows.drop("sequence_id", "offset")
    names = rows.columns
    if bad := [c for c in names if c.startswith("_pack_")]:
        raise ValueError(f"columns {bad} have names that packing uses")
    scratch = Scratch(spark)
    placed = scratch.save(rows.withColumn("_pack_row", F.monotonically_increasing_id()), "rows")
    placed = placed.withColumn("_pack_part", F.shiftright("_pack_row", 33))
    counts = placed.groupBy("_pack_part", "length").agg(F.count(F.lit(1)).alias("_pack_n"))
    table = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("_pack_n").alias("n")).collect():  # capacity rows at most
        if r["length"] is None or not 0 < r["length"] <= capacity:
            raise ValueError(f"a length of {r['length']} is not from 1 to {capacity}")
        table[r["length"]] = r["n"]
    where = spark.sparkContext.broadcast(slots(bin_completion(table, capacity, nodes)).to_numpy())
    before = F.sum("_pack_n").over(Window.partitionBy("length").orderBy("_pack_part")) - F.col("_pack_n")  # a row a written part
    of_part = Window.partitionBy("_pack_part", "length").orderBy("_pack_row")
    numbered = placed.withColumn("_pack_k", F.row_number().over(of_part)).join(counts.withColumn("_pack_before", before).drop("_pack_n"), ["_pack_part", "length"])
    numbered = numbered.select(*names, (F.col("_pack_before") + F.col("_pack_k") - 1).alias("_pack_rank"))
    schema = T.StructType([*(numbered.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at, rank_at = names.index("length"), len(names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, each, sequence, offset = where.value.T
        for b in batches:
            x, rank = b.column(at).to_numpy().astype(np.int64), b.column(rank_at).to_numpy()
            # rows of a length stand together and in order: search all lengths at once by splitting ranks from lengths
            lo, hi = np.searchsorted(length, x, "left"), np.searchsorted(length, x, "right")
            while True:
                open_ = hi - lo > 1
                if not open_.any():
                    break
                mid = (lo + hi) // 2
                below = first[mid] <= rank
                lo, hi = np.where(open_ & below, mid, lo), np.where(open_ & ~below, mid, hi)
            k = rank - first[lo]
            out = [*b.columns[:rank_at], pa.array(sequence[lo] + k // each[lo]), pa.array(offset[lo] + k % each[lo] * x)]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

    return numbered.mapInArrow(deal, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids of each sequence, from packed pieces with their ids; a sequence is bounded by its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    digests = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digests)

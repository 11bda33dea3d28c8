"""Encodings of bytes: coding machines over blocks, and models of letters and their pairs that are fitted on texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import machines

#: Bytes of a block, and of the blocks that a task composes at once.
BLOCK, TOGETHER = 1 << 16, 1 << 19
SUMMARY = "file {}, block long, machine string, states array<int>, stops array<long>"


def blocks(texts: DataFrame, size: int = BLOCK) -> DataFrame:
    """file, block, data: texts (file, content) cut into blocks of ``size`` bytes, which are dealt out, so that a long text is spread over tasks."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / size)).cast("long")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = texts.where("content IS NOT NULL").select("file", "content", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
    return cut.select("file", "block", F.col("content").substr((F.col("block") * size + 1).cast("int"), F.lit(size)).alias("data")).repartition(parts, "file", "block")


def summaries(parts: DataFrame, names: tuple[str, ...] = machines.MACHINES, size: int = BLOCK) -> DataFrame:
    """What each block does to each machine: the state behind it and where it ends the machine, for each state before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, TOGETHER // size)
        for b in (b.slice(k, step) for b in batches for k in range(0, b.num_rows, step)):
            data, number = b.column("data").to_pylist(), b.column("block").to_numpy()
            for name in names:
                states, stops = machines.blocks(name, data)
                stops = np.where(stops >= 0, stops + number[:, None] * size, -1)
                cuts = pa.array(np.arange(len(data) + 1, dtype=np.int32) * states.shape[1])
                lists = (pa.ListArray.from_arrays(cuts, pa.array(x.ravel().astype(t))) for x, t in ((states, np.int32), (stops, np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array([name] * len(data)), *lists], ["file", "block", "machine", "states", "stops"])

    return parts.mapInArrow(run, SUMMARY.format(parts.schema["file"].dataType.simpleString()))


def composed(found: DataFrame) -> DataFrame:
    """file, machine, state, stop (the byte that led to an error or was the last of an escape sequence; null for none): blocks put together in their order."""
    row = F.array_sort(F.collect_list(F.struct("block", "states", "stops")))  # a text has at most 2 GB, so some ten thousand short rows
    zero = F.struct(F.lit(0).alias("state"), F.lit(-1).cast("long").alias("stop"))
    walk = F.aggregate(row, zero, lambda a, x: F.struct(F.get(x["states"], a["state"]).alias("state"), F.when(a["stop"] >= 0, a["stop"]).otherwise(F.get(x["stops"], a["state"])).alias("stop")))
    ends = found.groupBy("file", "machine").agg(walk.alias("x"), F.max(F.size("states")).alias("n"))
    return ends.select("file", "machine", F.when(F.col("x.state") == F.col("n") - 1, "error").when(F.col("x.state") == F.col("n") - 2, "found").when(F.col("x.state") == 0, "complete").otherwise("partial").alias("state"), F.when(F.col("x.stop") >= 0, F.col("x.stop")).alias("stop"))


def coded(texts: DataFrame, names: tuple[str, ...] = machines.MACHINES, size: int = BLOCK) -> DataFrame:
    """How texts (file, content) end in each machine: complete, partial (within a character), found or error, and where."""
    return composed(summaries(blocks(texts, size), names, size))


def escape_coding(texts: DataFrame, size: int = BLOCK) -> DataFrame:
    """file, charset, stop of texts that use a coding of seven bits: machines run side by side, the one that is done first wins."""
    done = coded(texts, tuple(machines.ESCAPES), size).where("state = 'found'")
    return done.groupBy("file").agg(F.min(F.struct("stop", "machine")).alias("x")).select("file", F.col("x.machine").alias("charset"), "x.stop")


# ---------------------------------------------------------------- letters and pairs

#: Letters of a model, pairs of its two frequent classes each.
LETTERS, PAIRS = 64, 512
#: A text without pairs; the most that a model says.
LEAST, MOST = 0.01, 0.99


#: Characters that are counted at once in a task; stands for no character, beyond all code points.
COUNTED, NOTHING = 1 << 20, (1 << 21) - 1


def counted_pairs(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs as first << 21 | second, their counts) of COUNTED characters at a time, however many texts there are and however long one is."""
    held, n = [], 0
    for text in texts:
        if not text:
            continue
        for at in range(0, len(text), COUNTED):
            codes = np.frombuffer(text[at : at + COUNTED + 1].encode("utf-32-le"), np.uint32).astype(np.int64)
            behind = np.append(codes[1:], NOTHING)
            held.append((codes << 21 | behind)[:COUNTED])  # of what is cut, the character behind the cut is only a second one
            n += len(held[-1])
            if n >= COUNTED:
                yield np.unique(np.concatenate(held), return_counts=True)
                held, n = [], 0
    if held:
        yield np.unique(np.concatenate(held), return_counts=True)


def pair_counts(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key, a, b, n: pairs of neighbouring characters (code points), counted in the task first; b is null for the last character of a text, so that sums over b count characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, own in pdf.groupby("k", dropna=False, sort=False)["t"]:
                for pairs, n in counted_pairs(own):
                    a, b = pairs >> 21, pairs & NOTHING
                    yield pd.DataFrame({"k": name if isinstance(name, str) else None, "a": a, "b": np.where(b == NOTHING, -1, b), "n": n})

    counted = texts.select(F.col(key).cast("string").alias("k"), F.col(column).alias("t")).mapInPandas(run, "k string, a int, b int, n long")
    return counted.groupBy("k", "a", F.when(F.col("b") >= 0, F.col("b")).alias("b")).agg(F.sum("n").alias("n")).withColumnRenamed("k", key)


def is_letter(code: Column) -> Column:
    """Whether a code point is a letter."""
    return character(code).rlike(r"^\p{L}$")


def character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def letter_ranks(pairs: DataFrame, key: str, letters: int = LETTERS) -> DataFrame:
    """key, letter, n, rank: the letters of each language by their counts; ties go to the lower code point."""
    counts = pairs.groupBy(key, F.col("a").alias("letter")).agg(F.sum("n").alias("n")).where(is_letter(F.col("letter")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "letter"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= letters)


def pair_ranks(pairs: DataFrame, ranks: DataFrame, key: str, of_class: int = PAIRS) -> DataFrame:
    """key, first, second (ranks of letters), n, class: pairs of ranked letters; 3 for the most frequent, 2 for the next, 1 for the other ones that occur."""
    one = ranks.select(key, F.col("letter").alias("a"), F.col("rank").alias("first"))
    two = ranks.select(key, F.col("letter").alias("b"), F.col("rank").alias("second"))
    known = pairs.join(one, [key, "a"]).join(two, [key, "b"]).select(key, "first", "second", "n")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first", "second"))
    return known.withColumn("class", F.when(place <= of_class, 3).when(place <= 2 * of_class, 2).otherwise(1))


class EncodingModels:
    """Models of languages, each under each of some charsets of one byte a character.

    A model has at most LETTERS letters and their pairs, so what is collected here has a fixed size:
    65,536 classes for each pair of language and charset.
    """

    def __init__(self, docs: DataFrame, charsets: tuple[str, ...], lang: str = "lang"):
        """``docs`` (lang, text) are the texts that the models learn from."""
        pairs = pair_counts(docs.select(F.col(lang).alias("lang"), F.lower("text").alias("text")), "lang").where("lang IS NOT NULL")
        ranks = letter_ranks(pairs, "lang")
        self.spark, self.charsets = docs.sparkSession, charsets
        letters = ranks.collect()  # LETTERS a language
        classes = pair_ranks(pairs, ranks, "lang").collect()  # LETTERS * LETTERS a language at most
        self.langs = sorted({r["lang"] for r in letters})
        self.order, self.classes, self.ratio = {}, {}, {}
        for name in self.langs:
            own = {chr(r["letter"]): r["rank"] - 1 for r in letters if r["lang"] == name}
            matrix = np.zeros((LETTERS + 1, LETTERS + 1), np.uint8)
            seen = total = 0
            for r in classes:
                if r["lang"] == name:
                    matrix[r["first"] - 1, r["second"] - 1] = r["class"]
                    total += r["n"]
                    seen += r["n"] * (r["class"] == 3)
            self.ratio[name] = seen / total if total else 1.0
            for charset in charsets:
                chars = [bytes([b]).decode(charset, "replace").lower() for b in range(256)]
                order = np.array([own.get(c, LETTERS) for c in chars])
                self.order[name, charset] = (order, np.array([c.isalpha() for c in chars]))
                self.classes[name, charset] = matrix[order[:, None], order[None, :]].ravel()

    def scores(self, texts: DataFrame) -> DataFrame:
        """file, lang, charset, confidence of texts (file, content): the share of frequent pairs, against that of the language, times the share of its letters."""
        names = [(a, b) for a in self.langs for b in self.charsets]
        orders, classes, ratio = self.order, self.classes, self.ratio

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for file, content in zip(pdf["file"], pdf["content"], strict=True):
                    data = np.frombuffer(bytes(content), np.uint8)
                    pairs, times = np.unique(data[:-1].astype(np.int32) << 8 | data[1:], return_counts=True)
                    single = np.bincount(data, minlength=256)
                    for name in names:
                        order, letter = orders[name]
                        inside = (order[pairs >> 8] < LETTERS) & (order[pairs & 255] < LETTERS)
                        total = int(times[inside].sum())
                        best = int(times[inside & (classes[name][pairs] == 3)].sum())
                        known, all_ = int(single[order < LETTERS].sum()), int(single[letter].sum() + single[128:][~letter[128:]].sum())
                        out.append((file, *name, min(MOST, best / total / ratio[name[0]] * known / all_) if total else LEAST))
                yield pd.DataFrame(out, columns=["file", "lang", "charset", "confidence"])

        return texts.mapInPandas(run, f"file {texts.schema['file'].dataType.simpleString()}, lang string, charset string, confidence double")

    def detect(self, texts: DataFrame) -> DataFrame:
        """file, charset, lang, confidence: UTF-8 where its machine ends well behind other characters than ASCII, a coding of seven bits where its sequences occur, else the best model; of equal ones the first charset."""
        texts = texts.where("content IS NOT NULL")
        place = F.array_position(F.array(*(F.lit(c) for c in self.charsets)), F.col("charset"))
        best = self.scores(texts).groupBy("file").agg(F.max_by(F.struct("lang", "charset", "confidence"), F.struct("confidence", -place)).alias("x"))
        utf = coded(texts, ("utf-8",)).where("state = 'complete'").select("file", F.lit(True).alias("utf"))
        high = texts.select("file", F.decode("content", "ISO-8859-1").rlike(r"[\x80-\xff]").alias("high"))
        seven = escape_coding(texts).select("file", F.col("charset").alias("seven"))
        out = best.join(utf, "file", "left").join(high, "file").join(seven, "file", "left")
        charset = F.when(F.col("seven").isNotNull(), F.col("seven")).when(~F.col("high"), "us-ascii").when(F.col("utf"), "utf-8").otherwise(F.col("x.charset"))
        return out.select("file", charset.alias("charset"), F.col("x.lang").alias("lang"), F.col("x.confidence").alias("confidence"))


def decoded(content: Column, charset: Column) -> Column:
    """Texts from bytes of the charset that each has; what can't be read becomes a replacement character."""

    @F.pandas_udf("string")
    def run(content: pd.Series, charset: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or n is None else bytes(c).decode(n, "replace") for c, n in zip(content, charset, strict=True)], dtype=object)

    return run(content, charset)

"""Coding machines and fitted models of letters, over the texts of documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import encodings
from .registry import query

#: Bytes that are put behind a text, by its number: none, a byte that begins no character, half a character, half a surrogate, a character.
TAILS = (b"", b"\x80", b"\xc3", b"\xed\xa0\x80", b"\xf0\x9f\x98\x80")


@query("coding_utf8", """
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, doc_id % 5 AS tail, doc_id % 2 = 1 AS more FROM documents)
SELECT doc_id, CASE WHEN tail IN (1, 3) OR (tail = 2 AND more) THEN 'error' WHEN tail = 2 THEN 'partial' ELSE 'complete' END AS state,
  CASE WHEN tail = 1 THEN n WHEN tail = 3 OR (tail = 2 AND more) THEN n + 1 END AS stop FROM d""", long="stop")
def coding_utf8(t):
    """How texts with broken ends do in the machine of UTF-8, in blocks of 1,000 bytes."""
    tail = F.element_at(F.array(*(F.lit(x) for x in TAILS)), (F.col("doc_id") % 5 + 1).cast("int"))
    more = F.when(F.col("doc_id") % 2 == 1, F.lit(b" more")).otherwise(F.lit(b""))
    texts = t("documents").select(F.col("doc_id").alias("file"), F.concat(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), tail, more).alias("content"))
    return encodings.coded(texts, ("utf-8",), 1000).select(F.col("file").alias("doc_id"), "state", "stop")


ESCAPES = (b"", b"\x1b$B", b"\x1b$)C", b"\x1b$)A", b"~{")


@query("escape_codings", r"""
WITH d AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\x01-\x1A\x20-\x7D]', '', 'g')) AS n, doc_id % 5 AS kind FROM documents)
SELECT doc_id, ['iso-2022-jp', 'iso-2022-kr', 'iso-2022-cn', 'hz-gb-2312'][kind] AS charset, n + [2, 3, 3, 1][kind] AS stop FROM d WHERE kind > 0""", long="stop")
def escape_codings(t):
    """Texts of seven bits with an escape sequence behind them, and another one that comes too late."""
    plain = F.encode(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x01-\x1A\x20-\x7D]", ""), "UTF-8")
    own = F.element_at(F.array(*(F.lit(x) for x in ESCAPES)), (F.col("doc_id") % 5 + 1).cast("int"))
    later = F.when(F.col("doc_id") % 5 == 0, F.lit(b"")).otherwise(F.lit(b"\x1b$)C~{"))
    texts = t("documents").select(F.col("doc_id").alias("file"), F.concat(plain, own, later).alias("content"))
    return encodings.escape_coding(texts, 1000).select(F.col("file").alias("doc_id"), "charset", "stop")


def learned(t) -> DataFrame:
    """Four in five documents, of which models learn."""
    return t("documents").where("doc_id % 5 <> 0")


_CHARS = """
c AS (SELECT lang, doc_id, unnest(string_split(lower(text), '')) AS a, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE doc_id % 5 <> 0 AND lang IS NOT NULL),
l AS (SELECT lang, a AS letter, count(*) AS n FROM c WHERE regexp_matches(a, '^\\p{L}$') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, unicode(letter)) AS rank FROM l QUALIFY rank <= 64)"""


@query("letter_ranks", f"WITH {_CHARS} SELECT lang, letter, n, CAST(rank AS INTEGER) AS rank FROM r".replace("\\\\p", "\\p"))
def letter_ranks(t):
    pairs = encodings.pair_counts(learned(t).select("lang", F.lower("text").alias("text")), "lang").where("lang IS NOT NULL")
    return encodings.letter_ranks(pairs, "lang").select("lang", encodings.character(F.col("letter")).alias("letter"), "n", F.col("rank").cast("int").alias("rank"))


@query("pair_classes", f"""WITH {_CHARS},
p AS (SELECT lang, a, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM c),
k AS (SELECT p.lang, x.rank AS first, y.rank AS second, count(*) AS n FROM p JOIN r x ON x.lang = p.lang AND x.letter = a JOIN r y ON y.lang = p.lang AND y.letter = b GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first, second) AS place FROM k)
SELECT lang, first, second, n, CASE WHEN place <= 512 THEN 3 WHEN place <= 1024 THEN 2 ELSE 1 END AS class FROM o""".replace("\\\\p", "\\p"), int_="first second class")
def pair_classes(t):
    pairs = encodings.pair_counts(learned(t).select("lang", F.lower("text").alias("text")), "lang").where("lang IS NOT NULL")
    return encodings.pair_ranks(pairs, encodings.letter_ranks(pairs, "lang"), "lang")


#: Charsets of one byte a character among which the models choose, and those in which the texts are written.
CHARSETS = ("cp1252", "mac_roman", "cp437", "cp1250", "koi8_r")
WRITTEN = ("cp1252", "mac_roman", "cp437", "utf-8")


@query("encoding_models")
def encoding_models(t):
    """Held-out documents, each in one of four encodings: what the models take it for, and whether its text is read back. No SQL: tested by the share that is read back."""
    @F.pandas_udf("binary")
    def written(text: pd.Series, charset: pd.Series) -> pd.Series:
        return pd.Series([x.encode(c, "ignore") for x, c in zip(text, charset, strict=True)], dtype=object)

    docs = t("documents")
    name = F.element_at(F.array(*(F.lit(x) for x in WRITTEN)), (F.floor(F.col("doc_id") / 5) % len(WRITTEN) + 1).cast("int"))
    texts = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("file"), F.coalesce("text", F.lit("")).alias("text"), name.alias("written")).withColumn("content", written("text", "written"))
    found = encodings.EncodingModels(learned(t), CHARSETS).detect(texts.select("file", "content"))
    both = texts.join(found, "file")
    return both.select(F.col("file").alias("doc_id"), "written", "charset", "lang", (encodings.decoded(F.col("content"), F.col("charset")) == encodings.decoded(F.col("content"), F.col("written"))).alias("equal"))

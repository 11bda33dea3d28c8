"""Typed override tags, over lines written from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import overrides
from .registry import query


def _cues(t):
    """Three spans a turn: two flags, then size, colour, place and alignment, then a reset to another size and a second alignment."""
    line = F.format_string(r"{\b%d\i%d\k5}%s{\fs%d\1c&H%X&\pos(%d,%d.5)\an%d}tail\h{\r\fscx%d\an9\fs7x}end", *(F.col(c) for c in ("bold", "slant", "role", "size", "colour", "turn", "turn", "place", "scale")))
    n = F.col("turn").cast("int")
    rows = t("conversations").select(F.col("conv_id").alias("file"), F.col("turn").cast("long").alias("num"), "role", n.alias("turn"), (n % 3).alias("bold"), (n % 2).alias("slant"), (n + 10).alias("size"), (n * 4096 + 255).alias("colour"), (n % 9 + 1).alias("place"), (n + 50).alias("scale"))
    return rows.select("file", "num", (F.col("turn") / 2).cast("int").alias("layer"), line.alias("line"), "role")


_ROWS = """
WITH c AS (SELECT conv_id AS file, turn AS num, role, lag(turn // 2) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
s AS (SELECT *, unnest([0, 1, 2]) AS span FROM c)
SELECT file, CAST(num AS BIGINT) AS num, CAST(span AS INTEGER) AS span, CAST(CASE span WHEN 0 THEN 0 WHEN 1 THEN length(role) ELSE length(role) + 5 END AS INTEGER) AS "offset", CASE span WHEN 0 THEN role WHEN 1 THEN 'tail' || chr(160) ELSE 'end' END AS text,
  CAST(num % 9 + 1 AS INTEGER) AS align, CAST(num AS DOUBLE) AS x, num + 0.5::DOUBLE AS y, before IS NULL OR before <> num // 2 AS resets, 3 AS complexity,
  CASE WHEN span < 2 THEN CAST(num % 3 AS INTEGER) END AS b, CASE WHEN span < 2 THEN num % 2 = 1 END AS i, CASE WHEN span = 1 THEN num + 10.0::DOUBLE END AS fs, CASE WHEN span = 1 THEN CAST(num * 4096 + 255 AS BIGINT) END AS c1, CASE WHEN span = 2 THEN num + 50.0::DOUBLE END AS fscx, CASE WHEN span = 2 THEN '' END AS r
FROM s"""


@query("override_spans", _ROWS, int_="complexity")
def override_spans(t):
    return overrides.override_spans(_cues(t), "b", "i", "fs", "1c", "fscx", "r").drop("wrap")


@query("override_sql", f"SELECT file, num, span, b, i FROM ({_ROWS})")
def override_sql(t):
    """The same function called from SQL, for two tags."""
    cues = _cues(t)
    spark = cues.sparkSession
    overrides.register(spark)
    return spark.sql("SELECT file, num, span, b, i FROM override_spans(TABLE(SELECT * FROM {cues}), 'b,i')", cues=cues)


@query("override_css", f"""
SELECT file, num, span, concat_ws('; ', CASE b WHEN 0 THEN 'font-weight: normal' WHEN 1 THEN 'font-weight: bold' WHEN 2 THEN 'font-weight: bold' END, CASE i WHEN true THEN 'font-style: italic' WHEN false THEN 'font-style: normal' END,
  'font-size: ' || CAST(fs * 0.75 AS DECIMAL(12, 2))::VARCHAR || 'pt',
  'color: #' || lower(substr(printf('%06X', c1), 5, 2) || substr(printf('%06X', c1), 3, 2) || substr(printf('%06X', c1), 1, 2))) AS css FROM ({_ROWS})""")
def override_css(t):
    """Declarations of each span."""
    rows = overrides.override_spans(_cues(t), "b", "i", "fs", "1c")
    return rows.select("file", "num", "span", overrides.span_css(rows.columns).alias("css"))

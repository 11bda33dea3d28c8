"""Where queries and the SQL that says the same are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def millis(column: str) -> Column:
    """Milliseconds since 1970 of a time without zone; the session's zone plays no part."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def query(name: str, sql: str | None = None, long: str = "", int_: str = ""):
    """Register a function of (tables) as a query; ``tables`` reads a driver table by name.

    ``long`` and ``int_`` name columns whose SQL type is to be BIGINT or INTEGER, where constants would make it another.
    """
    casts = [f'CAST("{c}" AS {kind}) AS "{c}"' for names, kind in ((long, "BIGINT"), (int_, "INTEGER")) for c in names.split()]
    if casts:
        sql = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})"

    def add(f: Callable) -> Callable:
        def run(spark, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add

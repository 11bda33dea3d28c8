"""Dimension look-ups with an explicit rule for which of several rows matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match(rows: DataFrame, dim: DataFrame, keys: list[str], value: str, order: str, last: bool = False, default: Column | None = None, how: str = "left") -> DataFrame:
    """rows with ``value`` of the first (or last) row of dim by ``order`` that has the same keys; ``default`` where none has."""
    pick = (F.max_by if last else F.min_by)(F.struct(value), order)
    one = dim.groupBy(*keys).agg(pick.alias("_one")).select(*keys, F.col(f"_one.{value}").alias(value))
    out = rows.drop(value).join(one, keys, how)
    return out if default is None else out.withColumn(value, F.coalesce(value, default))


def prefix_pairs(movies: DataFrame, files: DataFrame, suffixes: list[str], block: str, strict: bool = False) -> DataFrame:
    """block, base, name: files whose name begins with a movie's base name, letters in either case, within one directory (block); ``strict``: and goes on with a period.

    The beginnings of a file's name that are as long as some base name of its directory meet the
    base names by equality, so only names that match are paired.
    """
    movies = movies.select(block, "base", F.lower("base").alias("_base"))
    names = files.select(block, "name", F.lower("name").alias("_name")).where(F.substring_index("_name", ".", -1).isin(suffixes))
    lengths = movies.where("base IS NOT NULL").groupBy(block).agg(F.collect_set(F.length("_base")).alias("_lengths"))  # no more than names have characters
    cut = names.join(lengths, block).withColumn("_n", F.explode("_lengths")).where(F.col("_n") + (1 if strict else 0) <= F.length("_name"))
    if strict:
        cut = cut.where(F.col("_name").substr(F.col("_n") + 1, F.lit(1)) == ".")
    begun = cut.select(block, "name", F.col("_name").substr(F.lit(1), F.col("_n")).alias("_base"))
    return movies.join(begun, [block, "_base"]).select(block, "base", "name")


def cascade(*values: Column) -> Column:
    """The first value that is neither null nor 0."""
    return F.coalesce(*(F.nullif(v, F.lit(0)) for v in values))


def font_names(rows: DataFrame, fonts: DataFrame, default: str) -> DataFrame:
    """rows (name, ...) with font: of fonts (ord, family, platform) the first whose family is the name, else whose platform name is, else whose family is it in any case, else the default."""
    every = fonts.select("ord", "family", "platform", F.lower("family").alias("lower"))
    out = rows.withColumn("_any", F.lower("name"))
    for key, column in (("family", "name"), ("platform", "name"), ("lower", "_any")):
        dim = every.select(F.col(key).alias(column), "ord", F.col("family").alias(f"_{key}"))
        out = match(out, dim, [column], f"_{key}", "ord")
    return out.withColumn("font", F.coalesce("_family", "_platform", "_lower", F.lit(default))).drop("_family", "_platform", "_lower", "_any")


def once(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")

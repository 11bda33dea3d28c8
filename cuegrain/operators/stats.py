"""Aggregations: frame statistics, histograms and the confidences of text probers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import encodings


def drop_stats(rows: DataFrame) -> DataFrame:
    """kind, begun, decoded, dropped, dropped_pct of rows (kind, stage); 0 percent where nothing was begun."""
    n = lambda s: F.count_if(F.col("stage") == s)
    df = rows.groupBy("kind").agg(n("begin").alias("begun"), n("decode").alias("decoded"))
    return df.select("kind", "begun", "decoded", (F.col("begun") - F.col("decoded")).alias("dropped"), F.coalesce(F.round(F.try_divide((F.col("begun") - F.col("decoded")) * 100.0, F.col("begun")), 4), F.lit(0.0)).alias("dropped_pct"))


def running_lag(rows: DataFrame) -> DataFrame:
    """stream, seq, behind, worst: begun less ended so far, and the largest distance so far."""
    w = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    df = rows.withColumn("behind", F.sum(F.when(F.col("stage") == "begin", 1).when(F.col("stage") == "end", -1).otherwise(0)).over(w))
    return df.select("stream", "seq", "behind", F.max(F.abs("behind")).over(w).alias("worst"))


def characters(docs: DataFrame, *keep: str) -> DataFrame:
    """One row for each character (place i, character c) of text."""
    return docs.select(*keep, F.posexplode(F.split("text", "")).alias("i", "c")).where("c <> ''")


def histogram(docs: DataFrame, by: str) -> DataFrame:
    return characters(docs, by).groupBy(by, "c").agg(F.count(F.lit(1)).alias("n"))


def bigrams(docs: DataFrame, by: str, key: str) -> DataFrame:
    """by, c, d, n: neighbouring characters; tasks count those of their texts before the shuffle."""
    pairs = encodings.pair_counts(docs, by).where("b IS NOT NULL")
    return pairs.select(by, encodings.character(F.col("a")).alias("c"), encodings.character(F.col("b")).alias("d"), "n")


def histogram_difference(counts: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """c, delta: (root of the second share - root of the first) in 16.16 fixed point, rounded half up, then cut toward zero.

    ``counts`` has c and n for each value of ``key``; both histograms and their totals come from one grouping.
    """
    own = lambda v: F.sum(F.when(F.col(key) == v, F.col("n")).otherwise(0))
    both = counts.where(F.col(key).isin(first, second)).groupBy("c").agg(own(first).alias("x"), own(second).alias("y"))
    whole = {v: both.agg(F.sum(v)).scalar() for v in ("x", "y")}
    root = lambda v: F.sqrt(F.col(v) / F.greatest(whole[v], F.lit(1)).cast("double"))
    return both.select("c", ((root("y") - root("x")) * 65536 + 0.5).cast("int").alias("delta"))


def utf8_confidence(n: Column) -> Column:
    """From the number of characters of several bytes."""
    return F.when(n < 6, 1 - 0.99 * F.pow(F.lit(0.5), n)).otherwise(0.99)


def sequence_confidence(positive: Column, total: Column, frequent: Column, characters_: Column, ratio: float) -> Column:
    """Bigram confidence: share of likely pairs over the expected share, times the share of frequent letters; 0.99 at most, 0.01 without pairs."""
    r = F.try_divide(positive, total) / ratio * F.try_divide(frequent, characters_)
    return F.when(total > 0, F.least(r, F.lit(0.99))).otherwise(0.01)


def distribution_confidence(frequent: Column, total: Column, ratio: float) -> Column:
    r = F.try_divide(frequent, (total - frequent) * ratio)
    return F.when((total <= 0) | (frequent <= 0), 0.01).when(total == frequent, 0.99).otherwise(F.least(r, F.lit(0.99)))


def pair_class_confidence(illegal: Column, likely: Column, unlikely: Column, total: Column) -> Column:
    """Confidence of a one-byte Latin text from its pairs: (likely - 20 * unlikely) / total, from 0, halved; 0.01 after an illegal pair."""
    return F.when(illegal, 0.01).when(total == 0, 0.0).otherwise(F.greatest(F.try_divide(likely - unlikely * 20, total), F.lit(0.0)) * 0.5)


def best(rows: DataFrame, key: str, floor: float | None = None) -> DataFrame:
    """key, name, conf: the highest confidence; the earlier prober (ord) among equals; none at or below ``floor``."""
    out = rows.groupBy(key).agg(F.max_by(F.struct("name", "conf"), F.struct("conf", -F.col("ord"))).alias("b")).select(key, "b.name", "b.conf")
    return out if floor is None else out.where(F.col("conf") > floor)


def pair_categories(text: Column, orders: dict[str, int], matrix: list[int], frequent: int, n: int = 4) -> Column:
    """How often each of n categories occurs among a text's pairs of neighbouring letters.

    ``orders`` numbers letters by frequency; pairs of two letters numbered below ``frequent`` have the
    category that ``matrix`` (frequent by frequent) gives, all others don't count.
    """
    known = F.create_map(*(F.lit(x) for pair in orders.items() for x in pair))
    numbers = F.transform(F.split(text, ""), lambda c: F.coalesce(known[c], F.lit(frequent)))
    pairs = F.zip_with(numbers, F.slice(numbers, 2, F.greatest(F.length(text), F.lit(1))), lambda a, b: F.when((a < frequent) & (b < frequent), a * frequent + b))
    cells = F.filter(pairs, lambda p: p.isNotNull())
    table = F.array(*map(F.lit, matrix))
    found = F.transform(cells, lambda p: F.get(table, p))

    def of(k: int) -> Column:
        return F.size(F.filter(found, lambda x: x == k)).cast("long")

    return F.array(*map(of, range(n)))


def pair_share(counts: Column, least: int = 5) -> Column:
    """Share of pairs beyond category 0; -1 below ``least`` pairs."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(total >= least, (total - F.get(counts, 0)) / total).otherwise(-1.0)


def two_byte_order(charset: str, first: Column, second: Column) -> Column:
    """Place of a two-byte character in the frequency tables of its encoding; -1 outside their range."""
    rows = lambda base: (first - base) * 94 + second - 0xA1
    if charset == "EUC-JP":
        return F.when((first >= 0xA1) & (second >= 0xA1), rows(0xA1)).otherwise(-1)
    if charset in ("EUC-KR", "GB2312"):
        return F.when((first >= 0xB0) & (second >= 0xA1), rows(0xB0)).otherwise(-1)
    if charset == "EUC-TW":
        return F.when((first >= 0xC4) & (second >= 0xA1), rows(0xC4)).otherwise(-1)
    if charset == "Big5":
        return F.when(first < 0xA4, -1).when(second >= 0xA1, 157 * (first - 0xA4) + second - 0xA1 + 63).otherwise(157 * (first - 0xA4) + second - 0x40)
    if charset == "Shift_JIS":
        row = F.when(first.between(0x81, 0x9F), first - 0x81).when(first.between(0xE0, 0xEF), first - 0xE0 + 31)
        return F.when(row.isNull() | (second > 0x7F), -1).otherwise(188 * row + second - 0x40)
    raise ValueError(charset)


#: Hebrew letters with a form of their own at the end of a word (kaf, mem, nun, pe, tsadi), and the plain forms that don't end words.
HEBREW_FINAL, HEBREW_PLAIN = "ךםןףץ", "כמנפ"


def hebrew_scores(text: Column) -> tuple[Column, Column]:
    """(signs of logical order, signs of visual order) in a text whose words are parted by blanks.

    A word of two letters or more that ends with a final form is written in logical order; one that
    ends with the plain form, or begins with a final one, in visual order. The end of the text ends no word.
    """
    text = F.concat(F.lit("  "), text)
    logical = F.regexp_count(text, F.lit(f"(?<=[^ ])[{HEBREW_FINAL}](?= )"))
    visual = F.regexp_count(text, F.lit(f"(?<=[^ ])[{HEBREW_PLAIN}](?= )|(?<= )[{HEBREW_FINAL}](?=[^ ])"))
    return logical, visual


def hebrew_order(logical: Column, visual: Column, model_logical: Column, model_visual: Column, distance: int = 5, least: float = 0.01) -> Column:
    """The charset of a Hebrew text: by its final letters if they are clear, else by the confidences of the models of both orders, else by the letters again; logical if nothing tells."""
    letters, models = logical - visual, model_logical - model_visual
    return F.when(letters >= distance, "windows-1255").when(letters <= -distance, "ISO-8859-8").when(models > least, "windows-1255").when(models < -least, "ISO-8859-8").when(letters < 0, "ISO-8859-8").otherwise("windows-1255")

"""Pipeline from raw documents to token identifiers: each stage works on all that the one before kept.

Decisions are joined back to the rows by doc_id (and a hash of the text where rows repeat one);
rows whose doc_id is null are judged like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrain.llm import exact_dedup, mixing, quality_cnn, sentencepiece_fst, simhash
from cuegrain.llm.common import Scratch

#: Share of tokens that mixing keeps at most; it keeps less where the targets ask for it.
KEEP = 0.9


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others in one, so that columns an operator adds meet none of the input's."""
    return docs.select(*names, F.struct(F.lit(0), *(F.col(f"`{c}`") for c in docs.columns if c not in names)).alias("_rest"))


def _unpacked(out: DataFrame, docs: DataFrame, *names: str) -> DataFrame:
    return out.select(*(F.col(c if c in names else f"_rest.`{c}`").alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network rejects go."""
    out = quality_cnn.classify(_packed(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(out.where("predicted = 1"), docs, "doc_id", "text")


def _stay(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, text_sha256) is in kept, one of each."""
    marked = docs.withColumn("_sha", exact_dedup.sha256(exact_dedup.normalised(F.col("text")))).withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    kept = kept.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    return marked.join(kept.hint("shuffle_hash"), ["_id", "_sha"], "left_semi").dropDuplicates(["_id", "_sha"]).select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return _stay(docs, exact_dedup.exact_dedup(docs).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays; of those that share it, the one with the smallest hash of its text."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    groups = simhash.simhash_near_dedup(docs.select(row.alias("doc_id"), "text"))
    kept = groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    kept = kept.select(F.coalesce(F.col("doc_id.id").cast("string"), F.lit("")).alias("_id"), F.col("doc_id.hash").alias("_hash"), "_n")
    out = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_hash": F.xxhash64("text")}).join(kept.hint("shuffle_hash"), ["_id", "_hash"])
    once = out.where("_n > 1").dropDuplicates(["_id", "_hash"])
    return out.where("_n = 1").unionByName(once).select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target weights."""
    names = ("doc_id", "text", "source", "lang")
    return _unpacked(mixing.mix(mixing.with_topics(_packed(docs, *names)), keep=KEEP, exact=True).where("kept"), docs, *names)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, round_trip of each document that is left."""
    out = sentencepiece_fst.transduce(docs.select("doc_id", "lang", "source", "text"), decode=True)
    return out.select("doc_id", "lang", "source", F.coalesce(F.size("ids").cast("long"), F.lit(0)).alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixing_sources),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: The classifier and the transducers are beyond SQL; tests/llm holds each stage against the decisions of its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name.split()[0])
        if hasattr(before, "_cuegrain_path"):
            scratch.drop(before)
    return docs

"""The corpus pipeline: each stage works on what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import bpe, mixing, quality_crf, repeats, simhash
from loomspan.llm.common import dimension_join, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts good."""
    return quality_crf.classify(docs.select(COLUMNS), table(spark, sf_dir, "labels")).filter("predicted = 1").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies: texts that share 0.8 or more of their five-word shingles.

    Rows that share a doc_id with another text are judged on their own text; of rows that repeat a doc_id and the words of a text, one
    stays. A null doc_id is never a copy's, so such rows stay.
    """
    docs = docs.select(COLUMNS)
    roots = staged(simhash.near_copies(docs).select(F.col("key").alias("_copy"), "root"), "roots")
    keyed = simhash.with_words_key(docs)
    ids = keyed.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).agg(F.count("*").alias("n"))
    ids = staged(ids, "ids")
    # texts of equal words are a group even if no other text is like them
    group = F.coalesce(F.col("root").cast("string").cast("binary"), F.col("_k"))
    groups = staged(dimension_join(ids, roots, F.col("_k") == F.col("_copy")).select("_id", "_k", group.alias("root")), "groups")
    first = groups.groupBy("root").agg(F.min(F.struct("_id", "_k")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("root", "first")
    first = staged(first.withColumnRenamed("root", "_root"), "firsts")
    drop = dimension_join(groups, first, F.col("root") == F.col("_root"), "inner").filter(F.struct("_id", "_k") != F.col("first"))
    drop = staged(drop.select("_id", "_k"), "dropped")
    same = (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_k"))
    kept = dimension_join(keyed, drop, same, "left_anti")
    again = staged(ids.filter("n > 1").select("_id", "_k"), "again")
    if not again.isEmpty():
        once = kept.join(again, same).groupBy("doc_id", "_key").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
        kept = kept.join(again, same, "left_anti").select(COLUMNS).unionByName(once.select(COLUMNS))
    return kept.select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat elsewhere; one that is repeated as a whole goes."""
    left = repeats.remove_repeats(docs, keep_text=True, carry=["lang", "source"])
    return left.filter("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; each row is a unit of its own."""
    return mixing.mixed(docs.select(COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digests."""
    return bpe.bpe(docs, keep_ids=True)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_duplicates", near_duplicates),
    ("suffix_array_repeats", repeated_passages),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Hashes of shingles, a trained field, random rounding: SQL can't express the stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs

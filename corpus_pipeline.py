"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``. Between stages the rows are written as Parquet
to the shared checkpoint folder and read again, so a lost executor never costs more than the
stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkfield.llm import decontaminate, ngram_join, packing, passages, quality
from sparkfield.llm.common import durable, keyed, packed, split_by_keys, stored, table, unpacked


def _without(base: DataFrame, columns: list[str], keys: DataFrame, name: str) -> DataFrame:
    """Rows of ``base(key, text, rest)`` whose key is not among the keys; most of them are not shuffled."""
    maybe, sure = split_by_keys(base, "key", keys, name)
    return unpacked(sure.unionByName(maybe.join(keys, F.col("key") == F.col(name), "left_anti")), columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored as empty ones, very long ones whole; repeated rows share
    their fate; an empty table gives no rows; further columns are kept, whatever their names.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or near-equal documents the one with the smallest doc_id.

    Null ids come first, and of rows with equal ids or texts one stays. Null texts are in no
    group and stay; empty texts are one group. An empty table gives no rows; further columns
    are kept, whatever their names.
    """
    base = keyed(packed(docs), ["text", "rest"])
    found = ngram_join.classes(base.select(F.col("key").alias("doc_id"), "text"), count_links=False)
    gone = durable(found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")))
    return _without(base, docs.columns, gone, "gone")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that near-repeat an earlier one; see ``remove_passages`` for the edge cases."""
    return passages.remove_passages(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item.

    Null and word-free texts stay; repeated rows share their fate; an empty table or an empty
    benchmark drops nothing; further columns are kept, whatever their names.
    """
    base = keyed(packed(docs), ["text", "rest"])
    found = decontaminate.hits(base.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(base, docs.columns, durable(found.select(F.col("doc_id").alias("hit")).distinct()), "hit")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; see ``packing.pack`` for the edge cases."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: A learnt score and a tokenizer are not expressible in SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from ``documents``: toxic texts go, then exact and near copies, then repeated passages; the rest is
packed into windows. Every stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulmark.llm.common import keep
from haulmark.llm.exact_dedup import keep_one
from haulmark.llm.jaccard_join import keep_leaders
from haulmark.llm.packing import pack
from haulmark.llm.suffix_dedup import without_repeats
from haulmark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space."""
    return keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that is linked by five-word shingles at a similarity of 0.8, the row with the smallest id."""
    return keep_leaders(docs, words=5, num=80, den=100)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, less the bytes of strings that a document with a smaller id has too; texts may end up empty."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("suffix-array dedup", passages),
    ("packing", packing),
]

# The classifier and Karmarkar-Karp windows have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

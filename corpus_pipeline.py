"""Clean a corpus and pack it: toxic documents go, then those that fail the quality rules, then all but one of each group of
near-duplicates; what stays is tokenized and packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written to the shared folder and read
again as the next one's docs. All but the last return the columns of documents. Null texts are empty: they fail the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import jaccard_join, packing, quality, toxicity
from wayfare.llm.common import settled, table, vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.kept_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_poor), ("n-gram Jaccard join", drop_near_duplicates), ("packing", pack)]

#: Scores and packings can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: quality rules, exact dedup, near duplicates, mixing, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from kelpline.llm.common import stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far out in their language and source go. A null text fails; a null language
    or source is a name of its own; repeated rows are each judged."""
    return quality_rules.filter_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the most code points stays, then the one with the smallest id (a null id comes last); of
    repeated rows one."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays. A row with a null id stays: it can't
    be told from another; texts without words link to nothing."""
    return ngram_join.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, by the weights of domains, languages and sources (those of op8): what an over-weighted
    leaf gives twice stands in two rows, and what is left of an under-weighted one goes. Rows with one id are selected
    together."""
    mixed = mixing.mix(docs).filter("mix_epochs > 0")
    return mixed.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("mix_epochs")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, each a sequence; a row that stands twice has its pieces twice, in sequences of their own. A null
    text is a final id alone."""
    return packing.digest(packing.pack(docs, packing.default_tokenizer()))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mix), ("packing", pack)]

#: SQL can't tokenize; the operators of the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stash(docs) if at < len(STAGES) - 1 else docs
    return docs

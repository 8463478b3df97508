"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next.

1. toxicity: documents scored 0.5 or more go. A document is its id: where rows repeat an id, all of them go if one is rejected.
2. near_duplicates: of each component of linked documents the one with the smallest id stays (shingles of five words, threshold
   0.8; the three words and 0.9 of the operator's own query do not hold here). Documents with a null id stay, and so do repeated rows of one id.
3. secrets: spans found are replaced by a mark.
4. mixing: each document is repeated as often as the mix takes it, and goes where it takes none of it.
5. packing: the pieces of every row that is left, with their sequences.

Every stage but the last returns the columns of ``documents``, extra ones included. Empty tables pass through as empty tables.
Null and empty texts are scored, kept and packed like others; very long texts are processed whole; ties are settled as each
operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import jaccard, mixing, packing, secrets, toxicity
from ledgerline.llm.common import saved

#: Documents up to which their ids may be broadcast; beyond it the join shuffles.
SMALL_ROWS = 1_000_000
#: Words of a shingle and least similarity, in hundredths, of near-duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the ids in ``gone``; null ids stay."""
    gone = saved(gone.select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= SMALL_ROWS else gone
    return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g._gone"), "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 1"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, jaccard.join(docs, width=NEAR_WORDS, percent=NEAR_PERCENT).filter("doc_id <> component_id"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Fitted trees and library tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

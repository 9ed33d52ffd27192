"""A training corpus from raw documents: toxic documents go, one of each group of near copies stays, documents that contain
benchmark items go, secrets are masked, and what is left is packed into sequences.

Cases: rows without a doc_id take part in every stage but near-duplicate removal, where they stay; rows that share a doc_id
are told apart throughout; null and empty texts are near copies of each other, so one of them stays; columns of any other
name pass through up to packing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, packing, secrets, simhash_dedup, toxicity
from lodestone.llm.queries import table, tokenizer_path
from lodestone.llm.spaces import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones, takes for toxic go."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, and one row of it."""
    return simhash_dedup.without_near_copies(docs, k=4, radius=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text become a mark."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), capacity=4096, end=1)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("decontamination", drop_contaminated), ("secrets", mask_secrets), ("packing", pack)]

#: Tokenizing, fitted classifiers and string tiling are beyond SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = written(docs)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

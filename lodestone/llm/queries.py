"""The registered queries of the llm operators: each over its whole table, with the parameters meant for production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, language_id, nearest, oracles, packing, quality, secrets, toxicity
from .sampling import bucket
from .simhash_dedup import near_duplicates
from .substring_dedup import repeated_passages


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file, installed with the Python of driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, radius=4)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), window=13).drop("spans")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a fifth of the documents are left out of the fit; held_out marks them."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = toxicity.train(docs, labels.filter(bucket("doc_id", 5) != 0))
    return toxicity.toxicity(docs, chain).withColumn("held_out", F.coalesce(bucket("doc_id", 5) == 0, F.lit(False)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end=1)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(bucket("doc_id", 4) != 2))
    held = F.coalesce(bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return language_id.languages(docs, model).select("doc_id", held, "lang_pred", "score")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.train(docs, table(spark, sf_dir, "labels").filter(bucket("doc_id", 3) != 1))
    held = F.coalesce(bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return quality.quality(docs, net).select("doc_id", held, "score", "predicted")


def queries():
    each = (op1_decontamination, op2_simhash, op3_substring_dedup, op4_toxicity, op5_packing, op6_language, op7_html, op8_secrets, op9_nearest, op10_quality)
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()

"""Bounded samples of labelled documents, for classifiers that are fitted on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WHOLE = 1 << 30


def bucket(key: str, n: int) -> Column:
    """crc32 of a key as text modulo n; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def draw(docs: DataFrame, labels: DataFrame, column: str, size: int) -> pa.Table:
    """text and the label's columns of about `size` documents of each value of `column` (all, of rarer values), never more
    than `size`. labels: doc_id and columns, with null values of `column` left out. Which rows come is a matter of their
    doc_id's hash alone. Only the values' counts and the sample itself reach the driver.

    Cases: of several labels of one doc_id the least goes in, and of several documents the first text by order, so that the
    sample is bounded and the same however often an id comes; null texts count as empty.
    """
    spark = docs.sparkSession
    given = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    mark = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(_WHOLE))
    counts = {r[0]: r[1] for r in given.groupBy(column).count().collect()}
    if not counts:
        return pa.table({"text": pa.array([], pa.string()), **{c: pa.array([], pa.null()) for c in labels.columns if c != "doc_id"}})
    rates = spark.createDataFrame([(v, min(_WHOLE, int(1.15 * size / n * _WHOLE) + 1)) for v, n in counts.items()], f"`{column}` {dict(labels.dtypes)[column]}, rate long")
    ids = given.join(F.broadcast(rates), column).filter(mark < F.col("rate")).drop("rate")
    others = [c for c in labels.columns if c != "doc_id"]
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*others).alias("y")).groupBy("doc_id").agg(F.min("y").alias("y")).select("doc_id", "y.*")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # ids has about 1.15 x size rows for each value of the label, whatever the input's size.
    got = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", *others).agg(F.min("text").alias("text")).withColumn("mark", mark).toArrow().sort_by([("mark", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    taken: dict = {}
    seen, keep = set(), []
    for i, (doc, value) in enumerate(zip(got.column("doc_id").to_pylist(), got.column(column).to_pylist(), strict=True)):
        taken[value] = taken.get(value, 0) + (doc not in seen)
        if doc not in seen and taken[value] <= size:
            keep.append(i)
        seen.add(doc)
    return got.take(pa.array(keep, pa.int64())).drop_columns(["mark", "doc_id"])

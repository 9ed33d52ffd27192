"""Cosine ranking against stored vectors, and the upkeep of a vector store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def usable(v: Column, dim: Column) -> Column:
    """Finite, not zero, and of this length."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine(rows: DataFrame, key: str, vector: str, query: Sequence[float], floor: float | None = 0.0) -> DataFrame:
    """key and score of usable vectors, above the floor. The query is a constant of the plan: no join, no shuffle."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    v = F.col(vector)
    out = rows.filter(usable(v, F.lit(len(query)))).select(key, (dot(v, q) / (F.sqrt(dot(v, v)) * norm)).alias("score"))
    return out if floor is None else out.filter(F.col("score") > floor)


def latest(rows: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(tie).desc())
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def prune(store: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows of the store whose key is still there."""
    return store.join(present.select(key).distinct(), key, "left_semi")


def dominant_dimension(rows: DataFrame, vector: str) -> DataFrame:
    """dim: the most frequent length (the larger of equals)."""
    return rows.groupBy(F.size(vector).alias("dim")).count().agg(F.max_by("dim", F.struct("count", "dim")).alias("dim"))

"""Counts over a whole store of chunks or texts, and what changed between two of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def grep(rows: DataFrame, by: str, text: str, patterns: Sequence[str], tokens: Column, limit: int = 15) -> DataFrame:
    """by, hits and tokens of the groups whose texts hold a pattern, whatever the case, the most hits first."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = reduce(lambda a, b: a + b, [T.occurrences(low, p.lower()) for p in patterns if p], F.lit(0).cast("long"))
    found = rows.select(by, hits.alias("hits"), tokens.alias("tokens")).filter("hits > 0")
    return found.groupBy(by).agg(F.sum("hits").alias("hits"), F.sum("tokens").alias("tokens")).orderBy(F.col("hits").desc(), by).limit(limit)


def hot(rows: DataFrame, key: str, text: str, limit: int = 10) -> DataFrame:
    """key and score of the longest and most branched texts: half a point a line and two a branch."""
    m = rows.select(key, T.line_metrics(F.col(text)).alias("m"))
    scored = m.select(key, (0.5 * F.col("m.total_lines") + 2 * F.col("m.complexity")).cast("double").alias("score"))
    return scored.orderBy(F.col("score").desc(), key).limit(limit)


def line_summary(rows: DataFrame, by: str, text: str) -> DataFrame:
    """by, files, lines and the mean lines of a file."""
    each = rows.select(by, T.line_metrics(F.col(text)).getField("total_lines").alias("n"))
    return each.groupBy(by).agg(F.count("*").alias("files"), F.sum("n").alias("lines"), F.avg("n").alias("avg_lines"))


def counts(rows: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    """by and n, the most frequent first."""
    out = rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), by)
    return out if limit is None else out.limit(limit)


def index_stats(rows: DataFrame, file: str, tokens: Column) -> DataFrame:
    """One row: chunks, files and tokens."""
    return rows.agg(F.count("*").alias("chunks"), F.countDistinct(file).alias("files"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))


def structure_change(old: DataFrame, new: DataFrame, by: str, size: str) -> DataFrame:
    """by, and by how much its files and their sizes grew from old to new."""
    a, b = (x.groupBy(by).agg(F.count("*").alias(f"n{i}"), F.sum(size).alias(f"c{i}")) for i, x in enumerate((old, new)))
    grown = lambda x: F.coalesce(F.col(f"{x}1"), F.lit(0)) - F.coalesce(F.col(f"{x}0"), F.lit(0))
    return a.join(b, by, "full_outer").select(by, grown("n").alias("files"), grown("c").alias("size"))

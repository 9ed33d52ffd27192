"""Filling token budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_fill(rows: DataFrame, by: str, order: list[Column], key: str, tokens: str, budget: str | int, carry: Sequence[str] = ()) -> DataFrame:
    """by, key, tokens, used: in order, each row that still fits is taken and others are passed over. budget: tokens, or the
    name of a column that has them, alike in a group; carry: further columns of the rows that are taken.

    What a row does depends on all before it, so a group is folded in one row; groups are the limited results of one query.
    """
    item = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("key"), F.col(tokens).cast("long").alias("tokens"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    kinds = dict(rows.dtypes)
    more = "".join(f",c{i}:{kinds[c]}" for i, c in enumerate(carry))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr(f"cast(array() as array<struct<key:{kinds[key]},tokens:long,used:long{more}>>)").alias("taken"))
    limit = F.lit(budget) if isinstance(budget, int) else F.col("limit")

    def step(s: Column, x: Column) -> Column:
        used = s["used"] + x["tokens"]
        more = F.array(F.struct(x["key"].alias("key"), x["tokens"].alias("tokens"), used.alias("used"), *[x[f"c{i}"].alias(f"c{i}") for i in range(len(carry))]))
        return F.when(used <= limit, F.struct(used.alias("used"), F.concat(s["taken"], more).alias("taken"))).otherwise(s)

    most = [] if isinstance(budget, int) else [F.first(budget).alias("limit")]
    got = rows.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"), *most).select(by, F.explode(F.aggregate("items", start, step, lambda s: s["taken"])).alias("x"))
    return got.select(by, F.col("x.key").alias(key), F.col("x.tokens").alias("tokens"), F.col("x.used").alias("used"), *[F.col(f"x.c{i}").alias(c) for i, c in enumerate(carry)])


def prefix_fill(rows: DataFrame, by: str, order: list[Column], tokens: str, budget: int) -> DataFrame:
    """In order, rows up to the first that doesn't fit, with used."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(F.col(tokens).cast("long")).over(w)).filter(F.col("used") <= budget)


#: Shares of code, imports, summaries and overview in a budget, by the kind of query.
SPLITS = {"identifier": (0.80, 0.15, 0.05, 0.0), "error": (0.70, 0.15, 0.15, 0.0), "concept": (0.60, 0.15, 0.15, 0.10)}


def budget_split(kind: Column, budget: Column, imports: Column) -> Column:
    """A struct of code, imports, summaries and overview, cut to whole tokens; without imports their share goes to code."""
    def part(i: int) -> Column:
        share = F.when(kind == "identifier", SPLITS["identifier"][i]).when(kind == "error", SPLITS["error"][i]).otherwise(SPLITS["concept"][i])
        return F.floor(F.round(budget * share, 6)).cast("long")

    code, imp, summ, over = (part(i) for i in range(4))
    return F.struct(F.when(imports, code).otherwise(code + imp).alias("code"), F.when(imports, imp).otherwise(F.lit(0).cast("long")).alias("imports"), summ.alias("summaries"), over.alias("overview"))


def by_file(rows: DataFrame, path: str, position: str, start: str) -> DataFrame:
    """rows with place: files in the order in which they first come, and by start within."""
    first = F.min(position).over(Window.partitionBy(path))
    # rows is one query's packed result.
    return rows.withColumn("first", first).withColumn("place", F.row_number().over(Window.orderBy("first", path, start))).drop("first")

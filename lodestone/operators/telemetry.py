"""Roll-ups of usage events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile(value: Column, p: float) -> Column:
    """Linear interpolation, half to even, as a whole number."""
    return F.bround(F.percentile(value, F.lit(p)), 0).cast("long")


def element_at_share(rows: DataFrame, by: str, value: str, p: float, name: str) -> DataFrame:
    """For each group the element at floor(p * (n - 1)) of its sorted values. Equal values are counted before they meet, and
    the order within a group may spill."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = counts.groupBy(by).agg(F.sum("n").alias("all"))
    run = counts.withColumn("upto", F.sum("n").over(upto)).join(total, by)
    return run.filter(F.col("upto") > F.floor(p * (F.col("all") - 1))).groupBy(by).agg(F.min(value).alias(name))


def summary(events: DataFrame, kind: str, value: str, budget: float) -> DataFrame:
    """For each kind: n, the mean cut to a whole number, and the share of the budget used, in per cent to one place."""
    return events.groupBy(kind).agg(F.count("*").alias("n"), F.floor(F.avg(value)).cast("long").alias("avg_value"), F.round(F.sum(value) * 100 / (F.count("*") * budget), 1).alias("utilization"))


def kpis(events: DataFrame, kind: str, value: str, good: Column) -> DataFrame:
    return events.groupBy(kind).agg(F.count("*").alias("n"), percentile(F.col(value), 0.5).alias("p50"), percentile(F.col(value), 0.95).alias("p95"), F.bround(F.avg(value), 0).cast("long").alias("avg_value"), F.round(F.count_if(good) * 100 / F.count("*"), 1).alias("good_rate"))


def daily(events: DataFrame, at: str, value: str) -> DataFrame:
    return events.groupBy(F.to_date(at).alias("day")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def burn_rate(events: DataFrame, at: str, value: str, price: float = 15.0) -> DataFrame:
    """One row: active days, the mean of an active day, its projection to 7 and 30 days, and the price of the latter."""
    each = daily(events, at, value)
    mean = F.avg("total")
    return each.agg(F.count("*").alias("active_days"), mean.alias("daily"), (mean * 7).alias("weekly"), (mean * 30).alias("monthly"), (mean * 30 / 1_000_000 * price).alias("monthly_cost"))


def hit_at(ranked: DataFrame, by: str, rank: str, good: Column, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """One row: the share of queries with a good result at rank k or better."""
    best = ranked.groupBy(by).agg(F.min(F.when(good, F.col(rank))).alias("best"))
    return best.agg(F.count("*").alias("queries"), *[F.avg((F.coalesce(F.col("best"), F.lit(10**9)) <= k).cast("double")).alias(f"hit_{k}") for k in ks])


def project_breakdown(events: DataFrame, project: str, tokens: str) -> DataFrame:
    """project, tokens and queries."""
    return events.groupBy(F.col(project).alias("project")).agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.count("*").alias("queries"))


def savings(runs: DataFrame, by: str, first: str, second: str) -> DataFrame:
    """For each group the sums of two measures, the share by which the second is smaller (per cent, to one place) and their
    ratio (to three); null where the first sums to nothing."""
    sums = runs.groupBy(by).agg(F.sum(first).alias("first"), F.sum(second).alias("second"))
    some = F.when(F.col("first") != 0, F.col("first"))
    return sums.select(by, "first", "second", F.round((1 - F.col("second") / some) * 100, 1).alias("saved_pct"), F.round(F.col("second") / some, 3).alias("ratio"))


def rates(runs: DataFrame, by: str, **tests: Column) -> DataFrame:
    """For each group n and the share of its rows that pass each test, to four places."""
    return runs.groupBy(by).agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(t, F.lit(False)).cast("double")), 4).alias(k) for k, t in tests.items()])


def usage_estimate(rows: DataFrame, by: str, *texts: Column) -> DataFrame:
    """by and tokens: what the joined texts of a group's rows would take."""
    from ..functions.text import token_count

    return rows.groupBy(by).agg(F.sum(token_count(F.concat_ws("\n", *texts))).alias("tokens"))

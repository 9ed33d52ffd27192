"""Fusion of ranked lanes and what modifies scores afterwards."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60


def reciprocal_rank_fusion(lanes: Mapping[str, tuple[DataFrame, float]], key: str, k: int = K) -> DataFrame:
    """key and score: the sum over lanes of weight / (k + rank). A lane is key and score with its weight; ranks count
    different keys, by the best score to nine places, then the key.

    Lanes are bounded by their limits before they come here, so that a window over a whole lane is small.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    parts = []
    for name, (lane, weight) in lanes.items():
        best = lane.groupBy(key).agg(F.max("score").alias("score"))
        parts.append(best.select(F.lit(name).alias("lane"), key, "score", F.lit(float(weight)).alias("weight")))
    both = reduce(DataFrame.unionByName, parts)
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("lane").orderBy(F.round("score", 9).desc(), key)))
    return ranked.groupBy(key).agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"))


def relevance_floor(scored: DataFrame, share: float = 0.3) -> DataFrame:
    """Rows with at least this share of the top score; all of them if that isn't positive."""
    best = scored.agg(F.max("score").alias("__best"))
    return scored.crossJoin(F.broadcast(best)).filter((F.col("__best") <= 0) | (F.col("score") >= share * F.col("__best"))).drop("__best")


def importance_boost(score: Column, importance: Column) -> Column:
    return score * (1 + 0.5 * F.coalesce(importance, F.lit(0.0)))


def recency_boost(score: Column, age_days: Column) -> Column:
    return score * (1 + 0.2 * F.coalesce(F.greatest(F.lit(0.0), 1 - age_days / 30.0), F.lit(0.0)))


def path_boost(score: Column, path: Column, terms: list[str]) -> Column:
    hit = reduce(lambda a, b: a | b, [F.lower(path).contains(t.lower()) for t in terms], F.lit(False))
    return F.when(hit, score * 2).otherwise(score)


# What tells a query's domain, and the folders and endings that go with it.
FRONTEND_WORDS = "react tsx jsx sidebar component page route frontend client ui css tailwind next redirect".split()
BACKEND_WORDS = "api backend server database db sql endpoint middleware auth worker queue python".split()
FRONTEND_ENDINGS, BACKEND_ENDINGS = [".ts", ".tsx", ".js", ".jsx"], [".py"]
FRONTEND_FOLDERS = ["frontend/", "web/", "client/", "components/", "app/"]
BACKEND_FOLDERS = ["backend/", "server/", "api/", "services/"]
NOISE = ["navigationmenu", "navmenu", "menuitem", "dropdownmenu"]
FILE_FRONTEND_ENDINGS, FILE_BACKEND_ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".css", ".scss"], [".py", ".go", ".rs", ".java", ".sql"]
FILE_FRONTEND_FOLDERS = ["web/", "frontend/", "client/", "components/", "pages/", "app/"]
FILE_BACKEND_FOLDERS = ["backend/", "server/", "api/", "services/", "db/", "models/"]


def domain_intent(query: Column) -> Column:
    """frontend, backend or mixed, by which list has more words within the query."""
    q = F.lower(query)
    front, back = (sum((q.contains(w).cast("int") for w in ws), F.lit(0)) for ws in (FRONTEND_WORDS, BACKEND_WORDS))
    return F.when(front > back, "frontend").when(back > front, "backend").otherwise("mixed")


def _any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def intent_factor(path: Column, body: Column, intent: Column) -> Column:
    p = F.lower(path)
    ext = F.regexp_extract(p, r"\.[^./]*$", 0)
    side = lambda own, folders, other: F.when(ext.isin(own), 1.35).otherwise(1.0) * F.when(_any(p, folders), 1.20).otherwise(1.0) * F.when(ext.isin(other), 0.90).otherwise(1.0)
    by = F.when(intent == "frontend", side(FRONTEND_ENDINGS, FRONTEND_FOLDERS, BACKEND_ENDINGS)).when(intent == "backend", side(BACKEND_ENDINGS, BACKEND_FOLDERS, FRONTEND_ENDINGS)).otherwise(1.0)
    return by * F.when(_any(p, NOISE) | _any(F.lower(F.substring(body, 1, 240)), NOISE), 0.75).otherwise(1.0)


def file_intent_boost(path: Column, intent: Column) -> Column:
    p = F.lower(path)
    ext = F.regexp_extract(p, r"\.[^./]*$", 0)
    side = lambda own, folders, other: F.when(ext.isin(own), 0.04).otherwise(0.0) + F.when(_any(p, folders), 0.06).otherwise(0.0) - F.when(ext.isin(other), 0.03).otherwise(0.0)
    return F.when(intent == "frontend", side(FILE_FRONTEND_ENDINGS, FILE_FRONTEND_FOLDERS, FILE_BACKEND_ENDINGS)).when(intent == "backend", side(FILE_BACKEND_ENDINGS, FILE_BACKEND_FOLDERS, FILE_FRONTEND_ENDINGS)).otherwise(0.0)


def rank_files(scored: DataFrame, path: str, intent: Column) -> DataFrame:
    """path and score: a file's best row gives its rank (0 first), the rank 1 - 0.05 a place, and the intent a little."""
    best = scored.filter(F.coalesce(F.col(path), F.lit("")) != "").groupBy(path).agg(F.max("score").alias("raw"))
    # One row a file that the search returned; the search is limited.
    rank = F.row_number().over(Window.orderBy(F.round("raw", 9).desc(), path)) - 1
    return best.select(path, F.round(F.greatest(F.lit(0.0), 1 - rank * 0.05) + file_intent_boost(F.col(path), intent), 12).alias("score"))


def prompt_order(packed: DataFrame, key: str, score: Column, imported_by: Column, tokens: Column) -> DataFrame:
    """packed with utility and slot: the best rows at both ends, the worst in the middle. packed fits a prompt."""
    utility = score + 0.2 * F.least(imported_by, F.lit(10)) / 10 + 0.1 / (1 + tokens / 300)
    out = packed.withColumn("utility", utility)
    rn = F.row_number().over(Window.orderBy(F.round("utility", 9).desc(), key)) - 1
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    return out.withColumn("rank", rn).withColumn("slot", F.when(F.col("rank") % 2 == 0, F.floor(F.col("rank") / 2)).otherwise(n - F.floor((F.col("rank") + 1) / 2)).cast("long"))


def prior_utility(age_days: Column, quality: Column, confidence: Column, accesses: Column) -> Column:
    age = F.greatest(F.lit(0.0), age_days)
    return 0.45 / (1 + age / 30.0) + 0.25 * quality + 0.20 * confidence + 0.10 * F.least(accesses, F.lit(20.0)) / 20.0

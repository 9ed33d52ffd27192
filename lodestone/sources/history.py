"""Histories of files: recency from a commit log, and what changed between commits."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = ["git", "log", "--name-only", "--format=%H %ct"]


def commits(spark: SparkSession, root: str, last: int = 30, seconds: int = 10) -> DataFrame:
    """commit, at (seconds) and file_path of a repository's last commits; empty where there is no history. `last` bounds
    what the driver reads."""
    try:
        said = subprocess.run([*LOG, f"-{int(last)}"], cwd=root, capture_output=True, text=True, timeout=seconds).stdout
    except (OSError, subprocess.TimeoutExpired):
        said = ""
    return parsed(spark.createDataFrame([(said,)], "log string"))


def parsed(logs: DataFrame) -> DataFrame:
    """commit, at, file_path from logs of lines `<hash> <seconds>`, each followed by a commit's files."""
    entry = F.explode(F.split(F.concat(F.lit("\n"), "log"), r"\n+(?=[0-9a-f]{40} \d+(?:\n|$))"))
    lines = logs.select(entry.alias("entry")).select(F.split("entry", r"\n+").alias("lines"))
    head = F.split(F.col("lines")[0], " ")
    each = lines.filter(F.col("lines")[0].rlike(r"^[0-9a-f]{40} \d+$")).select(head[0].alias("commit"), head[1].cast("long").alias("at"), F.explode(F.slice("lines", 2, 1_000_000)).alias("file_path"))
    return each.select("commit", "at", F.trim("file_path").alias("file_path")).filter("file_path <> ''")


def recency(log: DataFrame, as_of: float, days: float = 30.0) -> DataFrame:
    """file_path, age_days of its latest commit, and score, which falls from 1 to 0 in so many days."""
    latest = log.groupBy("file_path").agg(F.max("at").alias("at"))
    age = (F.lit(float(as_of)) - F.col("at")) / 86400.0
    return latest.select("file_path", age.alias("age_days"), F.greatest(F.lit(0.0), 1 - age / days).alias("score"))


def changed_between(log: DataFrame, after: float, until: float) -> DataFrame:
    """file_path, commits and last of the files changed after one time and until another."""
    return log.filter((F.col("at") > after) & (F.col("at") <= until)).groupBy("file_path").agg(F.countDistinct("commit").alias("commits"), F.max("at").alias("last"))


def snapshot_at(versions: DataFrame, at: float) -> DataFrame:
    """Of versions (file_path, at, content; null content: removed) those that hold at a time."""
    held = versions.filter(F.col("at") <= at).groupBy("file_path").agg(F.max_by(F.struct("content"), "at").alias("v"))
    return held.select("file_path", "v.content").filter("content is not null")

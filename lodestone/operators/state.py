"""Sessions, snapshots and stores that change: each change is a new DataFrame from the old one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(log: DataFrame, session: str, item: str, at: str, tie: str) -> DataFrame:
    """The first row of each item in each session."""
    w = Window.partitionBy(session, item).orderBy(at, tie)
    return log.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def unseen(rows: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that the session has not been given yet."""
    return rows.join(seen.select(*keys), list(keys), "left_anti")


def session_stats(seen: DataFrame, session: str, tokens: str) -> DataFrame:
    return seen.groupBy(session).agg(F.count("*").alias("chunks_seen"), F.sum(tokens).alias("tokens_provided"))


def expired(sessions: DataFrame, last_used: str, as_of: Column, seconds: int = 14400) -> DataFrame:
    return sessions.filter(F.unix_seconds(F.col(last_used).cast("timestamp")) < F.unix_seconds(as_of.cast("timestamp")) - seconds)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key and change (added, changed, removed) between two snapshots."""
    o, n = old.select(key, F.col(digest).alias("__old")), new.select(key, F.col(digest).alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "changed")
    return o.join(n, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def replaced(store: DataFrame, fresh: DataFrame, key: str, gone: DataFrame | None = None) -> DataFrame:
    """The store with the rows of every key that fresh has replaced by fresh's, and those of keys that are gone removed."""
    keep = store.join(fresh.select(key).distinct(), key, "left_anti")
    if gone is not None:
        keep = keep.join(gone.select(key).distinct(), key, "left_anti")
    return keep.unionByName(fresh)


def without_file(path: str, chunks: DataFrame, index: DataFrame, refs: DataFrame, edges: DataFrame, module: str) -> tuple[DataFrame, ...]:
    """The four tables without a file, and without the edges at either end of its module."""
    p = F.col("file_path") != path
    return chunks.filter(p), index.filter(p), refs.filter(p), edges.filter((F.col("source_module") != module) & (F.col("target_module") != module))


def numbered(rows: DataFrame, order: Sequence[str], name: str, parts: int = 64) -> DataFrame:
    """rows with a number from 1 in this order. Rows are dealt by ranges of the first column, whose bounds come from a sample
    of some 20 keys a range, numbered within, and moved on by the ranges' sizes: no task orders them all."""
    first = F.col(order[0])
    total = max(1, rows.count())
    rate = min(1 << 30, int(20 * parts / total * (1 << 30)) + 1)
    keys = [r[0] for r in rows.filter(first.isNotNull() & (F.pmod(F.xxhash64(*order), F.lit(1 << 30)) < rate)).select(first).orderBy(first).collect()]
    bounds = [F.lit(keys[len(keys) * i // parts]) for i in range(1, parts)] if keys else []
    part = F.size(F.filter(F.array(*bounds), lambda b: b <= first)) if bounds else F.lit(0)
    dealt = rows.withColumn("__part", F.when(first.isNull(), -1).otherwise(part))
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of at most parts + 1 rows
    sizes = dealt.groupBy("__part").count().select("__part", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__within", within).join(F.broadcast(sizes), "__part").withColumn(name, F.col("__before") + F.col("__within")).drop("__part", "__within", "__before")


def inserted(store: DataFrame, fresh: DataFrame, digest: str, order: Sequence[str], number: str = "display_id") -> DataFrame:
    """The store and the fresh rows whose digest is new (the first of equals), numbered on from the largest number given so
    far."""
    new = fresh.groupBy(digest).agg(F.min_by(F.struct(*fresh.columns), F.struct(*order)).alias("__row")).select("__row.*").join(store.select(digest), digest, "left_anti")
    last = F.broadcast(store.agg(F.coalesce(F.max(number), F.lit(0)).cast("long").alias("__last")))
    onward = numbered(new, order, "__n").crossJoin(last).withColumn(number, F.col("__last") + F.col("__n")).drop("__last", "__n")
    return store.unionByName(onward.select(*store.columns))


def touched(notes: DataFrame, key: str, ids: Sequence, at: float) -> DataFrame:
    hit = F.col(key).isin(list(ids))
    return notes.withColumn("access_count", F.when(hit, F.col("access_count") + 1).otherwise(F.col("access_count"))).withColumn("last_accessed_at", F.when(hit, F.lit(at)).otherwise(F.col("last_accessed_at")))


def resolved(notes: DataFrame, key: str, which, status: str, at: float) -> DataFrame:
    """A note's status; the time of its resolution is kept unless it is active again."""
    if status not in ("active", "resolved", "superseded", "rejected"):
        raise ValueError(status)
    hit = F.col(key) == which
    when = F.lit(None).cast("double") if status == "active" else F.lit(at)
    return notes.withColumn("decision_status", F.when(hit, status).otherwise(F.col("decision_status"))).withColumn("resolved_at", F.when(hit, when).otherwise(F.col("resolved_at")))


def visible(notes: DataFrame, as_of: Column, blocked: bool = False, expired_too: bool = False) -> DataFrame:
    """Notes that are neither blocked nor expired; an expiry that can't be read counts as over."""
    out = notes if blocked else notes.filter(F.coalesce(F.col("trust_level"), F.lit("")) != "blocked")
    x = F.col("expires_at").cast("string")
    return out if expired_too else out.filter(x.isNull() | (F.coalesce(x.try_cast("double"), F.lit(0.0)) > as_of))


def bursts(events: DataFrame, by: str, at: str, gap: str) -> DataFrame:
    """by, first, last, n of each run of events that follow each other within the gap."""
    return events.groupBy(by, F.session_window(at, gap).alias("w")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("w")


def changed_files(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of files (file_path, content_hash) those to parse anew, and those whose parsed form the cache has."""
    known = cache.select("file_path", "content_hash").distinct()
    return files.join(known, ["file_path", "content_hash"], "left_anti"), files.join(known, ["file_path", "content_hash"], "left_semi")


def cached(cache: DataFrame, fresh: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """The cache with the fresh rows in place of those of their files and, if `present` says which files there are, without
    the rows of others."""
    out = replaced(cache, fresh, "file_path")
    return out if present is None else out.join(present.select("file_path").distinct(), "file_path", "left_semi")


def current(rows: DataFrame, at: str, as_of: float, seconds: float) -> DataFrame:
    """Rows no older than so many seconds."""
    return rows.filter(F.col(at) > as_of - seconds)


def last_used(cache: DataFrame, used: str, tie: str, most: int) -> DataFrame:
    """The rows used last, at most so many."""
    return cache.orderBy(F.col(used).desc(), tie).limit(most)

"""Continuous forms of the state operators. Each takes a streaming DataFrame and returns one, or starts a query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def source(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """Parquet files as they come into a folder, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def seen_once(events: DataFrame, session: str, item: str, at: str, within: str = "4 hours") -> DataFrame:
    """Each item of a session once; what is remembered goes after `within`."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark([session, item])


def bursts(events: DataFrame, by: str, at: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """first, last and n of each run of events no further apart than the gap, once it is over: the trailing edge of a
    debounce."""
    grouped = events.withWatermark(at, late).groupBy(by, F.session_window(at, gap).alias("w"))
    return grouped.agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("w")


def usage(events: DataFrame, at: str, kind: str, value: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), kind)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def refresh(changes: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, every: str | None = "60 seconds") -> StreamingQuery:
    """Each batch of changed files given to apply, which replaces their rows in the store; with every None, what is there is
    worked off and the query ends. A batch that comes again after a failure replaces the same rows."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: apply(batch))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

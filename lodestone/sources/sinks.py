"""Tables and documents that change as a whole, telemetry that is appended, and notes as JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, path: str) -> None:
    """df in place of what is at path, which df may read: it is written beside it, and the folders change names. One writer."""
    spark = df.sparkSession
    fresh, old = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    fs, at = _fs(spark, path)
    if fs.exists(at):
        fs.rename(at, _fs(spark, old)[1])
    fs.rename(_fs(spark, fresh)[1], at)
    fs.delete(_fs(spark, old)[1], True)


def record(events: DataFrame, path: str, *metadata: str) -> None:
    """Events appended, with the named columns as one JSON text."""
    rest = [c for c in events.columns if c not in metadata]
    events.select(*rest, F.to_json(F.struct(*metadata)).alias("metadata")).write.mode("append").parquet(path)


def metadata(column: Column, schema: str) -> Column:
    """The JSON text as a struct; nulls in it where the text can't be read."""
    return F.from_json(column, schema)


def notes_to_json(notes: DataFrame) -> DataFrame:
    """A JSON object a row."""
    return notes.select(F.to_json(F.struct(*notes.columns)).alias("value"))


def notes_from_json(lines: DataFrame, schema: str, store: DataFrame, digest: str) -> DataFrame:
    """The notes that the store doesn't have; a row that is no such object is an error before any is taken."""
    got = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("n")).select("n.*")
    return got.dropDuplicates([digest]).join(store.select(digest), digest, "left_anti").select(*got.columns)


def openapi(routes: DataFrame, title: str = "API", version: str = "1.0.0") -> DataFrame:
    """One row, spec: an OpenAPI document of routes (method, path, handler). There are as many paths as the API has."""
    op = F.struct(F.lower("method").alias("key"), F.struct(F.col("handler").alias("operationId")).alias("value"))
    each = routes.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_set(op))).alias("ops"))
    paths = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", F.to_json("ops").alias("o")))))
    doc = each.agg(paths.alias("p")).select(F.to_json(F.struct(F.lit("3.0.0").alias("openapi"), F.struct(F.lit(title).alias("title"), F.lit(version).alias("version")).alias("info"), F.transform_values("p", lambda _, v: F.from_json(v, "map<string,struct<operationId:string>>")).alias("paths"))).alias("spec"))
    return doc


def postman(routes: DataFrame, title: str = "API") -> DataFrame:
    """One row, spec: a Postman collection of routes (method, path, handler), by path and method."""
    item = F.struct(F.concat_ws(" ", F.upper("method"), "path").alias("name"), F.struct(F.upper("method").alias("method"), F.struct(F.concat(F.lit("{{baseUrl}}"), "path").alias("raw")).alias("url"), "handler").alias("request"))
    each = routes.select("path", F.upper("method").alias("m"), item.alias("item")).distinct().agg(F.array_sort(F.collect_list(F.struct("path", "m", "item"))).alias("items"))
    info = F.struct(F.lit(title).alias("name"), F.lit("https://schema.getpostman.com/json/collection/v2.1.0/collection.json").alias("schema"))
    return each.select(F.to_json(F.struct(info.alias("info"), F.col("items.item").alias("item"))).alias("spec"))


def api_markdown(routes: DataFrame, title: str = "API") -> DataFrame:
    """One row, text: a document with a table of the routes of each file."""
    line = F.concat(F.lit("| "), F.upper("method"), F.lit(" | `"), "path", F.lit("` | "), "handler", F.lit(" |"))
    rows = routes.select("file_path", "path", line.alias("line")).distinct().groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("l"))
    part = F.concat(F.lit("## "), "file_path", F.lit("\n\n| Method | Path | Handler |\n|-|-|-|\n"), F.array_join(F.col("l.line"), "\n"))
    parts = rows.agg(F.array_sort(F.collect_list(F.struct("file_path", part.alias("part")))).alias("p"))
    return parts.select(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.col("p.part"), "\n\n"), F.lit("\n")).alias("text"))

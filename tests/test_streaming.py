import json

from pyspark.sql import functions as F

from lodestone.sources import sinks
from lodestone.streaming import jobs

SCHEMA = "user long, item string, ts timestamp, value double"


def _events(spark, folder):
    rows = [(1, "a", "2024-01-01 00:00:00", 1.0), (1, "a", "2024-01-01 00:00:03", 2.0), (1, "b", "2024-01-01 00:00:20", 3.0), (2, "a", "2024-01-01 00:00:01", 4.0), (9, "z", "2024-01-09 00:00:00", 0.0)]
    spark.createDataFrame(rows, "user long, item string, ts string, value double").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(folder)


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return df.sparkSession.table(name).collect()


def test_seen_once_and_bursts(spark, tmp_path):
    folder = str(tmp_path / "in")
    _events(spark, folder)
    got = _run(jobs.seen_once(jobs.source(spark, folder, SCHEMA), "user", "item", "ts"), "seen")
    assert sorted((r.user, r.item) for r in got) == [(1, "a"), (1, "b"), (2, "a"), (9, "z")]
    bursts = _run(jobs.bursts(jobs.source(spark, folder, SCHEMA), "user", "ts", "5 seconds"), "bursts")
    assert sorted((r.user, r.n) for r in bursts) == [(1, 1), (1, 2), (2, 1)]
    use = _run(jobs.usage(jobs.source(spark, folder, SCHEMA), "ts", "item", "value"), "use")
    assert sorted((r.item, r.n, r.total) for r in use) == [("a", 3, 7.0), ("b", 1, 3.0)]


def test_refresh_replaces(spark, tmp_path):
    from lodestone.operators.state import replaced

    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    _events(spark, folder)
    sinks.publish(spark.createDataFrame([(1, "old", 0.0), (5, "kept", 0.0)], "user long, item string, value double"), store)

    def apply(batch):
        sinks.publish(replaced(spark.read.parquet(store), batch.select("user", "item", "value"), "user"), store)

    for _ in range(2):
        q = jobs.refresh(jobs.source(spark, folder, SCHEMA), apply, str(tmp_path / "at"), every=None)
        q.awaitTermination(60)
        got = sorted((r.user, r.item) for r in spark.read.parquet(store).collect())
        assert got == [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (5, "kept"), (9, "z")]


def test_telemetry_and_notes(spark, tmp_path):
    path = str(tmp_path / "events")
    sinks.record(spark.createDataFrame([("map", 5, "q", 3)], "event_type string, duration long, mode string, results long"), path, "mode", "results")
    row = spark.read.parquet(path).select("event_type", sinks.metadata(F.col("metadata"), "mode string, results long").alias("m")).first()
    assert (row.event_type, row.m.mode, row.m.results) == ("map", "q", 3)
    notes = spark.createDataFrame([("x", "h1"), ("y", "h2"), ("z", "h2")], "content string, digest string")
    back = sinks.notes_from_json(sinks.notes_to_json(notes), "content string, digest string", notes.filter("digest = 'h1'"), "digest")
    assert [r.digest for r in back.collect()] == ["h2"]


def test_openapi(spark):
    routes = spark.createDataFrame([("GET", "/a", "one"), ("POST", "/a", "two"), ("GET", "/b", "three")], "method string, path string, handler string")
    doc = json.loads(sinks.openapi(routes).first().spec)
    assert doc["openapi"] == "3.0.0" and doc["paths"]["/a"]["post"]["operationId"] == "two" and set(doc["paths"]) == {"/a", "/b"}

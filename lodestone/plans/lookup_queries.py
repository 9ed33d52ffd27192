"""Queries of point lookups, notes, a stored index, the older scores, code in brief, and more roll-ups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import checks
from ..functions import text as T
from ..operators import fulltext, graph, lookup, notes, postings, prompt, telemetry
from ..sources.shared import shared_dir
from .catalog import query, table
from .search_queries import PART_FIELDS, PART_TERMS, PHRASE, TERMS, R, _sql_bm25

_TYPE = "CASE doc_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' ELSE 'module' END"
_CHUNKS = f"(SELECT doc_id, source AS file_path, CASE doc_id % 4 WHEN 1 THEN 'C' || doc_id % 7 || '.' ELSE '' END || 'd' || doc_id % 50 AS chunk_name, {_TYPE} AS chunk_type, doc_id AS start_line, split_part(text, chr(10), 1) AS signature, text AS body FROM documents)"


def _chunks(spark, sf):
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, "function").when(i % 4 == 1, "method").when(i % 4 == 2, "class").otherwise("module")
    name = F.concat(F.when(i % 4 == 1, F.concat(F.lit("C"), (i % 7).cast("string"), F.lit("."))).otherwise(""), F.lit("d"), (i % 50).cast("string"))
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("file_path"), name.alias("chunk_name"), kind.alias("chunk_type"), i.alias("start_line"), F.get(F.split("text", "\n", -1), F.lit(0)).alias("signature"), F.col("text").alias("body"))


@query("chunks_by_name", f"SELECT doc_id FROM {_CHUNKS} WHERE chunk_name = 'd12' ORDER BY file_path, start_line LIMIT 20")
def chunks_by_name(spark, sf):
    return lookup.by_name(_chunks(spark, sf), "d12").select("doc_id")


@query("methods_by_suffix", f"SELECT doc_id FROM {_CHUNKS} WHERE chunk_type = 'method' AND chunk_name ILIKE '%.d13' ORDER BY file_path, start_line LIMIT 20")
def methods_by_suffix(spark, sf):
    return lookup.methods_by_suffix(_chunks(spark, sf), "D13").select("doc_id")


@query("chunks_in_file", f"SELECT doc_id, chunk_name FROM {_CHUNKS} WHERE file_path = (SELECT min(source) FROM documents) ORDER BY start_line")
def chunks_in_file(spark, sf):
    first = table(spark, sf, "documents").agg(F.min("source")).first()[0]
    return lookup.in_file(_chunks(spark, sf), first).select("doc_id", "chunk_name")


@query("all_signatures", f"SELECT file_path, chunk_name, chunk_type, signature, start_line FROM {_CHUNKS}")
def all_signatures(spark, sf):
    return lookup.signatures(_chunks(spark, sf))


@query("indexed_files", "SELECT DISTINCT source AS file_path FROM documents")
def indexed_files(spark, sf):
    return lookup.indexed_files(_chunks(spark, sf))


@query("matching_files", "SELECT DISTINCT url AS file_path FROM pages WHERE url ILIKE '%blog%' OR url ILIKE '%_r/7%' OR url ILIKE '%zzz%' ORDER BY url LIMIT 5")
def matching_files(spark, sf):
    return lookup.matching_files(table(spark, sf, "pages").select(F.col("url").alias("file_path")), "BLOG _r/7 zzz")


@query(
    "name_lane",
    f"""WITH c AS {_CHUNKS}, r AS (SELECT DISTINCT 'd' || l_partkey % 50 AS caller, CASE l_linenumber % 2 WHEN 0 THEN 'd' || l_suppkey % 50 ELSE 'x.d' || l_suppkey % 50 END AS called FROM lineitem),
s AS (SELECT * FROM c WHERE chunk_type = 'function' ORDER BY doc_id DESC LIMIT 12),
down AS (SELECT DISTINCT called AS name FROM (SELECT caller, called, row_number() OVER (PARTITION BY caller ORDER BY called) AS n FROM r WHERE caller IN (SELECT chunk_name FROM s)) WHERE n <= 25),
up AS (SELECT DISTINCT caller AS name FROM (SELECT caller, called, row_number() OVER (PARTITION BY called ORDER BY caller) AS n FROM r WHERE called IN (SELECT chunk_name FROM s)) WHERE n <= 25),
hit AS (SELECT doc_id, 1.0 AS score, row_number() OVER (PARTITION BY name ORDER BY file_path, doc_id) AS n FROM c JOIN down ON chunk_name = name
UNION ALL SELECT doc_id, 0.95, row_number() OVER (PARTITION BY leaf ORDER BY file_path, doc_id) FROM c JOIN (SELECT DISTINCT split_part(name, '.', -1) AS leaf FROM down WHERE contains(name, '.')) ON split_part(chunk_name, '.', -1) = leaf WHERE chunk_type = 'method'
UNION ALL SELECT doc_id, 0.9, row_number() OVER (PARTITION BY name ORDER BY file_path, doc_id) FROM c JOIN up ON chunk_name = name)
SELECT doc_id, CAST(max(score) AS DOUBLE) AS score FROM hit WHERE n <= 4 AND doc_id NOT IN (SELECT doc_id FROM s) GROUP BY doc_id ORDER BY max(score) DESC, doc_id LIMIT 80""",
)
def name_lane(spark, sf):
    chunks = _chunks(spark, sf).withColumnRenamed("doc_id", "key")
    called = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "d").otherwise("x.d"), (F.col("l_suppkey") % 50).cast("string"))
    refs = table(spark, sf, "lineitem").select(F.lit("f").alias("file_path"), called.alias("ref_name"), F.concat(F.lit("d"), (F.col("l_partkey") % 50).cast("string")).alias("containing_chunk"))
    seeds = chunks.filter("chunk_type = 'function'").select("key", "chunk_name", "file_path", F.col("key").cast("double").alias("score"))
    return graph.name_lane(seeds, refs, chunks).withColumnRenamed("key", "doc_id")


def _index(spark, rows, key, fields):
    """Written and read again: a search then reads its terms' buckets only."""
    at = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    postings.save(postings.build(rows, key, fields, 16), at)
    return postings.load(spark, at, key)


@query("indexed_bm25", f"WITH {_sql_bm25('documents', 'doc_id', {'text': 1.0}, TERMS, False)} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, doc_id LIMIT 60")
def indexed_bm25(spark, sf):
    got = postings.bm25(_index(spark, table(spark, sf, "documents"), "doc_id", {"text": 1.0}), TERMS)
    return fulltext.top(got, "doc_id", 60).select("doc_id", F.round("score", 6).alias("score"))


@query("indexed_phrase", f"WITH {_sql_bm25('documents', 'doc_id', {'text': 1.0}, PHRASE, True)} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, doc_id LIMIT 50")
def indexed_phrase(spark, sf):
    got = postings.bm25(_index(spark, table(spark, sf, "documents"), "doc_id", {"text": 1.0}), PHRASE, every=True)
    return fulltext.top(got, "doc_id", 50).select("doc_id", F.round("score", 6).alias("score"))


@query("indexed_multifield", f"WITH {_sql_bm25('part', 'p_partkey', PART_FIELDS, PART_TERMS, False)} SELECT p_partkey, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, p_partkey LIMIT 50")
def indexed_multifield(spark, sf):
    got = postings.bm25(_index(spark, table(spark, sf, "part"), "p_partkey", PART_FIELDS), PART_TERMS)
    return fulltext.top(got, "p_partkey", 50).select("p_partkey", F.round("score", 6).alias("score"))


@query("indexed_vocab", f"SELECT term, count(DISTINCT doc_id) AS doc, count(*) AS cnt FROM (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '{R}')) AS term FROM documents) GROUP BY term")
def indexed_vocab(spark, sf):
    return postings.vocabulary(postings.build(table(spark, sf, "documents"), "doc_id", {"text": 1.0}))


def _notes(spark, sf):
    i = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf, "conversations").select(
        i.alias("display_id"), F.col("text").alias("content"), F.lit("workflow,decision,q:aa,t:bb").alias("tags"), F.when(i % 3 == 0, "manual").otherwise("auto-workflow").alias("source_type"), F.when(i % 2 == 0, "decision").otherwise("fact").alias("memory_type"),
        F.when(i % 5 == 0, "resolved").otherwise("active").alias("decision_status"), F.concat(F.lit("s"), (F.col("conv_id") % 4).cast("string")).alias("session_id"), F.lit(0.5).alias("confidence"), F.lit("").alias("evidence"), F.lit("a").alias("agent"), F.lit("local_verified").alias("trust_level"), (1000.0 + F.col("turn")).alias("created_at"), F.lit(2000.0).alias("expires_at"),
    )


_N = "(SELECT conv_id * 1000 + turn AS i, conv_id, turn, text FROM conversations)"


@query("note_filters", f"SELECT i AS display_id FROM {_N} WHERE i % 3 <> 0 AND i % 2 = 0 AND i % 5 <> 0 AND conv_id % 4 = 1")
def note_filters(spark, sf):
    return notes.listed(_notes(spark, sf), "auto-workflow", "decision", "active", "s1").select("display_id")


@query("note_count", f"SELECT count(*) AS notes FROM {_N} WHERE i % 3 = 0 AND i % 2 <> 0")
def note_count(spark, sf):
    return notes.counted(_notes(spark, sf), "manual", "fact")


@query("note_forget", f"SELECT i AS display_id FROM {_N} WHERE i <> 1001")
def note_forget(spark, sf):
    return notes.forget(_notes(spark, sf), 1001).select("display_id")


@query("note_capture", f"SELECT i AS display_id, text AS content FROM {_N} UNION ALL SELECT max(i) + 1, 'Workflow decision: query=''Find the Route'' -> deep_target=''api.Route''. Focus files: a.py, b.py' FROM {_N}")
def note_capture(spark, sf):
    """A new decision is added once: the second capture finds the first."""
    made = notes.decision("Find the Route", "api.Route", ["b.py", "a.py", "b.py"], 1500.0)
    once = notes.captured(_notes(spark, sf), made, 1500.0)
    return notes.captured(once, made, 1600.0).select("display_id", "content")


_W = "list_distinct(regexp_extract_all(lower(concat_ws(' ', chunk_name, signature, substr(body, 1, 300))), '[\\p{L}\\p{N}_]+'))"


@query("word_share", f"SELECT doc_id, round(len(list_filter(['d12', 'of', 'the', 'thor'], lambda q: list_contains({_W}, q))) / 4, 6) AS score FROM {_CHUNKS}")
def word_share(spark, sf):
    share = prompt.word_share("The thor of D12", F.col("chunk_name"), F.col("signature"), F.substring("body", 1, 300))
    return _chunks(spark, sf).select("doc_id", F.round(share, 6).alias("score"))


@query("first_lines", "SELECT doc_id, CASE WHEN len(l) <= 3 THEN text ELSE array_to_string(list_concat(l[1:3], ['# ... truncated']), chr(10)) END AS body FROM (SELECT doc_id, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents)")
def first_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", prompt.first_lines(F.col("text"), 3).alias("body"))


@query("key_signatures", "SELECT conv_id, turn, 'Classes/Interfaces:' || chr(10) || '  class C' || conv_id || CASE WHEN turn > 0 THEN chr(10) || 'Functions:' || chr(10) || '  def f' || turn || '(a, b) -> int:' ELSE '' END AS brief FROM conversations")
def key_signatures(spark, sf):
    code = F.concat(F.lit("class C"), "conv_id", F.when(F.col("turn") > 0, F.concat(F.lit(" \n def f"), "turn", F.lit("(a, b) -> int:\n  pass\n"))).otherwise(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", prompt.key_signatures(code).alias("brief"))


@query("project_breakdown", "SELECT event_type AS project, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, count(*) AS queries FROM events GROUP BY event_type")
def project_breakdown(spark, sf):
    rows = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return telemetry.project_breakdown(rows, "event_type", "k")


@query("savings", "SELECT l_returnflag, round(sum(l_quantity), 4) AS first, round(sum(l_quantity * (1 - l_discount)), 4) AS second, round((1 - sum(l_quantity * (1 - l_discount)) / sum(l_quantity)) * 100, 1) AS saved_pct, round(sum(l_quantity * (1 - l_discount)) / sum(l_quantity), 3) AS ratio FROM lineitem GROUP BY l_returnflag")
def savings(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("less", F.col("l_quantity") * (1 - F.col("l_discount")))
    return telemetry.savings(rows, "l_returnflag", "l_quantity", "less").withColumn("first", F.round("first", 4)).withColumn("second", F.round("second", 4))


@query("fallback_rates", "SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 4) AS slow, round(avg(CASE WHEN user_id % 7 = 0 THEN 1.0 ELSE 0 END), 4) AS fell_back FROM events GROUP BY event_type")
def fallback_rates(spark, sf):
    return telemetry.rates(table(spark, sf, "events"), "event_type", slow=F.col("value") > 50, fell_back=F.col("user_id") % 7 == 0)


@query("usage_estimate", f"SELECT file_path, CAST(sum(CASE WHEN t = '' THEN 0 ELSE greatest(length(t) // 4, 1) END) AS BIGINT) AS tokens FROM (SELECT file_path, chunk_name || chr(10) || signature AS t FROM {_CHUNKS}) GROUP BY file_path")
def usage_estimate(spark, sf):
    return telemetry.usage_estimate(_chunks(spark, sf), "file_path", F.col("chunk_name"), F.col("signature"))


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END || '+00:00' AS iso, epoch_us(ts) AS micros FROM events")
def iso_times(spark, sf):
    """Seconds as text and back."""
    micros = F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    text = checks.iso(micros / 1_000_000)
    return table(spark, sf, "events").select("event_id", text.alias("iso"), F.round(checks.epoch(text) * 1_000_000).cast("long").alias("micros"))


@query("folded_words", f"SELECT doc_id, len(regexp_extract_all(strip_accents(lower(text)), '{R}')) AS n, md5(array_to_string(regexp_extract_all(strip_accents(lower(text)), '{R}'), ' ')) AS digest FROM documents")
def folded_words(spark, sf):
    w = T.words(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("digest"))

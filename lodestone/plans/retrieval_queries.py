"""Queries of composed retrieval, recall, packing by side, and parsing of literal source rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget, fulltext, fusion, retrieval
from ..sources import code
from .catalog import query, table
from .search_queries import TERMS, _sql_bm25, _sql_rrf

_FILL = """WITH RECURSIVE base AS (SELECT side, item, tokens, row_number() OVER (PARTITION BY side ORDER BY tokens, item) AS rn FROM (SELECT DISTINCT l_suppkey AS side, l_partkey AS item, p_size AS tokens FROM lineitem JOIN part ON l_partkey = p_partkey)),
go AS (SELECT DISTINCT side, 0 AS rn, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS item, 0 AS tokens, false AS taken FROM base
UNION ALL SELECT b.side, b.rn, CASE WHEN go.used + b.tokens <= 150 THEN go.used + b.tokens ELSE go.used END, b.item, b.tokens, go.used + b.tokens <= 150 FROM go JOIN base b ON b.side = go.side AND b.rn = go.rn + 1)"""


def _sides(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("tokens"))
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("side"), F.col("l_partkey").alias("item")).distinct().join(parts, "item")


@query("deep_pack", f"{_FILL} SELECT side, item, CAST(tokens AS BIGINT) AS tokens, used FROM go WHERE taken")
def deep_pack(spark, sf):
    return budget.greedy_fill(_sides(spark, sf), "side", [F.col("tokens"), F.col("item")], "item", "tokens", 150)


@query("deep_overflow", f"{_FILL} SELECT side, item FROM go WHERE rn > 0 AND NOT taken")
def deep_overflow(spark, sf):
    return _sides(spark, sf).select("side", "item").join(deep_pack(spark, sf), ["side", "item"], "left_anti")


_NOTES = "(SELECT conv_id * 1000 + turn AS key, text AS content, role AS tags FROM conversations)"
_AS_OF = 86400.0 * 400
_TEXT = f"WITH {_sql_bm25(_NOTES, 'key', {'content': 1.0, 'tags': 1.0}, TERMS, False)} SELECT key, score FROM scored ORDER BY round(score, 9) DESC, key LIMIT 60"
_WORDS = "', '".join(TERMS)
_OVER = f"SELECT key, score FROM (SELECT key, (SELECT sum(CASE WHEN list_contains(w, q) THEN 1.0 WHEN len(list_filter(w, lambda x: starts_with(q, x) OR starts_with(x, q))) > 0 THEN 0.5 ELSE 0 END) FROM (SELECT unnest(['{_WORDS}']) AS q)) / 4 AS score FROM (SELECT key, list_distinct(regexp_extract_all(strip_accents(lower(content)), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {_NOTES})) WHERE score > 0 ORDER BY round(score, 9) DESC, key LIMIT 60"
_PRIOR = f"SELECT key, 0.45 / (1 + (key % 390) / 30.0) + 0.25 + 0.2 * ((key % 10) / 10.0) + 0.1 * least(key % 40, 20) / 20.0 AS score FROM {_NOTES} ORDER BY round(0.45 / (1 + (key % 390) / 30.0) + 0.25 + 0.2 * ((key % 10) / 10.0) + 0.1 * least(key % 40, 20) / 20.0, 9) DESC, key LIMIT 60"


def _notes(spark, sf):
    key = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf, "conversations").select(
        key.alias("key"), F.col("text").alias("content"), F.col("role").alias("tags"), F.lit(1.0).alias("quality"), (key % 10 / 10.0).alias("confidence"), (key % 40).alias("accesses"),
        (_AS_OF - 86400.0 * (key % 390)).alias("created_at"), F.when(key % 9 == 0, "blocked").otherwise("local_verified").alias("trust_level"), F.when(key % 4 == 0, "1").alias("expires_at"),
    )


@query("recall_hybrid", f"SELECT key, round(score, 6) AS score FROM {_sql_rrf({'text': (_TEXT, 3.0), 'overlap': (_OVER, 1.0), 'prior': (_PRIOR, 1.0)}, 'key')} WHERE key % 9 <> 0 AND key % 4 <> 0 ORDER BY round(score, 9) DESC, key LIMIT 10")
def recall_hybrid(spark, sf):
    return retrieval.recall(_notes(spark, sf), " ".join(TERMS), _AS_OF, 10).select("key", F.round("score", 6).alias("score"))


def document_chunks(spark, sf):
    """Documents in a chunk table's shape."""
    first = F.get(F.split("text", "\n", -1), F.lit(0))
    n = F.col("doc_id")
    kind = F.when(n % 3 == 0, "function").when(n % 3 == 1, "method").otherwise("class")
    folder = F.when(n % 5 == 0, "tests/").when(n % 5 == 1, "vendor/").otherwise("src/")
    return table(spark, sf, "documents").select(
        F.lpad(n.cast("string"), 12, "0").alias("key"), F.concat(F.lit("d"), n.cast("string")).alias("chunk_name"), F.concat(folder, "source", F.lit(".py")).alias("file_path"),
        kind.alias("chunk_type"), n.alias("start_line"), n.alias("end_line"), first.alias("signature"), F.col("text").alias("body"),
    )


@query("context_pipeline")
def context_pipeline(spark, sf):
    """Not in SQL: the lanes' fusion falls back on the data, and packing folds."""
    o = retrieval.Options(budget=20_000, seen=document_chunks(spark, sf).filter("start_line % 11 = 0"))
    return retrieval.context(document_chunks(spark, sf), "find the " + " ".join(TERMS), o).select("key", F.round("score", 6).alias("score"), "tokens", "used", "slot")


@query("map_pipeline")
def map_pipeline(spark, sf):
    return retrieval.signatures(document_chunks(spark, sf), "show me " + " ".join(TERMS), 20, "function").select("key", F.round("score", 6).alias("score"), "signature", "hint")


@query("three_lane_raw_fallback", f"WITH {_sql_bm25('documents', 'doc_id', {'text': 1.0}, TERMS[:1], False)} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, doc_id LIMIT 30")
def three_lane_raw_fallback(spark, sf):
    """One lane alone keeps its own scores."""
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "key")
    lane = fulltext.top(fulltext.bm25(docs, "key", {"text": 1.0}, TERMS[:1]), "key", 30)
    none = fulltext.bm25(docs, "key", {"text": 1.0}, TERMS[:1], every=True)
    return retrieval._fuse({"or": (lane, 1.0), "and": (none, 2.0)}).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


SOURCES = [
    ("app/auth.py", "python", "import os\nfrom db import store as st\n\nLIMIT = 5\n\n\ndef verify(token):\n    return st(token) and check(token)\n\n\nclass Auth:\n    def login(self, user):\n        return verify(user)\n"),
    ("web/page.ts", "typescript", "import {a} from './lib'\nexport function render(user) {\n  return show(user)\n}\n"),
]


def _sources(spark):
    return spark.createDataFrame(SOURCES, "file_path string, language string, text string")


_CHUNK_ROWS = "('app/auth.py', 'LIMIT', 'constant', 4, 4), ('app/auth.py', 'verify', 'function', 7, 8), ('app/auth.py', 'Auth', 'class', 11, 13), ('app/auth.py', 'Auth.login', 'method', 12, 13), ('web/page.ts', 'render', 'function', 2, 4)"


@query("parse_chunks", f"SELECT p AS file_path, n AS chunk_name, k AS chunk_type, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line FROM (VALUES {_CHUNK_ROWS}) v(p, n, k, a, b)")
def parse_chunks(spark, sf):
    return code.chunks(_sources(spark)).select("file_path", "chunk_name", "chunk_type", "start_line", "end_line")


_REF_ROWS = "('app/auth.py', 'store', 8, 'verify'), ('app/auth.py', 'check', 8, 'verify'), ('app/auth.py', 'verify', 13, 'Auth.login'), ('web/page.ts', 'show', 3, 'render')"


@query("call_refs", f"SELECT p AS file_path, n AS ref_name, CAST(a AS BIGINT) AS line_number, c AS containing_chunk FROM (VALUES {_REF_ROWS}) v(p, n, a, c)")
def call_refs(spark, sf):
    return code.call_refs(_sources(spark)).select("file_path", "ref_name", "line_number", "containing_chunk")


@query("parse_imports", "SELECT p AS file_path, t AS target, k AS import_type FROM (VALUES ('app/auth.py', 'os', 'import'), ('app/auth.py', 'db', 'from'), ('web/page.ts', './lib', 'import')) v(p, t, k)")
def parse_imports(spark, sf):
    return code.imports(_sources(spark)).select("file_path", "target", "import_type")


@query("query_intents", "SELECT q, i FROM (VALUES ('react sidebar page', 'frontend'), ('api server worker', 'backend'), ('nothing here', 'mixed'), ('build the database', 'mixed')) v(q, i)")
def query_intents(spark, sf):
    """Words count within words, too: build has ui."""
    rows = [("react sidebar page",), ("api server worker",), ("nothing here",), ("build the database",)]
    return spark.createDataFrame(rows, "q string").select("q", fusion.domain_intent(F.col("q")).alias("i"))

"""Queries of graphs, intervals, telemetry, sessions, snapshots, notes, and text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fulltext, fusion, graph, overview, state, telemetry
from .catalog import query, table


def _edges(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


_E = "(SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)"


@query("callers", f"SELECT DISTINCT src FROM {_E} WHERE dst = 5 ORDER BY src LIMIT 50")
def callers(spark, sf):
    return graph.callers(_edges(spark, sf), 5)


@query("callees", f"SELECT DISTINCT dst FROM {_E} WHERE src = 7 ORDER BY dst LIMIT 50")
def callees(spark, sf):
    return graph.callees(_edges(spark, sf), 7)


@query("neighbors_batch", f"SELECT node, array_to_string(list_sort(list(dst)), ',') AS imports FROM (SELECT p_partkey AS node FROM part) n LEFT JOIN {_E} e ON e.src = n.node GROUP BY node")
def neighbors_batch(spark, sf):
    got = graph.neighbours(_edges(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").alias("node")))
    return got.select("node", F.when(F.col("imports").isNotNull(), F.array_join(F.col("imports").cast("array<string>"), ",")).alias("imports"))


@query("in_degree_importance", f"WITH d AS (SELECT dst AS node, count(*) AS in_degree FROM {_E} GROUP BY dst) SELECT node, in_degree, round(in_degree / (SELECT max(in_degree) FROM d), 6) AS score FROM d")
def in_degree_importance(spark, sf):
    return graph.importance(_edges(spark, sf)).select("node", "in_degree", F.round("score", 6).alias("score"))


@query(
    "graph_lane",
    f"""WITH s AS (SELECT p_partkey AS key, 1.0 + p_size / 100.0 AS score FROM part WHERE p_size = 7 ORDER BY p_partkey LIMIT 12),
near AS (SELECT DISTINCT key, dst AS other, score AS got FROM s JOIN {_E} ON key = src UNION SELECT DISTINCT key, src, score * 0.9 FROM s JOIN {_E} ON key = dst),
capped AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY got DESC, other) AS n FROM near)
SELECT other AS key, round(max(got), 6) AS score FROM capped WHERE n <= 25 AND other NOT IN (SELECT key FROM s) GROUP BY other ORDER BY max(got) DESC, other LIMIT 50""",
)
def graph_lane(spark, sf):
    seeds = table(spark, sf, "part").filter("p_size = 7").orderBy("p_partkey").limit(12).select(F.col("p_partkey").alias("key"), (1 + F.col("p_size") / 100.0).alias("score"))
    return graph.graph_lane(_edges(spark, sf), seeds).select("key", F.round("score", 6).alias("score"))


def _spans(spark, sf):
    e = table(spark, sf, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("user_id", F.col("event_id").alias("span"), start.alias("start"), (start + F.floor(F.abs("value") * 60e6)).cast("long").alias("end"), "event_type")


_SP = "(SELECT user_id, event_id AS span, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(abs(value) * 60e6) AS BIGINT) AS e, event_type FROM events)"


@query("narrowest_interval", f"SELECT event_id, owner FROM (SELECT p.event_id, i.span AS owner, row_number() OVER (PARTITION BY p.event_id ORDER BY i.e - i.s NULLS LAST, i.span) AS n FROM (SELECT event_id, user_id, epoch_us(ts) + 1 AS at FROM events) p LEFT JOIN {_SP} i ON i.user_id = p.user_id AND p.at BETWEEN i.s AND i.e) WHERE n = 1")
def narrowest_interval(spark, sf):
    spans = _spans(spark, sf).drop("event_type")
    points = table(spark, sf, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) + 1).alias("at"))
    return graph.narrowest(points, spans, "user_id", "at", "event_id").select("event_id", "owner")


_KIND = "CASE WHEN event_type IN ('click', 'view') THEN 'part' ELSE 'whole' END"


@query(
    "overlap_dedup",
    f"""WITH k AS (SELECT *, {_KIND} AS kind FROM {_SP}),
pairs AS (SELECT w.span AS whole, p.span AS part FROM k w JOIN k p ON w.user_id = p.user_id AND p.s >= w.s AND p.e <= w.e WHERE w.kind = 'whole' AND p.kind = 'part'),
n AS (SELECT whole, count(*) AS n FROM pairs GROUP BY whole)
SELECT span FROM k WHERE span NOT IN (SELECT whole FROM n WHERE n >= 3) AND span NOT IN (SELECT part FROM pairs JOIN n USING (whole) WHERE n < 3)""",
)
def overlap_dedup(spark, sf):
    spans = _spans(spark, sf).withColumn("kind", F.when(F.col("event_type").isin("click", "view"), "part").otherwise("whole"))
    return graph.overlap_dedup(spans.drop("event_type"), "user_id").select("span")


@query("adjacent_expand", "SELECT c.conv_id, c.turn, min(abs(c.turn - h.turn)) AS distance FROM conversations c JOIN conversations h ON c.conv_id = h.conv_id AND abs(c.turn - h.turn) BETWEEN 1 AND 2 WHERE h.turn % 4 = 1 AND c.turn % 4 <> 1 GROUP BY c.conv_id, c.turn")
def adjacent_expand(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn")
    return graph.expand(rows, rows.filter("turn % 4 = 1"), "conv_id", "turn", 2)


@query("orphans", "SELECT doc_id AS node FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND (SELECT count(*) FROM documents) > 20 ORDER BY doc_id LIMIT 10")
def orphans(spark, sf):
    nodes = table(spark, sf, "documents").select(F.col("doc_id").alias("node"))
    return graph.orphans(nodes, table(spark, sf, "labels").select(F.col("doc_id").alias("dst")))


_TIER = "CASE WHEN p_name = 'widget' THEN 1 WHEN lower(p_name) = 'widget' THEN 2 WHEN ends_with(lower(p_name), 'widget') THEN 3 WHEN contains(lower(p_name), 'widget') THEN 4 END"


@query("resolve_cascade", f"SELECT p_partkey, p_name, {_TIER} AS tier FROM part WHERE {_TIER} = (SELECT min({_TIER}) FROM part)")
def resolve_cascade(spark, sf):
    return graph.resolve_name(table(spark, sf, "part"), "p_partkey", "p_name", "widget")


_MODS = "(SELECT DISTINCT replace(split_part(url, '/', 3), '-', '_') AS fqn FROM pages)"


@query(
    "import_resolution",
    f"""WITH m AS {_MODS}, i AS (SELECT page_id AS src, CASE page_id % 3 WHEN 0 THEN h WHEN 1 THEN regexp_replace(h, '^[^.]*\\.', '') ELSE split_part(h, '.', -1) END AS target FROM (SELECT page_id, replace(split_part(url, '/', 3), '-', '_') AS h FROM pages)),
suf AS (SELECT i.src, i.target, min(m.fqn) AS r2 FROM i JOIN m ON ends_with(m.fqn, '.' || i.target) GROUP BY i.src, i.target),
leaf AS (SELECT split_part(fqn, '.', -1) AS leaf, min(fqn) AS r3 FROM m GROUP BY 1 HAVING count(*) = 1)
SELECT i.src, i.target, coalesce(m.fqn, suf.r2, leaf.r3) AS resolved FROM i LEFT JOIN m ON m.fqn = i.target LEFT JOIN suf ON suf.src = i.src LEFT JOIN leaf ON leaf.leaf = split_part(i.target, '.', -1)""",
)
def import_resolution(spark, sf):
    host = F.replace(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("-"), F.lit("_"))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("src"), host.alias("h"))
    target = F.when(F.col("src") % 3 == 0, F.col("h")).when(F.col("src") % 3 == 1, F.regexp_replace("h", "^[^.]*\\.", "")).otherwise(F.element_at(F.split("h", "\\."), -1))
    return graph.resolve_imports(pages.select("src", target.alias("target")), pages.select(F.col("h").alias("fqn")).distinct())


@query("import_edges", "SELECT src, dst, kind FROM (SELECT l_partkey AS src, l_suppkey AS dst, l_shipmode AS kind, 1 AS n FROM (SELECT l_partkey, l_suppkey, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS l_shipmode FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY l_partkey, l_suppkey))")
def import_edges(spark, sf):
    given = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("resolved"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return graph.import_edges(given)


@query("telemetry_summary", "SELECT event_type, count(*) AS n, CAST(floor(round(avg(value), 9)) AS BIGINT) AS avg_value, round(round(sum(value) * 100 / (count(*) * 500.0), 6), 1) AS utilization FROM events GROUP BY event_type")
def telemetry_summary(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.floor(F.round(F.avg("value"), 9)).cast("long").alias("avg_value"), F.round(F.round(F.sum("value") * 100 / (F.count("*") * 500.0), 6), 1).alias("utilization"))


@query("retrieval_kpis", "SELECT event_type, count(*) AS n, CAST(round_even(quantile_cont(value, 0.5), 0) AS BIGINT) AS p50, CAST(round_even(quantile_cont(value, 0.95), 0) AS BIGINT) AS p95, CAST(round_even(avg(value), 0) AS BIGINT) AS avg_value, round(count(*) FILTER (value > 50) * 100 / count(*), 1) AS good_rate FROM events GROUP BY event_type")
def retrieval_kpis(spark, sf):
    return telemetry.kpis(table(spark, sf, "events"), "event_type", "value", F.col("value") > 50)


@query("index_percentile", "SELECT event_type, list_sort(list(value))[CAST(floor(0.95 * (count(*) - 1)) AS INT) + 1] AS p95 FROM events GROUP BY event_type")
def index_percentile(spark, sf):
    return telemetry.element_at_share(table(spark, sf, "events"), "event_type", "value", 0.95, "p95")


@query("burn_rate", "SELECT count(*) AS active_days, round(avg(total), 4) AS daily, round(avg(total) * 7, 4) AS weekly, round(avg(total) * 30, 4) AS monthly, round(avg(total) * 30 / 1000000 * 15, 6) AS monthly_cost FROM (SELECT CAST(ts AS DATE) AS day, sum(value) AS total FROM events GROUP BY 1)")
def burn_rate(spark, sf):
    got = telemetry.burn_rate(table(spark, sf, "events"), "ts", "value")
    return got.select("active_days", *[F.round(c, 4).alias(c) for c in ("daily", "weekly", "monthly")], F.round("monthly_cost", 6).alias("monthly_cost"))


@query("daily_usage", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 14")
def daily_usage(spark, sf):
    got = telemetry.daily(table(spark, sf, "events"), "ts", "value").orderBy(F.col("day").desc()).limit(14)
    return got.select(F.col("day").cast("string").alias("day"), F.round("total", 4).alias("total"), "n")


@query("hit_at_k", "WITH r AS (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)), b AS (SELECT source, min(CASE WHEN quality = 0 THEN rank END) AS best FROM r GROUP BY source) SELECT count(*) AS queries, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN best <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_3, round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5 FROM b")
def hit_at_k(spark, sf):
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(labels, "doc_id")
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")))
    got = telemetry.hit_at(ranked, "source", "rank", F.col("quality") == 0)
    return got.select("queries", *[F.round(f"hit_{k}", 6).alias(f"hit_{k}") for k in (1, 3, 5)])


@query("props_parse", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_parse(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("session_seen", "SELECT user_id, event_type, min(event_id) AS event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 GROUP BY user_id, event_type")
def session_seen(spark, sf):
    return state.first_seen(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id").select("user_id", "event_type", "event_id")


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query("session_dedup", f"SELECT event_id FROM events e WHERE ts >= TIMESTAMP '2024-01-20' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.ts < TIMESTAMP '2024-01-20' AND s.user_id = e.user_id AND s.event_type = e.event_type AND {_K.replace('props', 's.props')} = {_K.replace('props', 'e.props')})")
def session_dedup(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.from_json("props", "k long").getField("k"))
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    return state.unseen(e.filter(F.col("ts") >= cut), e.filter(F.col("ts") < cut), ["user_id", "event_type", "k"]).select("event_id")


@query("session_stats", "SELECT user_id, count(*) AS chunks_seen, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens_provided FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 GROUP BY user_id")
def session_stats(spark, sf):
    seen = state.first_seen(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id").withColumn("tokens", F.floor("value").cast("long"))
    return state.session_stats(seen, "user_id", "tokens")


@query("session_expiry", "SELECT user_id FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 4 HOUR")
def session_expiry(spark, sf):
    sessions = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_used"))
    return state.expired(sessions, "last_used", F.lit("2024-01-30 00:00:00").cast("timestamp")).select("user_id")


@query("debounce_bursts", "SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, burst")
def debounce_bursts(spark, sf):
    got = state.bursts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "90 minutes")
    return got.select("user_id", "n", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))


def _snapshots(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars", F.md5("text").alias("digest"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("digest", F.lit("x"))).otherwise(F.col("digest"))
    return docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 3 <> 0").withColumn("digest", changed)


_OLD = "(SELECT doc_id, source, n_chars, md5(text) AS digest FROM documents WHERE doc_id % 5 <> 0)"
_NEW = "(SELECT doc_id, source, n_chars, CASE WHEN doc_id % 7 = 0 THEN md5(text) || 'x' ELSE md5(text) END AS digest FROM documents WHERE doc_id % 3 <> 0)"


@query("snapshot_diff", f"SELECT doc_id, CASE WHEN o.digest IS NULL THEN 'added' WHEN n.digest IS NULL THEN 'removed' ELSE 'changed' END AS change FROM {_OLD} o FULL JOIN {_NEW} n USING (doc_id) WHERE o.digest IS DISTINCT FROM n.digest")
def snapshot_diff(spark, sf):
    return state.snapshot_diff(*_snapshots(spark, sf), "doc_id", "digest")


@query("incremental_refresh", f"SELECT doc_id, digest FROM {_OLD} WHERE doc_id NOT IN (SELECT doc_id FROM {_NEW} WHERE doc_id % 2 = 0) AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 11 = 0) UNION ALL SELECT doc_id, digest FROM {_NEW} WHERE doc_id % 2 = 0")
def incremental_refresh(spark, sf):
    old, new = _snapshots(spark, sf)
    gone = table(spark, sf, "documents").filter("doc_id % 11 = 0").select("doc_id")
    return state.replaced(old, new.filter("doc_id % 2 = 0"), "doc_id", gone).select("doc_id", "digest")


@query("structure_diff", f"SELECT source, coalesce(b.n, 0) - coalesce(a.n, 0) AS files, CAST(coalesce(b.c, 0) - coalesce(a.c, 0) AS BIGINT) AS chars FROM (SELECT source, count(*) AS n, sum(n_chars) AS c FROM {_OLD} GROUP BY source) a FULL JOIN (SELECT source, count(*) AS n, sum(n_chars) AS c FROM {_NEW} GROUP BY source) b USING (source)")
def structure_diff(spark, sf):
    return overview.structure_change(*_snapshots(spark, sf), "source", "n_chars").withColumnRenamed("size", "chars")


@query("memory_dedup", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS display_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def memory_dedup(spark, sf):
    notes = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.lit(0).cast("long").alias("display_id"))
    return state.inserted(notes.limit(0), notes, "digest", ["doc_id"]).select("doc_id", "display_id")


@query("memory_filters", "SELECT doc_id FROM documents WHERE doc_id % 9 <> 0 AND (doc_id % 4 = 3 OR doc_id % 50 > 25)")
def memory_filters(spark, sf):
    notes = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "blocked").otherwise("local_verified").alias("trust_level"), F.when(F.col("doc_id") % 4 == 3, None).otherwise((F.col("doc_id") % 50).cast("string")).alias("expires_at"))
    return state.visible(notes, F.lit(25.0)).select("doc_id")


@query("prior_lane", "SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, 0.45 / (1 + (doc_id % 100) / 30.0) + 0.25 * quality + 0.2 * 0.5 + 0.1 * least(doc_id % 40, 20) / 20.0 AS score FROM labels) ORDER BY round(score, 9) DESC, doc_id LIMIT 40")
def prior_lane(spark, sf):
    i = F.col("doc_id")
    s = fusion.prior_utility((i % 100).cast("double"), F.col("quality").cast("double"), F.lit(0.5), (i % 40).cast("double"))
    return fulltext.top(table(spark, sf, "labels").select("doc_id", s.alias("score")), "doc_id", 40).select("doc_id", F.round("score", 6).alias("score"))


@query("line_metrics", "WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, len(l) AS total_lines, len(list_filter(l, lambda x: trim(regexp_replace(x, '\\s', ' ', 'g')) = '')) AS blank_lines, len(list_filter(l, lambda x: regexp_matches(x, '^\\s*(#|//|/\\*)'))) AS comment_lines, " + "1 + " + " + ".join(f"CAST(floor((length(text) - length(replace(text, '{p}', ''))) / {len(p)}) AS BIGINT)" for p in T.BRANCHES) + " AS complexity FROM l")
def line_metrics(spark, sf):
    got = table(spark, sf, "documents").select("doc_id", T.line_metrics(F.col("text")).alias("m"))
    return got.select("doc_id", "m.total_lines", "m.blank_lines", "m.comment_lines", "m.complexity")


@query("quality_summary", "WITH l AS (SELECT source, n_chars, len(string_split(text, chr(10))) AS n FROM documents) SELECT source, count(*) AS files, CAST(sum(n) AS BIGINT) AS lines, round(avg(n), 6) AS avg_lines FROM l GROUP BY source")
def quality_summary(spark, sf):
    return overview.line_summary(table(spark, sf, "documents"), "source", "text").withColumn("avg_lines", F.round("avg_lines", 6))


@query("hot_docs", "WITH m AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, " + "1 + " + " + ".join(f"CAST(floor((length(text) - length(replace(text, '{p}', ''))) / {len(p)}) AS BIGINT)" for p in T.BRANCHES) + " AS c FROM documents) SELECT doc_id, CAST(0.5 * n + 2 * c AS DOUBLE) AS score FROM m ORDER BY score DESC, doc_id LIMIT 10")
def hot_docs(spark, sf):
    return overview.hot(table(spark, sf, "documents"), "doc_id", "text")


PATHS = ["src/a.py", "tests/test_a.py", "vendor/x/y.go", "web/node_modules/m.js", "lib/test_b.py", "gen/x.pb.go", "src/x_generated.ts", "app/conftest.py", "a/b_test.go", "dist/main.js", "docs/build.md", "src/testing/x.rs", "site-packages/q.py", ".venv3/z.py", "src/target/k.c", "README.md", "spec/a.rb", "x_pb2.py"]
_VALUES = ", ".join(f"('{p}')" for p in PATHS)


@query(
    "path_category",
    f"""SELECT path, CASE WHEN regexp_matches(path, '(^|/)(vendor|third_party|node_modules|\\.venv|venv|dist|build|\\.tox)(/|$)') THEN 'vendor'
WHEN regexp_matches(path, '_generated\\.|\\.pb\\.|_pb2\\.py$|^generated/|\\.auto\\.|_gen\\.') THEN 'generated'
WHEN regexp_matches(path, '(^|/)test_|_test\\.|(^|/)(tests|spec|__tests__|test)/|_spec\\.|(^|/)conftest\\.py$') THEN 'test' ELSE 'source' END AS category FROM (VALUES {_VALUES}) v(path)""",
)
def path_category(spark, sf):
    return spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", T.file_category(F.col("path")).alias("category"))


@query("path_filter", f"SELECT path, regexp_matches(lower(path), '(^|/)(\\.git|\\.lodestone|__pycache__|node_modules|site-packages|\\.next|\\.nuxt|\\.turbo|dist|build|target|\\.cache|\\.pytest_cache|\\.mypy_cache|\\.ruff_cache|\\.tox|\\.nox)(/|$)|(^|/)(\\.venv|venv)') AS excluded, CASE regexp_extract(path, '\\.[^./]*$') WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.rs' THEN 'rust' WHEN '.c' THEN 'c' WHEN '.rb' THEN 'ruby' END AS language FROM (VALUES {_VALUES}) v(path)")
def path_filter(spark, sf):
    p = F.col("path")
    return spark.createDataFrame([(x,) for x in PATHS], "path string").select("path", T.is_excluded(p).alias("excluded"), T.language(p).alias("language"))


@query("slugs", "SELECT conv_id, turn, CASE WHEN s = '' THEN 'na' ELSE s END AS slug FROM (SELECT conv_id, turn, substr(regexp_replace(regexp_replace(lower(trim(text, ' ')), '[^a-z0-9_.:-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) AS s FROM conversations)")
def slugs(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.slug(F.col("text")).alias("slug"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("query_terms", f"SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(text, '[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*(?:\\.[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*)*'), lambda t: lower(t) NOT IN ({_STOP})), ' ') AS terms FROM conversations WHERE role = 'user'")
def query_terms(spark, sf):
    kept = F.filter(T.query_tokens(F.col("text")), lambda t: ~T.is_stop_word(t))
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.array_join(kept, " ").alias("terms"))


@query("route_groups", "SELECT split_part(split_part(url, '?', 1), '/', 4) AS path, count(*) AS n, array_to_string(list_sort(list(page_id)), ',') AS pages FROM pages GROUP BY 1")
def route_groups(spark, sf):
    path = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("/"), F.lit(4))
    got = table(spark, sf, "pages").groupBy(path.alias("path")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("page_id")).alias("p"))
    return got.select("path", "n", F.array_join(F.col("p").cast("array<string>"), ",").alias("pages"))


@query("language_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 4")
def language_counts(spark, sf):
    return overview.counts(table(spark, sf, "documents"), "lang", 4)


@query("index_stats", "SELECT count(*) AS chunks, count(DISTINCT source) AS files, CAST(coalesce(sum(n_chars // 4), 0) AS BIGINT) AS tokens FROM documents")
def index_stats(spark, sf):
    return overview.index_stats(table(spark, sf, "documents"), "source", F.floor(F.col("n_chars") / 4))


@query("token_counts", "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(CAST(floor((length(text) // 4) * 1.1) AS BIGINT), 1) END AS tokens FROM documents")
def token_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text"), 1.1).alias("tokens"))


@query("trust_levels", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'system prompt') OR contains(lower(text), 'ignore all previous') THEN 'blocked' ELSE 'local_verified' END AS trust FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN text || ' System Prompt' ELSE text END AS text FROM conversations)")
def trust_levels(spark, sf):
    said = F.when(F.col("turn") % 5 == 0, F.concat("text", F.lit(" System Prompt"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.trust_level(said, F.lit("")).alias("trust"))

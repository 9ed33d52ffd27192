"""Retrieval in one piece: map (signatures), context (ranked, fused and packed chunks), deep (a function with its callers and
callees), and recall of notes.

chunks: key, chunk_name, file_path, chunk_type, start_line, end_line, signature, body. What a query returns is limited early,
so all that comes after the lanes is small.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import budget, fulltext, fusion, graph, lookup, vectors

#: Weights of a chunk's fields.
FIELDS = {"chunk_name": 5.0, "file_path": 5.0, "signature": 3.0, "body": 1.0}
#: The most candidates of a context.
CANDIDATES = 120


def plan(spark: SparkSession, query: str):
    """The query's terms, identifiers, kind and so on, as a Row."""
    return spark.range(1).select(T.query_plan(F.lit(query)).alias("p")).first()["p"]


def search(chunks: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """key and score: lanes of any term (1), of all terms (2) and of exact identifiers (3), fused; a lane without rows counts
    for nothing, and if only one has rows, its own scores stand."""
    p = plan(chunks.sparkSession, query)
    either = fulltext.top(fulltext.bm25(chunks, "key", FIELDS, p["search_terms"]), "key", 3 * limit)
    both = fulltext.top(fulltext.bm25(chunks, "key", FIELDS, p["search_terms"], every=True), "key", 2 * limit)
    exact = fulltext.exact_lane(chunks, "key", "chunk_name", "file_path", p["identifiers"], limit)
    return fulltext.top(_fuse({"or": (either, 1.0), "and": (both, 2.0), "exact": (exact, 3.0)}), "key", limit)


def _fuse(lanes: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """Lanes fused by rank, or the scores of the only one that has rows. Lanes are limited, and each is read once."""
    parts = [lane.select(F.lit(name).alias("lane"), F.lit(weight).alias("weight"), "key", "score") for name, (lane, weight) in lanes.items()]
    best = reduce(DataFrame.unionByName, parts).groupBy("lane", "weight", "key").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lane").orderBy(F.round("score", 9).desc(), "key"))
    lanes_met = F.size(F.collect_set("lane").over(Window.partitionBy(F.lit(1))))
    each = best.withColumn("rank", rank).withColumn("lanes", lanes_met).groupBy("key").agg(F.sum(F.col("weight") / (fusion.K + F.col("rank"))).alias("fused"), F.max("score").alias("own"), F.first("lanes").alias("lanes"))
    return each.select("key", F.when(F.col("lanes") == 1, F.col("own")).otherwise(F.col("fused")).alias("score"))


matching_files = lookup.matching_files


def signatures(chunks: DataFrame, query: str, limit: int = 20, kind: str | None = None) -> DataFrame:
    """The map: key, score, signature and the hint of a docstring. A type filter comes after the search, which then goes
    three times as far."""
    found = search(chunks, query, limit * 3 if kind else limit)
    out = found.join(chunks, "key")
    if kind:
        out = out.filter(F.col("chunk_type") == kind)
    return fulltext.top(out.select("key", "score", "chunk_name", "signature", T.docstring_hint(F.col("body")).alias("hint")), "key", limit)


@dataclass
class Options:
    budget: int = 8000
    include_tests: bool = True
    importance: DataFrame | None = None  # key, importance
    recency: DataFrame | None = None  # file_path, age_days
    edges: DataFrame | None = None  # src, dst: keys
    refs: DataFrame | None = None  # file_path, ref_name, containing_chunk
    modules: DataFrame | None = None  # src, dst: modules that import
    similar: DataFrame | None = None  # key, vector
    vector: list[float] | None = None
    seen: DataFrame | None = None  # keys that the session has had
    patterns: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)


def candidates(chunks: DataFrame, query: str, o: Options) -> DataFrame:
    """key and score of the lexical lane (3), the graph lane (2) and the semantic lane (2), fused. Without a lexical hit there
    is nothing."""
    lexical = search(chunks, query, CANDIDATES)
    lanes = {"lexical": (lexical, 3.0)}
    if o.refs is not None:
        seeds = lexical.orderBy(F.col("score").desc(), "key").limit(12).join(chunks, "key").select("key", "chunk_name", "file_path", "score")
        lanes["graph"] = (graph.name_lane(seeds, o.refs, chunks, o.modules), 2.0)
    elif o.edges is not None:
        lanes["graph"] = (graph.graph_lane(o.edges, lexical).join(chunks, "key", "left_semi"), 2.0)
    if o.similar is not None and o.vector:
        near = lexical.select("key").unionByName(lanes["graph"][0].select("key")).distinct() if "graph" in lanes else lexical.select("key")
        lanes["semantic"] = (vectors.cosine(o.similar.join(near, "key", "left_semi"), "key", "vector", o.vector), 2.0)
    return fulltext.top(_fuse(lanes), "key", CANDIDATES)


def modified(found: DataFrame, query: str, terms: list[str], o: Options) -> DataFrame:
    """Scores after category, importance, recency, path and intent, in this order. found: chunks' columns and score."""
    out = found.withColumn("score", F.col("score") * T.demotion(T.file_category(F.col("file_path")), query))
    if o.importance is not None:
        out = out.join(o.importance.select("key", "importance"), "key", "left").withColumn("score", fusion.importance_boost(F.col("score"), F.col("importance"))).drop("importance")
    if o.recency is not None:
        out = out.join(o.recency.groupBy("file_path").agg(F.min("age_days").alias("age")), "file_path", "left").withColumn("score", fusion.recency_boost(F.col("score"), F.col("age"))).drop("age")
    out = out.withColumn("score", fusion.path_boost(F.col("score"), F.col("file_path"), terms))
    return out.withColumn("score", F.col("score") * fusion.intent_factor(F.col("file_path"), F.col("body"), fusion.domain_intent(F.lit(query))))


def _filtered(rows: DataFrame, o: Options) -> DataFrame:
    any_of = lambda ps: F.array(*[F.col("file_path").rlike(T.glob(p)) for p in ps])
    if o.patterns:
        rows = rows.filter(F.exists(any_of(o.patterns), lambda x: x))
    if o.excluded:
        rows = rows.filter(~F.exists(any_of(o.excluded), lambda x: x))
    if o.kinds:
        rows = rows.filter(F.col("chunk_type").isin(o.kinds))
    return rows if o.include_tests else rows.filter(T.file_category(F.col("file_path")) != "test")


def context(chunks: DataFrame, query: str, o: Options | None = None) -> DataFrame:
    """key, score, tokens, used and slot of the chunks for a prompt: candidates, score modifiers, filters, the relevance
    floor, what the session had left out, then the code's share of the budget filled greedily, and packed."""
    o = o or Options()
    p = plan(chunks.sparkSession, query)
    found = candidates(chunks, query, o).join(chunks, "key")
    ranked = _filtered(modified(found, query, p["search_terms"], o), o)
    # The candidates are limited: a window over all of them spares reading them again for their maximum.
    best = F.max("score").over(Window.partitionBy(F.lit(1)))
    ranked = ranked.withColumn("best", best).filter((F.col("best") <= 0) | (F.col("score") >= 0.3 * F.col("best"))).drop("best")
    if o.seen is not None:
        ranked = ranked.join(o.seen.select("key"), "key", "left_anti")
    share = budget.SPLITS[p["query_type"]]
    code = int(o.budget * (share[0] + (0 if o.edges is not None else share[1])))
    sized = ranked.withColumn("tokens", T.token_count(F.col("body"))).withColumn("q", F.lit(1)).withColumn("score", F.round("score", 9))
    packed = budget.greedy_fill(sized, "q", [-F.col("score"), F.col("key")], "key", "tokens", code, ["score"]).drop("q")
    into = F.lit(0)
    if o.edges is not None:
        packed = packed.join(o.edges.groupBy(F.col("dst").alias("key")).agg(F.countDistinct("src").alias("into")), "key", "left")
        into = F.coalesce(F.col("into"), F.lit(0))
    out = fusion.prompt_order(packed, "key", F.col("score"), into, F.col("tokens"))
    return out.select("key", "score", "tokens", "used", "slot")


def deep(chunks: DataFrame, refs: DataFrame, name: str, tokens: int = 3000, include_tests: bool = False) -> DataFrame:
    """role (target, callee, caller, overflow), key and tokens. The target is the one chunk that name means; half of the
    budget is its own at most, and callees and callers share the rest, those of its file and short ones first. If name may
    mean several, these come back with the role ambiguous and nothing else does.

    refs: file_path, ref_name, containing_chunk.
    """
    meant = graph.resolve_symbol(chunks, name, include_tests).select("key", F.count("*").over(Window.partitionBy(F.lit(1))).alias("n"))
    hit = chunks.join(F.broadcast(meant), "key")
    ambiguous = hit.filter("n > 1").select(F.lit("ambiguous").alias("role"), "key", T.token_count(F.col("body")).alias("tokens"))
    target = hit.filter("n = 1").select("key", "chunk_name", "file_path", F.least(T.token_count(F.col("body")), F.lit(tokens // 2)).alias("tokens"))
    leaf = lambda c: F.element_at(F.split(c, "\\."), -1)
    t = F.broadcast(target.select(F.col("key").alias("t_key"), F.col("chunk_name").alias("t_name"), F.col("file_path").alias("t_file"), F.col("tokens").alias("t_tokens")))
    called = refs.join(t, (F.col("containing_chunk") == F.col("t_name")) & (F.col("file_path") == F.col("t_file"))).select("t_key", "t_file", "t_tokens", F.col("ref_name").alias("name")).distinct()
    down = called.join(chunks.withColumn("name", leaf(F.col("chunk_name"))), "name").withColumn("role", F.lit("callee"))
    calling = refs.join(t, F.col("ref_name") == leaf(F.col("t_name"))).select("t_key", "t_file", "t_tokens", "file_path", F.col("containing_chunk").alias("chunk_name")).distinct()
    up = calling.join(chunks, ["file_path", "chunk_name"]).withColumn("role", F.lit("caller"))
    near = down.select("role", "key", "t_key", "t_file", "t_tokens", "file_path", "body").unionByName(up.select("role", "key", "t_key", "t_file", "t_tokens", "file_path", "body"))
    near = near.filter("key <> t_key").dropDuplicates(["role", "key"]).withColumn("tokens", T.token_count(F.col("body")))
    first: list[Column] = [F.when(F.col("file_path") == F.col("t_file"), 0).otherwise(1), F.col("tokens"), F.col("key")]
    sized = near.withColumn("limit", F.floor((tokens - F.col("t_tokens")) / 2).cast("long")).withColumn("n", F.row_number().over(Window.partitionBy("role").orderBy(*first))).filter("n <= 30")
    filled = budget.greedy_fill(sized, "role", first, "key", "tokens", "limit").drop("used")
    over = sized.join(filled, ["role", "key"], "left_anti").select(F.concat("role", F.lit("_overflow")).alias("role"), "key", "tokens")
    return target.select(F.lit("target").alias("role"), "key", "tokens").unionByName(filled.select("role", "key", "tokens")).unionByName(over).unionByName(ambiguous)


def recall(notes: DataFrame, query: str, as_of: float, k: int = 5, vector: list[float] | None = None) -> DataFrame:
    """key and score of notes: lanes of full text (3), vectors (2), word overlap (1) and prior utility (1), fused, then
    without blocked and expired notes. notes: key, content, tags, quality, confidence, accesses, created_at, trust_level,
    expires_at and, for the vector lane, vector."""
    from .state import visible

    limit = max(20, 6 * k)
    asked = list(dict.fromkeys(fulltext.phrase(query)))
    over = notes.select("key", fulltext.overlap_score(F.col("content"), asked or [""]).alias("score")).filter("score > 0")
    prior = notes.select("key", fusion.prior_utility((F.lit(as_of) - F.col("created_at")) / 86400.0, F.col("quality"), F.col("confidence"), F.col("accesses").cast("double")).alias("score"))
    lanes = {"text": (fulltext.top(fulltext.bm25(notes, "key", {"content": 1.0, "tags": 1.0}, asked), "key", limit), 3.0), "overlap": (fulltext.top(over, "key", limit), 1.0), "prior": (fulltext.top(prior, "key", limit), 1.0)}
    if vector:
        lanes["vector"] = (fulltext.top(vectors.cosine(notes, "key", "vector", vector), "key", limit), 2.0)
    fused = fusion.reciprocal_rank_fusion(lanes, "key")
    kept = visible(notes.select("key", "trust_level", "expires_at"), F.lit(as_of)).select("key")
    return fulltext.top(fused.join(kept, "key", "left_semi"), "key", k)


def expanded(chunks: DataFrame, picked: DataFrame, tokens: int, include_tests: bool = True, reach: int = 10) -> DataFrame:
    """key, tokens, used and why (module, header, near) of what stands beside a context's chunks: their files' module chunks,
    the first five lines of their methods' classes, and chunks within `reach` lines, as they fit. Tests are left out
    here once more: what is beside may be one. picked: key."""
    have = chunks.join(F.broadcast(picked.select("key")), "key").select("key", "file_path", "chunk_name", "chunk_type", "start_line", "end_line")
    h = F.broadcast(have.select("file_path", F.col("key").alias("h_key"), F.col("chunk_name").alias("h_name"), F.col("chunk_type").alias("h_type"), F.col("start_line").alias("h_start"), F.col("end_line").alias("h_end")))
    beside = chunks.join(h, "file_path").filter(F.col("key") != F.col("h_key"))
    owner = (F.col("chunk_type") == "class") & (F.col("h_type") == "method") & F.col("h_name").startswith(F.concat("chunk_name", F.lit(".")))
    close = F.least(F.abs(F.col("start_line") - F.col("h_end")), F.abs(F.col("h_start") - F.col("end_line"))) <= reach
    why = F.when(F.col("chunk_type") == "module", 0).when(owner, 1).when(close, 2)
    body = F.when(F.col("why") == 1, F.array_join(F.slice(F.split("body", "\n", -1), 1, 5), "\n")).otherwise(F.col("body"))
    found = beside.withColumn("why", why).filter("why is not null").groupBy("key").agg(F.min("why").alias("why")).join(picked.select("key"), "key", "left_anti").join(chunks, "key")
    if not include_tests:
        found = found.filter(T.file_category(F.col("file_path")) != "test")
    sized = found.withColumn("tokens", T.token_count(body)).withColumn("q", F.lit(1)).withColumn("name", F.element_at(F.array(F.lit("module"), F.lit("header"), F.lit("near")), F.col("why") + 1))
    got = budget.greedy_fill(sized, "q", [F.col("why"), F.col("file_path"), F.col("start_line"), F.col("key")], "key", "tokens", tokens, ["name"])
    return got.select("key", "tokens", "used", F.col("name").alias("why"))


def workflow(chunks: DataFrame, refs: DataFrame, query: str, o: Options | None = None, map_limit: int = 20, deep_tokens: int = 3000) -> dict[str, DataFrame]:
    """The map, the context, and deep for the context's best function, method or class, or the map's best chunk (one row picks
    it)."""
    ctx, listed = context(chunks, query, o), signatures(chunks, query, map_limit)
    facts = chunks.select("key", "chunk_name", "file_path", "chunk_type")
    best = lookup.deep_target(ctx.select("key", "slot").join(facts, "key"), listed.select("key", "score").join(facts, "key")).first()
    out = {"map": listed, "context": ctx}
    return out | ({"deep": deep(chunks, refs, f"{best['file_path']}:{best['chunk_name']}", deep_tokens, include_tests=True)} if best else {})

"""The engine's methods in one place: tables of chunks, references, edges, notes and events, and what can be asked of them.

Every method gives a DataFrame (or a dict of them); `dispatch` takes a method's name and its parameters from outside and
checks those that shape resources.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.checks import MAX_RESULTS, MAX_TOKENS, bounded
from .operators import fulltext, graph, lookup, modules, notes, overview, postings, prompt, retrieval, state, telemetry

NOTE = "key string, display_id long, content string, tags string, source_type string, memory_type string, decision_status string, session_id string, confidence double, quality double, accesses long, evidence string, agent string, trust_level string, created_at double, resolved_at double, expires_at string"
SEEN = "session_id string, key string, at double, tokens long"
EVENT = "event_type string, query string, budget long, tokens_used long, duration_ms double, created_at double"


@dataclass
class Engine:
    """chunks: key, chunk_name, file_path, chunk_type, start_line, end_line, signature, body. refs: file_path, ref_name,
    containing_chunk. imports: src, dst (modules). What changes gives a new engine; nothing is changed in place."""

    spark: SparkSession
    chunks: DataFrame
    refs: DataFrame
    imports: DataFrame
    notes: DataFrame
    seen: DataFrame
    events: DataFrame
    index: postings.Index | None = None
    options: retrieval.Options = field(default_factory=retrieval.Options)

    @classmethod
    def over(cls, chunks: DataFrame, refs: DataFrame, imports: DataFrame, **more) -> Engine:
        spark = chunks.sparkSession
        empty = {"notes": NOTE, "seen": SEEN, "events": EVENT}
        return cls(spark, chunks, refs, imports, **{k: more.pop(k, None) or spark.createDataFrame([], s) for k, s in empty.items()}, **more)

    # Search

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """key and score; with an index, the lanes of terms read it."""
        if self.index is None:
            return retrieval.search(self.chunks, query, limit)
        p = retrieval.plan(self.spark, query)
        either = fulltext.top(postings.bm25(self.index, p["search_terms"]), "key", 3 * limit)
        both = fulltext.top(postings.bm25(self.index, p["search_terms"], every=True), "key", 2 * limit)
        exact = fulltext.exact_lane(self.chunks, "key", "chunk_name", "file_path", p["identifiers"], limit)
        return fulltext.top(retrieval._fuse({"or": (either, 1.0), "and": (both, 2.0), "exact": (exact, 3.0)}), "key", limit)

    def grep(self, patterns: list[str], limit: int = 20) -> DataFrame:
        """file_path, hits and tokens: how often the patterns occur in a file's chunks, whatever the case."""
        return overview.grep(self.chunks, "file_path", "body", patterns, T.token_count(F.col("body")), limit)

    def map(self, query: str, limit: int = 20, kind: str | None = None) -> DataFrame:
        return retrieval.signatures(self.chunks, query, limit, kind)

    def signatures(self, path: str | None = None) -> DataFrame:
        return lookup.signatures(self.chunks, path)

    def nearest(self, query: str, limit: int = 10) -> dict[str, DataFrame]:
        """For a search without results: terms that begin alike, and files whose path has a word of it."""
        vocab = postings.vocabulary(self.index) if self.index else fulltext.vocabulary(self.chunks, "key", "body")
        return {"nearest_terms": fulltext.nearest_terms(vocab, query.split(), limit), "files": lookup.matching_files(self.chunks, query)}

    # Context

    def context(self, query: str, budget: int = 8000, session: str | None = None, include_tests: bool = True) -> DataFrame:
        o = replace(self.options, budget=budget, include_tests=include_tests, refs=self.refs, modules=self.imports)
        if session:
            o = replace(o, seen=self.seen.filter(F.col("session_id") == session).select("key"))
        return retrieval.context(self.chunks, query, o)

    def given(self, session: str, context: DataFrame, at: float | None = None) -> Engine:
        """The engine after a session was given a context."""
        now = time.time() if at is None else at
        rows = context.select(F.lit(session).alias("session_id"), "key", F.lit(float(now)).alias("at"), F.col("tokens").cast("long").alias("tokens"))
        return replace(self, seen=state.first_seen(self.seen.unionByName(rows), "session_id", "key", "at", "tokens"))

    def beside(self, context: DataFrame, tokens: int, include_tests: bool = True) -> dict[str, DataFrame]:
        """What stands beside a context: chunks near its own, signatures of what its files import, summaries, and what its
        files import and are imported by."""
        files = self.chunks.join(F.broadcast(context.select("key")), "key").select(F.col("file_path").alias("path")).distinct()
        return {
            "expanded": retrieval.expanded(self.chunks, context, tokens, include_tests),
            "dependencies": prompt.dependency_signatures(files, self.imports, self.chunks, tokens, include_tests),
            "summaries": prompt.file_summaries(files, self.chunks, tokens),
            "related": modules.bundle(files, self.imports),
        }

    def deep(self, name: str, budget: int = 3000, include_tests: bool = False) -> DataFrame:
        return retrieval.deep(self.chunks, self.refs, name, budget, include_tests)

    def workflow(self, query: str, budget: int = 8000, limit: int = 20, deep_budget: int = 3000) -> dict[str, DataFrame]:
        o = replace(self.options, budget=budget, refs=self.refs, modules=self.imports)
        return retrieval.workflow(self.chunks, self.refs, query, o, limit, deep_budget)

    # Graph

    def callers(self, name: str, limit: int = 50) -> DataFrame:
        hit = F.col("ref_name") == name
        return self.refs.filter(hit).select("file_path", "containing_chunk").distinct().orderBy("file_path", "containing_chunk").limit(limit)

    def callees(self, name: str, limit: int = 50) -> DataFrame:
        return self.refs.filter(F.col("containing_chunk") == name).select("file_path", "ref_name").distinct().orderBy("file_path", "ref_name").limit(limit)

    def related(self, name: str) -> DataFrame:
        """way and node of a module, asked for by its file, its name or the last part of that."""
        module = name[:-3].replace("/", ".") if name.endswith(".py") else name
        return graph.neighbours_of(self.imports, module)

    def next_files(self, query: str, limit: int = 5) -> DataFrame:
        """Files in the order in which to read them for a query, tests after others."""
        found = self.search(query, 20 * limit).join(self.chunks, "key").groupBy("file_path").agg(F.max("score").alias("score"))
        return found.orderBy(T.file_category(F.col("file_path")) == "test", F.round("score", 9).desc(), "file_path").limit(limit)

    # Notes

    def remember(self, content: str, tags: str = "", kind: str = "note", at: float | None = None, session: str = "", agent: str = "", trust: str = "", expires_at: str | None = None, source: str = "manual") -> Engine:
        """The engine with a note more, unless one has the same content; a suspicious one is kept but blocked."""
        now = time.time() if at is None else at
        said = self.spark.createDataFrame([(content, tags, kind, float(now), session, agent, trust, expires_at, source)], "content string, tags string, memory_type string, created_at double, session_id string, agent string, trust string, expires_at string, source_type string")
        note = said.select(
            F.sha2("content", 256).alias("key"), F.lit(0).cast("long").alias("display_id"), "content", "tags", "source_type", "memory_type", F.lit("active").alias("decision_status"), "session_id", F.lit(0.7).alias("confidence"), F.lit(1.0).alias("quality"),
            F.lit(0).cast("long").alias("accesses"), F.lit("").alias("evidence"), "agent", T.trust_level(F.col("content"), F.col("trust")).alias("trust_level"), "created_at", F.lit(None).cast("double").alias("resolved_at"), "expires_at",
        )
        return replace(self, notes=state.inserted(self.notes, note, "key", ["created_at", "key"]))

    def decide(self, query: str, target: str, files: list[str], at: float | None = None, **more) -> Engine:
        """The engine with a workflow's decision as a note, once."""
        now = time.time() if at is None else at
        made = notes.decision(query, target, files, now, **more)
        return self if made is None else replace(self, notes=notes.captured(self.notes, made | {"key": f"decision-{now}", "quality": 1.0, "accesses": 0, "expires_at": str(made["expires_at"])}, now))

    def recall(self, query: str, limit: int = 5, at: float | None = None) -> DataFrame:
        return retrieval.recall(self.notes, query, time.time() if at is None else at, limit)

    def memories(self, **filters) -> DataFrame:
        return notes.listed(self.notes, **filters)

    def forget(self, number: int) -> Engine:
        return replace(self, notes=notes.forget(self.notes, number))

    def resolve(self, number: int, status: str = "resolved", at: float | None = None) -> Engine:
        return replace(self, notes=state.resolved(self.notes, "display_id", number, status, time.time() if at is None else at))

    # Upkeep

    def reindex(self, fresh: DataFrame, refs: DataFrame, gone: DataFrame | None = None, index: str | None = None, weights: dict[str, float] | None = None) -> Engine:
        """The engine after files were read anew (fresh and refs have all their rows) or are gone (file_path); with a folder,
        its index is written there."""
        chunks = state.replaced(self.chunks, fresh, "file_path", gone)
        kept = state.replaced(self.refs, refs, "file_path", gone)
        out = replace(self, chunks=chunks, refs=kept)
        if index:
            postings.save(postings.build(chunks, "key", weights or retrieval.FIELDS), index)
            out = replace(out, index=postings.load(self.spark, index, "key"))
        return out

    def status(self) -> DataFrame:
        """One row: chunks, files, tokens, references, imports and notes."""
        one = self.chunks.agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.coalesce(F.sum(T.token_count(F.col("body"))), F.lit(0)).alias("tokens"))
        for name, rows in (("refs", self.refs), ("imports", self.imports), ("notes", self.notes)):
            one = one.crossJoin(F.broadcast(rows.agg(F.count("*").alias(name))))
        return one

    def stats(self) -> dict[str, DataFrame]:
        """What the recorded events say."""
        return {"by_type": telemetry.rates(self.events, "event_type"), "burn_rate": telemetry.burn_rate(self.events.withColumn("at", F.timestamp_seconds("created_at")), "at", "tokens_used")}

    def record(self, kind: str, query: str, budget: int, used: int, ms: float, at: float | None = None) -> Engine:
        row = self.spark.createDataFrame([(kind, query, budget, used, float(ms), float(time.time() if at is None else at))], EVENT)
        return replace(self, events=self.events.unionByName(row))

    def structure(self) -> DataFrame:
        """module, path, functions and classes of each file."""
        kind = F.col("chunk_type")
        rows = self.chunks.groupBy(F.col("file_path").alias("path")).agg(F.count_if(kind.isin("function", "method")).alias("functions"), F.count_if(kind == "class").alias("classes"))
        return rows.select(modules.module_name(F.col("path")).alias("module"), "path", "functions", "classes")

    def explain(self, name: str) -> DataFrame:
        return modules.find_components(self.structure(), self.chunks, name)

    def diagram(self) -> str:
        return prompt.mermaid(modules.diagram_nodes(self.structure(), self.imports), self.imports)

    def digest(self, project: str = "project") -> str:
        whole = modules.structure(self.structure()).first()
        return prompt.system_document(project, {"Modules": whole["modules"], "Functions": whole["functions"], "Classes": whole["classes"]}, self.structure(), whole["modules"])

    def onboard(self, project: str = "project", budget: int = 2000) -> str:
        """The document that a session starts with."""
        s = self.status().first()
        head = [f"# {project}", "", f"**Files:** {s['files']} | **Chunks:** {s['chunks']} | **Tokens:** {s['tokens']:,}"]
        return prompt.session_document(head, self.signatures(), state.visible(notes.listed(self.notes), F.lit(time.time())), budget)

    # From outside

    METHODS = ("search", "context", "workflow", "signatures", "related", "remember", "recall", "reindex", "status", "callers", "callees", "map", "deep")

    def dispatch(self, method: str, params: dict):
        """A method by name. Limits and budgets must be whole numbers within bounds, and other parameters are passed on."""
        if method not in self.METHODS:
            raise ValueError(f"Unknown method: {method}")
        for name, most in (("limit", MAX_RESULTS), ("budget", MAX_TOKENS), ("deep_budget", MAX_TOKENS)):
            if name in params:
                bounded(name, params[name], most)
        return getattr(self, method)(**params)

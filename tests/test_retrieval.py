import pytest
from pyspark.sql import functions as F

from lodestone.operators import budget, fulltext, fusion, graph, retrieval, state, telemetry, vectors
from lodestone.sources import code

SOURCES = {
    "app/auth.py": '''import os
from db import store as st

LIMIT = 5


def verify_session(token):
    """Checks a session token."""
    return st(token) and check(token)


def check(token):
    return len(token) > LIMIT


class Auth:
    """Guards."""

    def login(self, user):
        return verify_session(user)
''',
    "app/db.py": 'def store(x):\n    """Keeps x."""\n    return x\n',
    "tests/test_auth.py": "from app.auth import verify_session\n\n\ndef test_verify_session():\n    assert verify_session('token')\n",
    "web/page.ts": "import {a} from './lib'\nexport function render(user) {\n  return show(user)\n}\nclass Page {\n}\n",
    "main.go": 'package main\nimport "fmt"\nfunc main() {\n\tfmt.Println(run())\n}\nfunc run() int {\n\treturn 1\n}\n',
    "lib.rb": "class Tool\n  def go\n    work(1)\n  end\nend\n",
    "bad.py": "def broken(:\n",
}


@pytest.fixture(scope="module")
def sources(spark):
    from lodestone.functions.text import language

    df = spark.createDataFrame(list(SOURCES.items()), "file_path string, text string")
    return df.withColumn("language", language(F.col("file_path")))


@pytest.fixture(scope="module")
def chunks(sources):
    return code.chunks(sources).withColumn("key", F.concat_ws(":", "file_path", "chunk_name", "start_line")).cache()


def test_chunks(chunks):
    got = {(r.file_path, r.chunk_name): r for r in chunks.collect()}
    assert {n for p, n in got if p == "app/auth.py"} == {"LIMIT", "verify_session", "check", "Auth", "Auth.login"}
    assert got["app/auth.py", "Auth.login"].chunk_type == "method"
    assert got["app/auth.py", "Auth.login"].signature == "Auth.login(self, user)"
    assert got["bad.py", "bad"].chunk_type == "module"
    assert (got["web/page.ts", "render"].start_line, got["web/page.ts", "render"].end_line) == (2, 4)
    assert (got["main.go", "run"].start_line, got["main.go", "run"].end_line) == (6, 8)
    assert got["lib.rb", "Tool"].end_line == 5


def test_refs_and_imports(sources):
    refs = {(r.file_path, r.ref_name, r.containing_chunk) for r in code.call_refs(sources).collect()}
    assert {("app/auth.py", "store", "verify_session"), ("app/auth.py", "check", "verify_session"), ("app/auth.py", "verify_session", "Auth.login"), ("web/page.ts", "show", "render"), ("main.go", "run", "main"), ("lib.rb", "work", "go")} <= refs
    imports = {(r.file_path, r.target, r.import_type) for r in code.imports(sources).collect()}
    assert {("app/auth.py", "os", "import"), ("app/auth.py", "db", "from"), ("web/page.ts", "./lib", "import"), ("main.go", "fmt", "import")} <= imports


def test_files(spark, tmp_path):
    (tmp_path / "a" / "node_modules").mkdir(parents=True)
    for p in ("a/x.py", "a/node_modules/y.js", "a/z.txt"):
        (tmp_path / p).write_text("x = 1\n")
    assert [(r.file_path, r.language) for r in code.files(spark, str(tmp_path)).collect()] == [("a/x.py", "python")]


def test_routes(spark):
    text = "@app.get('/a')\ndef a(): pass\n\n@app.route()\ndef b(): pass\n"
    df = spark.createDataFrame([("r.py", "python", text)], "file_path string, language string, text string")
    assert [(r.method, r.path, r.handler) for r in code.routes(df).collect()] == [("GET", "/a", "a"), ("GET", "/", "b")]


def test_search_finds_by_name(chunks):
    top = retrieval.search(chunks, "where is verify_session").first()
    assert top.key.startswith(("app/auth.py:verify_session", "tests/test_auth.py:test_verify_session"))
    assert retrieval.search(chunks, "zzz qqq").count() == 0


def test_context(chunks):
    got = retrieval.context(chunks, "session token check", retrieval.Options(budget=120)).collect()
    assert got and sum(r.tokens for r in got) <= 120 and sorted(r.slot for r in got) == list(range(len(got)))
    seen = chunks.filter(F.col("key").isin([r.key for r in got]))
    again = retrieval.context(chunks, "session token check", retrieval.Options(budget=120, seen=seen)).collect()
    assert not {r.key for r in got} & {r.key for r in again}
    no_tests = retrieval.context(chunks, "verify session", retrieval.Options(include_tests=False)).collect()
    assert no_tests and not any("tests/" in r.key for r in no_tests)


def test_deep_and_workflow(chunks, sources):
    refs = code.call_refs(sources)
    got = {(r.role, r.key.split(":")[1]) for r in retrieval.deep(chunks, refs, "verify_session", 3000).collect()}
    assert ("target", "verify_session") in got and {("callee", "check"), ("callee", "store"), ("caller", "Auth.login"), ("caller", "test_verify_session")} <= got
    small = retrieval.deep(chunks, refs, "verify_session", 40).collect()
    assert sum(r.tokens for r in small if "overflow" not in r.role) <= 40 and any("overflow" in r.role for r in small)
    out = retrieval.workflow(chunks, refs, "session token")
    assert set(out) == {"map", "context", "deep"} and out["map"].count() > 0


def test_recall(spark):
    rows = [("a", "use postgres for sessions", "db", 1.0, 0.9, 3, 0.0, "local_verified", None), ("b", "use redis for caching", "", 1.0, 0.5, 0, 0.0, "local_verified", None), ("c", "sessions in postgres are blocked", "", 1.0, 0.5, 0, 0.0, "blocked", None), ("d", "postgres sessions expired", "", 1.0, 0.5, 0, 0.0, "local_verified", "5")]
    notes = spark.createDataFrame(rows, "key string, content string, tags string, quality double, confidence double, accesses long, created_at double, trust_level string, expires_at string")
    got = [r.key for r in retrieval.recall(notes, "postgres sessions", as_of=10.0).collect()]
    assert got[0] == "a" and set(got) == {"a", "b"}


def test_fusion(spark):
    lane = lambda *x: spark.createDataFrame(list(x), "key string, score double")
    got = {r.key: r.score for r in fusion.reciprocal_rank_fusion({"x": (lane(("a", 3.0), ("b", 2.0), ("a", 1.0)), 1.0), "y": (lane(("b", 9.0)), 2.0)}, "key").collect()}
    assert got == {"a": pytest.approx(1 / 61), "b": pytest.approx(1 / 62 + 2 / 61)}
    with pytest.raises(ValueError, match="positive"):
        fusion.reciprocal_rank_fusion({"x": (lane(("a", 1.0)), 1.0)}, "key", 0)
    assert fusion.relevance_floor(lane(("a", 1.0), ("b", 0.29), ("c", 0.3))).count() == 2
    assert fusion.relevance_floor(lane(("a", 0.0), ("b", -1.0))).count() == 2


def test_greedy_skips_and_prefix_stops(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([5, 9, 3, 2])], "q int, i int, t int")
    assert [r.i for r in budget.greedy_fill(df, "q", [F.col("i")], "i", "t", 10).orderBy("used").collect()] == [0, 2, 3]
    assert [r.i for r in budget.prefix_fill(df, "q", [F.col("i")], "t", 10).collect()] == [0]


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "b"), ("a", "c")], "src string, dst string")
    assert {r.node: round(r.score, 3) for r in graph.importance(e).collect()} == {"b": 1.0, "c": 0.333}
    spans = spark.createDataFrame([("f", "A", "whole", 1, 50), ("f", "m1", "part", 2, 5), ("f", "m2", "part", 6, 9), ("f", "m3", "part", 10, 12), ("f", "B", "whole", 60, 90), ("f", "n1", "part", 61, 62)], "file string, span string, kind string, start int, end int")
    assert {r.span for r in graph.overlap_dedup(spans, "file").collect()} == {"m1", "m2", "m3", "B"}
    m = spark.createDataFrame([("pkg.auth.core",), ("pkg.db",), ("lib.db2",)], "fqn string")
    i = spark.createDataFrame([("x", "pkg.db"), ("x", "auth.core"), ("x", "y.db2"), ("x", "none")], "src string, target string")
    assert {r.target: r.resolved for r in graph.resolve_imports(i, m).collect()} == {"pkg.db": "pkg.db", "auth.core": "pkg.auth.core", "y.db2": "lib.db2", "none": None}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, None), (7, [float("nan"), 1.0])], "key int, v array<double>")
    assert {r.key: round(r.score, 4) for r in vectors.cosine(df, "key", "v", [1.0, 0.0]).collect()} == {1: 1.0, 2: 0.7071}
    assert vectors.dominant_dimension(df.filter("v is not null"), "v").first().dim == 2


def test_state(spark):
    schema = "key int, digest string, display_id long"
    store = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], schema)
    fresh = spark.createDataFrame([(3, "b", 0), (4, "c", 0), (5, "c", 0), (6, "d", 0)], schema)
    assert sorted((r.key, r.display_id) for r in state.inserted(store, fresh, "digest", ["key"]).collect()) == [(1, 1), (2, 2), (4, 3), (6, 4)]
    diff = {r.key: r.change for r in state.snapshot_diff(store, spark.createDataFrame([(2, "x", 0), (9, "y", 0)], schema), "key", "digest").collect()}
    assert diff == {1: "removed", 2: "changed", 9: "added"}
    assert telemetry.percentile


def test_lexical_phrase(spark):
    df = spark.createDataFrame([(1, "a a a b"), (2, "a b a"), (3, "c"), (4, "d"), (5, "e")], "k int, t string")
    got = {r.k for r in fulltext.bm25(df, "k", {"t": 1.0}, ["a_a"]).collect()}
    assert got == {1}
    assert fulltext.bm25(df, "k", {"t": 1.0}, ["a"], every=True).count() == 0


def test_packing_takes_every_edge(spark, sf_dir):
    from lodestone.plans.queries import queries

    edges = {tuple(r) for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect()}
    size = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    want, used = set(), {}
    for side, item in sorted((e for e in edges if e[1] in size), key=lambda e: (size[e[1]], e[1])):
        if used.get(side, 0) + size[item] <= 150:
            used[side] = used.get(side, 0) + size[item]
            want.add((side, item, size[item], used[side]))
    made = queries()
    packed = {(r.side, r.item, r.tokens, r.used) for r in made["deep_pack"](spark, sf_dir).collect()}
    over = {(r.side, r.item) for r in made["deep_overflow"](spark, sf_dir).collect()}
    assert packed == want and over == {e for e in edges if e[1] in size} - {x[:2] for x in want}


def test_graph_lane_keeps_callers_of_a_busy_seed(spark):
    edges = [("s", f"d{i:02}") for i in range(30)] + [(f"u{i:02}", "s") for i in range(40)]
    lane = graph.graph_lane(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("s", 2.0)], "key string, score double"))
    got = [(r.key, round(r.score, 9)) for r in lane.collect()]
    assert got == [(f"d{i:02}", 2.0) for i in range(25)] + [(f"u{i:02}", 1.8) for i in range(25)]


def test_symbols_and_ambiguity(spark):
    rows = [("a", "run", "app/a.py", "function"), ("b", "run", "app/b.py", "function"), ("c", "run", "tests/test_a.py", "function"), ("d", "Auth.login", "app/auth.py", "method"), ("e", "only", "tests/test_b.py", "function"), ("f", "lone", "app/c.py", "function"), ("g", "lone", "tests/test_c.py", "function"), ("h", "mix", "app/d.py", "constant"), ("i", "mix", "app/e.py", "class")]
    chunks = spark.createDataFrame([(*r, "x = 1") for r in rows], "key string, chunk_name string, file_path string, chunk_type string, body string").cache()
    meant = lambda name, **k: sorted(r.key for r in graph.resolve_symbol(chunks, name, **k).collect())
    assert meant("run") == ["a", "b"] and meant("app/b.py:run") == ["b"] and meant("no/such.py:run") == ["a", "b"]
    assert meant("run", include_tests=True) == ["a", "b", "c"] and meant("only") == [] and meant("lone") == ["f"]
    assert meant("login") == meant("x.Auth.login") == meant("app/auth.py:Auth.login") == ["d"] and meant("mix") == ["i"]
    refs = spark.createDataFrame([], "file_path string, ref_name string, containing_chunk string")
    deep = lambda name: sorted((r.role, r.key) for r in retrieval.deep(chunks, refs, name).collect())
    assert deep("run") == [("ambiguous", "a"), ("ambiguous", "b")] and deep("lone") == [("target", "f")]


def test_suffix_lookup_and_file_names(spark, chunks):
    edges = spark.createDataFrame([("app.auth", "app.db"), ("web.auth", "lib"), ("lib", "app.auth"), ("auth", "own")], "src string, dst string")
    got = {(r.way, r.node) for r in graph.neighbours_of(edges, "auth").collect()}
    assert got == {("imports", "own"), ("imported_by", "lib")}
    assert {(r.way, r.node) for r in graph.neighbours_of(edges, "db").collect()} == {("imported_by", "app.auth")}
    assert [r.file_path for r in retrieval.matching_files(chunks, "nothing AUTH").collect()] == ["app/auth.py", "tests/test_auth.py"]
    assert retrieval.matching_files(chunks, " ").count() == 0


def test_neighbours_of_every_part(spark, sf_dir):
    from lodestone.plans.queries import queries

    parts = {r.p_partkey for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    assert {r.node for r in queries()["neighbors_batch"](spark, sf_dir).collect()} == parts

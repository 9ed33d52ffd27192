"""Import and call graphs: neighbours, importance, resolution, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_category


def callers(edges: DataFrame, name, limit: int = 50) -> DataFrame:
    """edges: src, dst. Different sources of an edge to name, in order."""
    return edges.filter(F.col("dst") == name).select("src").distinct().orderBy("src").limit(limit)


def callees(edges: DataFrame, name, limit: int = 50) -> DataFrame:
    return edges.filter(F.col("src") == name).select("dst").distinct().orderBy("dst").limit(limit)


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, imports, imported_by (sorted, different) for each of nodes."""
    out = edges.select(F.col("src").alias("node"), "dst").join(nodes, "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    into = edges.select(F.col("dst").alias("node"), "src").join(nodes, "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_set("src")).alias("imported_by"))
    return nodes.join(out, "node", "left").join(into, "node", "left")


def neighbours_of(edges: DataFrame, name: str) -> DataFrame:
    """way (imports, imported_by) and node: of name itself or, for a way in which that has none, of every node that ends with
    .name."""
    ways = edges.select(F.lit("imports").alias("way"), F.col("src").alias("own"), F.col("dst").alias("node")).unionByName(edges.select(F.lit("imported_by").alias("way"), F.col("dst").alias("own"), F.col("src").alias("node")))
    found = ways.filter((F.col("own") == name) | F.col("own").endswith("." + name)).withColumn("full", F.col("own") == name)
    full = F.broadcast(found.groupBy("way").agg(F.max("full").alias("any_full")))
    return found.join(full, "way").filter("full = any_full").select("way", "node").distinct()


def importance(edges: DataFrame) -> DataFrame:
    """node, in_degree and its share of the largest; edges are counted once. The maximum is one row."""
    degree = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return degree.crossJoin(F.broadcast(degree.agg(F.max("in_degree").alias("most")))).select("node", "in_degree", (F.col("in_degree") / F.col("most")).alias("score"))


def graph_lane(edges: DataFrame, seeds: DataFrame, per_seed: int = 25, limit: int = 50) -> DataFrame:
    """seeds: key, score. key and score of what seeds call (1.0 of the seed's score) and of what calls them (0.9); per_seed
    of either a seed, the best score of each, without the seeds. name_lane has the other neighbours."""
    s = F.broadcast(seeds.limit(12))
    down = s.join(edges, F.col("key") == F.col("src")).select("key", F.col("dst").alias("other"), F.col("score").alias("got"), F.lit("down").alias("way"))
    up = s.join(edges, F.col("key") == F.col("dst")).select("key", F.col("src").alias("other"), (F.col("score") * 0.9).alias("got"), F.lit("up").alias("way"))
    near = down.unionByName(up).distinct()
    w = Window.partitionBy("key", "way").orderBy(F.col("got").desc(), "other")
    capped = near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_seed)
    best = capped.groupBy(F.col("other").alias("key")).agg(F.max("got").alias("score")).join(seeds.select("key"), "key", "left_anti")
    return best.orderBy(F.col("score").desc(), "key").limit(limit)


def name_lane(seeds: DataFrame, refs: DataFrame, chunks: DataFrame, edges: DataFrame | None = None, per_seed: int = 25, per_name: int = 4, limit: int = 80) -> DataFrame:
    """key and score of the chunks beside the twelve best seeds (key, chunk_name, file_path, score): those that they call by
    name (1.0), methods with the last part of a dotted name that they call (0.95), those that call them (0.9) and, with
    edges of modules, the first chunks of the files next to theirs (0.7); the best score of each, without the seeds. Of
    each seed 25 names either way count, and of each name the chunks of the first four files.

    refs: file_path, ref_name, containing_chunk."""
    from . import modules

    best = F.broadcast(seeds.orderBy(F.col("score").desc(), "key").limit(12).select("key", "chunk_name", "file_path"))

    def capped(rows: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
        return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("n") <= most).drop("n")

    down = refs.join(best.select(F.col("chunk_name").alias("containing_chunk")).distinct(), "containing_chunk").select("containing_chunk", F.col("ref_name").alias("name")).filter("name <> ''").distinct()
    down = capped(down, "containing_chunk", ["name"], per_seed).select("name").distinct()
    up = refs.join(best.select(F.col("chunk_name").alias("ref_name")).distinct(), "ref_name").select("ref_name", F.col("containing_chunk").alias("name")).filter("name <> ''").distinct()
    up = capped(up, "ref_name", ["name"], per_seed).select("name").distinct()

    def named(names: DataFrame, score: float, rows: DataFrame, name: Column) -> DataFrame:
        met = rows.withColumn("name", name).join(F.broadcast(names), "name")
        return capped(met, "name", ["file_path", "key"], per_name).select("key", F.lit(score).alias("score"))

    leaf = lambda c: F.regexp_extract(c, r"[^.]*$", 0)
    dotted = down.filter(F.col("name").contains(".")).select(leaf(F.col("name")).alias("name")).distinct()
    methods = chunks.filter((F.col("chunk_type") == "method") & F.col("chunk_name").contains("."))
    near = named(down, 1.0, chunks, F.col("chunk_name")).unionByName(named(dotted, 0.95, methods, leaf(F.col("chunk_name")))).unionByName(named(up, 0.9, chunks, F.col("chunk_name")))
    if edges is not None:
        near = near.unionByName(modules.import_lane(best, edges, chunks))
    out = near.groupBy("key").agg(F.max("score").alias("score")).join(best.select("key"), "key", "left_anti")
    return out.orderBy(F.col("score").desc(), "key").limit(limit)


def _level(length: Column) -> Column:
    """The power of two that holds a span of this length, so that it lies in two neighbouring cells of that size at most."""
    return F.ceil(F.log2(length.cast("double") + 1)).cast("int")


def _cell(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level)).cast("long")


def _met(points: DataFrame, spans: DataFrame, by: str, point: str, width: Column) -> DataFrame:
    """points and spans of the same `by` whose cells meet: a candidate each time a span may hold a point. A span is in its own
    cells, a point in one cell of every size that spans have (64 at most), so the join's keys are fine however many spans a
    `by` has."""
    held = spans.withColumn("__level", _level(width)).withColumn("__cell", F.explode(F.array_distinct(F.array(_cell(F.col("start"), F.col("__level")), _cell(F.col("end"), F.col("__level"))))))
    levels = F.broadcast(held.agg(F.collect_set("__level").alias("__levels")))
    dealt = points.crossJoin(levels).withColumn("__level", F.explode("__levels")).withColumn("__cell", _cell(F.col(point), F.col("__level"))).drop("__levels")
    return dealt.join(held, [by, "__level", "__cell"]).drop("__level", "__cell")


def narrowest(points: DataFrame, spans: DataFrame, by: str, point: str, key: str) -> DataFrame:
    """points with owner: the shortest span (by, start, end, span; whole numbers) of the same `by` that contains the point,
    the first of equals; null for none."""
    some = points.select(by, point, key)
    inside = _met(some, spans.select(by, "start", "end", "span").filter(F.col("end") >= F.col("start")), by, point, F.col("end") - F.col("start"))
    inside = inside.filter((F.col(point) >= F.col("start")) & (F.col(point) <= F.col("end")))
    best = inside.groupBy(key).agg(F.min_by("span", F.struct(F.col("end") - F.col("start"), F.col("span"))).alias("owner"))
    return points.join(best, key, "left")


def overlap_dedup(spans: DataFrame, by: str, enough: int = 3) -> DataFrame:
    """Wholes that contain `enough` parts or more go; of other wholes the parts go. spans: by, span, kind (whole or part),
    start, end (whole numbers)."""
    whole = spans.filter("kind = 'whole' and end >= start").select(by, "start", "end", F.col("span").alias("whole"))
    part = spans.filter("kind = 'part'").select(by, F.col("start").alias("from"), F.col("end").alias("to"), F.col("span").alias("part"))
    pairs = _met(part, whole, by, "from", F.col("end") - F.col("start")).filter((F.col("from") >= F.col("start")) & (F.col("to") <= F.col("end")) & (F.col("from") <= F.col("end"))).select("whole", "part")
    counts = pairs.groupBy("whole").agg(F.count("*").alias("n"))
    drop_whole = counts.filter(F.col("n") >= enough).select(F.col("whole").alias("span"))
    drop_part = pairs.join(counts.filter(F.col("n") < enough), "whole", "left_semi").select(F.col("part").alias("span")).distinct()
    return spans.join(drop_whole.unionByName(drop_part), "span", "left_anti")


def expand(rows: DataFrame, hits: DataFrame, by: str, at: str, reach: int) -> DataFrame:
    """Rows within reach of a hit of the same `by`, the hits themselves left out; each once, with its least distance."""
    h = hits.select(by, F.col(at).alias("hit"))
    near = rows.join(h, by).withColumn("distance", F.abs(F.col(at) - F.col("hit"))).filter((F.col("distance") <= reach) & (F.col("distance") > 0))
    near = near.groupBy(by, at).agg(F.min("distance").alias("distance"))
    return near.join(hits.select(by, at), [by, at], "left_anti")


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """imports: src, target; modules: fqn. target resolved to a module: by its full name, else by the first module that ends
    with .target, else by the only one with its last part."""
    leaf = lambda c: F.element_at(F.split(c, "\\."), -1)
    full = modules.select(F.col("fqn").alias("target"), F.col("fqn").alias("r1"))
    # Every ending of a module's name is a key: an equi-join in place of endswith.
    ends = modules.select("fqn", F.posexplode(F.split("fqn", "\\."))).select("fqn", F.array_join(F.slice(F.split("fqn", "\\."), F.col("pos") + 1, 1000), ".").alias("target"), "pos").filter("pos > 0")
    suffix = ends.groupBy("target").agg(F.min("fqn").alias("r2"))
    only = modules.groupBy(leaf(F.col("fqn")).alias("leaf")).agg(F.count("*").alias("n"), F.min("fqn").alias("r3")).filter("n = 1").drop("n")
    out = imports.withColumn("leaf", leaf(F.col("target"))).join(full, "target", "left").join(suffix, "target", "left").join(only, "leaf", "left")
    return out.select("src", "target", F.coalesce("r1", "r2", "r3").alias("resolved"))


def import_edges(resolved: DataFrame) -> DataFrame:
    """src, dst, kind: an edge once, with the kind that came last; no edge from a module to itself. resolved: src, resolved,
    kind, ordinal."""
    return resolved.filter("resolved is not null and resolved <> src").groupBy("src", F.col("resolved").alias("dst")).agg(F.max_by("kind", "ordinal").alias("kind"))


def orphans(nodes: DataFrame, edges: DataFrame, limit: int = 10, least: int = 20) -> DataFrame:
    """Nodes that nothing points at; none if there are `least` nodes or fewer. nodes: node."""
    n = F.broadcast(nodes.agg(F.count("*").alias("__n")))
    lone = nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    return lone.crossJoin(n).filter(F.col("__n") > least).select("node").orderBy("node").limit(limit)


def resolve_name(rows: DataFrame, key: str, name: str, wanted: str) -> DataFrame:
    """Rows of the first tier that has any: the exact name, the same but for case, names that end with it, names that hold it."""
    n = F.col(name)
    tier: Column = F.when(n == wanted, 1).when(F.lower(n) == wanted.lower(), 2).when(F.lower(n).endswith(wanted.lower()), 3).when(F.lower(n).contains(wanted.lower()), 4)
    found = rows.withColumn("tier", tier).filter("tier is not null").select(key, name, "tier")
    return found.crossJoin(F.broadcast(found.agg(F.min("tier").alias("best")))).filter("tier = best").drop("best")


_FILE = (".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".swift")


def resolve_symbol(chunks: DataFrame, name: str, include_tests: bool = False) -> DataFrame:
    """key and chunk_name of the chunks that name may mean: of the first tier that has any (the name, its part behind file:,
    file:name, Class.method, the last part of a dotted name, then as resolve_name), those of the file it gives if there are
    any, without tests, and of those left functions and methods before classes before others. More than one: ambiguous."""
    hint, symbol = None, name
    before, colon, after = name.rpartition(":")
    if colon and ("/" in before or before.endswith(_FILE)):
        hint, symbol = before, after
    n, path = F.col("chunk_name"), F.col("file_path")
    last = lambda x: x.rsplit("::", 1)[-1].rsplit(".", 1)[-1]
    never = F.lit(False)
    owner, _, method = symbol.rpartition(".")
    owner = owner.split(".")[0]
    tiers = [
        n == name,
        n == symbol,
        (n == after) & path.contains(before) if colon else never,
        (n == method) & (n.contains(owner) | path.contains(owner)) if method != symbol else never,
        n.endswith("." + symbol) | n.endswith("::" + symbol) | (F.regexp_extract(n, r"[^.:]*$", 0) == last(symbol)),
        F.lower(n) == symbol.lower(),
        F.lower(n).endswith(symbol.lower()),
        F.lower(n).contains(symbol.lower()),
    ]
    tier = F.coalesce(*[F.when(t, i) for i, t in enumerate(tiers)])
    kind = F.when(F.col("chunk_type").isin("function", "method"), 0).when(F.col("chunk_type") == "class", 1).when(F.col("chunk_type").isin("constant", "module"), 2).otherwise(3)
    found = chunks.select("key", "chunk_name", "file_path", tier.alias("tier"), kind.alias("kind"), (path.contains(hint) if hint else F.lit(True)).alias("hinted")).filter("tier is not null")

    def least(rows: DataFrame, column: str) -> DataFrame:
        return rows.crossJoin(F.broadcast(rows.agg(F.min(column).alias("best")))).filter(F.col(column) == F.col("best")).drop("best")

    found = least(least(found, "tier").withColumn("off", ~F.col("hinted")), "off")
    if not include_tests:
        found = found.filter(file_category(path) != "test")
    return least(found, "kind").select("key", "chunk_name")

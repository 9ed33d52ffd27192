"""What a prompt holds beside its code, and how results are written down: signatures of what files import, summaries, an
overview, compressed code, Markdown and JSON. All of it is about one query's limited result."""

from __future__ import annotations

import io
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import budget, modules

#: Shares of code, imports, summaries and overview in the older way of filling a budget. Fixed values.
OLD_SPLIT = (0.40, 0.30, 0.20, 0.10)


def old_split(tokens: int, imports: bool = True) -> dict[str, int]:
    """Tokens of code, imports, summaries and overview; without imports their share goes to code."""
    code, imp, summ, over = (int(tokens * s) for s in OLD_SPLIT)
    return {"code": code if imports else code + imp, "imports": imp if imports else 0, "summaries": summ, "overview": over}


def confidence(used: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, F.round(used / tokens, 2)).otherwise(0.0)


def dependency_signatures(files: DataFrame, edges: DataFrame, chunks: DataFrame, tokens: int, include_tests: bool = True) -> DataFrame:
    """file_path, body, tokens and used: the signatures of the modules that a result's files import, by module name, as long
    as they fit; the one that doesn't is cut to what is left. files: path; edges: src, dst; both few."""
    own = files.select("path", F.regexp_replace(F.replace("path", F.lit("/"), F.lit(".")), r"\.py$", "").alias("src"))
    wanted = edges.join(F.broadcast(own.select("src")), "src").select(F.concat(F.replace("dst", F.lit("."), F.lit("/")), F.lit(".py")).alias("file_path")).distinct()
    wanted = wanted.join(F.broadcast(files.select(F.col("path").alias("file_path"))), "file_path", "left_anti")
    if not include_tests:
        wanted = wanted.filter(T.file_category(F.col("file_path")) != "test")
    lines = chunks.join(F.broadcast(wanted), "file_path").filter("signature <> ''").groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "signature"))).alias("s"))
    body = lines.select("file_path", F.array_join(F.col("s.signature"), "\n").alias("body")).withColumn("tokens", T.token_count(F.col("body")))
    return _cut_to_fit(body, tokens)


def _cut_to_fit(rows: DataFrame, tokens: int) -> DataFrame:
    """file_path, body, tokens, used: in order of file_path, each body cut to what is left if it doesn't fit, and left out if
    it doesn't even then."""
    mark = "\n... (truncated)"
    item = F.array_sort(F.collect_list(F.struct("file_path", "body", "tokens")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<struct<file_path:string,body:string,tokens:long,used:long>>)").alias("taken"))

    def step(s: Column, x: Column) -> Column:
        left = F.lit(tokens) - s["used"]
        fits = x["tokens"] <= left
        cut = F.concat(F.substring(x["body"], F.lit(1), F.greatest(F.lit(0), 4 * left - len(mark)).cast("int")), F.lit(mark))
        body = F.when(fits, x["body"]).otherwise(cut)
        n = F.when(fits, x["tokens"]).otherwise(T.token_count(cut))
        used = s["used"] + n
        more = F.array(F.struct(x["file_path"].alias("file_path"), body.alias("body"), n.alias("tokens"), used.alias("used")))
        return F.when(used <= tokens, F.struct(used.alias("used"), F.concat(s["taken"], more).alias("taken"))).otherwise(s)

    return rows.agg(item.alias("items")).select(F.explode(F.aggregate("items", start, step, lambda s: s["taken"])).alias("x")).select("x.*")


def file_summaries(files: DataFrame, chunks: DataFrame, tokens: int) -> DataFrame:
    """file_path, tokens, used and body, the names of a file's first ten chunks, of the files whose summaries fit in order."""
    w = Window.partitionBy("file_path").orderBy("start_line", "chunk_name")
    first = chunks.join(F.broadcast(files.select(F.col("path").alias("file_path")).distinct()), "file_path").withColumn("n", F.row_number().over(w)).filter("n <= 10")
    names = first.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(" ", "chunk_type", "chunk_name").alias("name")))).alias("s"))
    body = names.select("file_path", F.concat(F.lit("# "), "file_path", F.lit("\nContains: "), F.array_join(F.col("s.name"), ", "), F.lit("\n")).alias("body"))
    sized = body.withColumn("tokens", T.token_count(F.col("body"))).withColumn("q", F.lit(1))
    return budget.greedy_fill(sized, "q", [F.col("file_path")], "file_path", "tokens", tokens, ["body"]).select("file_path", "tokens", "used", F.col("body"))


def overview(project: str, description: str = "", readme: str = "", tokens: int = 500) -> str:
    """A project's name, its description and the first of its read-me's first three paragraphs that is not an image."""
    parts = [f"Project: {project}", *([description] if description else [])]
    parts += [p.strip() for p in readme.split("\n\n")[:3] if p.strip() and not p.strip().startswith("![")][:1]
    whole = "\n\n".join(parts)
    mark = "\n... (truncated)"
    return whole if max(1, len(whole) // 4) <= tokens else whole[: max(0, 4 * tokens - len(mark))] + mark


def session_document(head: list[str], signatures: DataFrame, notes: DataFrame, tokens: int, most: int = 50) -> str:
    """The document that a session starts with: head, then up to `most` signatures until four fifths of the budget are
    passed, then notes until 95 % are; what passes a limit still stays. Few rows come to the driver."""
    size = lambda: max(1, len("\n".join(lines)) // 4)
    lines = [*head, "", "## Key Signatures", ""]
    for s in signatures.orderBy("file_path", "start_line").limit(most).collect():
        lines.append(f"- `{s['file_path']}:{s['start_line']}` — {s['signature']}")
        if size() > tokens * 0.8:
            break
    kept = [n["content"].strip() for n in notes.select("content").limit(20).collect() if (n["content"] or "").strip()]
    if kept:
        lines += ["", "## Remembered Context", ""]
    for text in kept:
        lines.append(f"- {text[:200]}")
        if size() > tokens * 0.95:
            break
    return "\n".join(lines) + "\n"


# Code made shorter ----------------------------------------------------------------------------------------------------


def _without_comments(code: str) -> str:
    """Python code without comments and with its docstrings as dots; anything else as it is."""
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(code).readline))
    except (tokenize.TokenError, SyntaxError):
        return code
    out, begins = [], True
    for t in tokens:
        text = t.string
        if t.type == tokenize.COMMENT:
            text = ""
        elif t.type == tokenize.STRING and begins and (m := re.match("([rRuUbBfF]*)('''|\"\"\")", text)):
            text = f"{m[1]}{m[2]}...{m[2]}"
        out.append(t._replace(string=text))
        if t.type in (tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING):
            begins = True
        elif t.type not in (tokenize.NL, tokenize.COMMENT):
            begins = False
    try:
        return tokenize.untokenize(out)
    except ValueError:
        return code


def compressed(code: Column, most: int = 2000) -> Column:
    """Code without comments, docstrings, blank lines in a row and trailing blanks, of at most so many characters."""
    if most <= 0:
        return F.when(code.isNotNull(), "")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else _without_comments(x))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    mark = "\n# ... [truncated]"
    bare = F.regexp_replace(F.regexp_replace(F.pandas_udf(run, "string")(code), r"\n\s*\n+", "\n\n"), r"(?m)[ \t]+$", "")
    cut = F.substring(bare, 1, most) if len(mark) >= most else F.concat(F.regexp_replace(F.substring(bare, 1, most - len(mark)), r"\s+$", ""), F.lit(mark))
    return F.regexp_replace(F.when(F.length(bare) > most, cut).otherwise(bare), r"^\s+|\s+$", "")


def key_signatures(code: Column, most: int = 10) -> Column:
    """The first classes and functions of code in Python or JavaScript, one a line under a heading; without any, its first
    500 characters."""
    funcs = F.slice(F.regexp_extract_all(code, F.lit(r"((?:async\s+)?(?:def|function)\s+\w+\s*\([^)]*\)(?:\s*->\s*\w+)?:?)"), F.lit(1)), 1, most)
    kinds = F.slice(F.regexp_extract_all(code, F.lit(r"((?:export\s+)?(?:class|interface)\s+\w+(?:\s*(?:extends|implements)\s+\w+)?:?)"), F.lit(1)), 1, most)

    def part(head: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(F.transform(items, lambda x: F.concat(F.lit("\n  "), x)), "")))

    return F.when(F.size(funcs) + F.size(kinds) > 0, F.concat_ws("\n", part("Classes/Interfaces:", kinds), part("Functions:", funcs))).otherwise(F.substring(code, 1, 500))


# Ways of writing results ----------------------------------------------------------------------------------------------


def chunk_json(rows: DataFrame) -> DataFrame:
    """place and item: a result's chunk as JSON, the body last. rows: slot, file_path, chunk_name, chunk_type, signature,
    start_line, end_line, score, tokens, body, and any of imports, imported_by, test_file."""
    more = [c for c in ("imports", "imported_by", "test_file") if c in rows.columns]
    item = F.struct(F.col("file_path").alias("file"), F.col("chunk_name").alias("name"), F.col("chunk_type").alias("type"), "signature", F.array("start_line", "end_line").alias("lines"), F.round("score", 3).alias("score"), "tokens", *more, "body")
    return rows.select(F.col("slot").alias("place"), F.to_json(item).alias("item"))


def agent_json(query: str, tokens: int, code: DataFrame, more: dict | None = None) -> str:
    """A context as one JSON document. code: as chunk_json takes it; more: further entries. The result of one query."""
    import json

    items = [json.loads(r["item"]) for r in chunk_json(code).orderBy("place").collect()]
    used = sum(x["tokens"] for x in items)
    label = f"{used:,} / {tokens:,} ({used * 100 // tokens if tokens else 0}%)"
    out = {"query": query, "budget": tokens, "used_tokens": used, "budget_utilization": label, "confidence": round(used / tokens, 2) if tokens else 0}
    out |= {"code": items, "source_files": list(dict.fromkeys(x["file"] for x in items))}
    return json.dumps(out | (more or {}), indent=2)


def markdown(query: str, label: str, sections: dict[str, DataFrame], texts: dict[str, str] | None = None, warnings: list[str] | None = None) -> str:
    """A context as Markdown. sections: title to chunks (slot, file_path, chunk_name, start_line, end_line, body), in order;
    texts: title to text, after them. The result of one query."""
    lines = [f'# Context for: "{query}"', f"## Token Budget: {label}", ""]
    if warnings:
        lines += [*(f"> {w}" for w in warnings), ""]
    for title, rows in sections.items():
        got = rows.orderBy("slot").collect()
        if got:
            lines += [f"### {title}", ""]
        for r in got:
            lines += [f"#### {r['file_path']}:{r['chunk_name']} (lines {r['start_line']}-{r['end_line']})", "```", r["body"] or "", "```", ""]
    for title, text in (texts or {}).items():
        if text:
            lines += [f"### {title}", "", text, ""]
    return "\n".join(lines)


def first_lines(body: Column, most: int, mark: str = "# ... truncated") -> Column:
    """At most so many lines of a body, and a mark if there were more."""
    lines = F.split(F.regexp_replace(F.coalesce(body, F.lit("")), r"\r?\n$", ""), r"\r?\n", -1)
    return F.when(F.size(lines) <= most, F.coalesce(body, F.lit(""))).otherwise(F.array_join(F.concat(F.slice(lines, 1, most), F.array(F.lit(mark))), "\n"))


def compact(listed: DataFrame, context: DataFrame, deep: DataFrame) -> DataFrame:
    """part, place and item (JSON) of a workflow in brief: five candidates of the map, six lines of five snippets of the
    context, the deep target, and of its callers and callees four each with 36 lines, and eight signatures of what didn't
    fit. listed and context: chunks' columns with score and slot; deep: chunks' columns with role and tokens."""

    def top(rows: DataFrame, part: str, most: int, order: list[Column], item: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(F.lit(part)).orderBy(*order))
        return rows.select(F.lit(part).alias("part"), place.cast("long").alias("place"), F.to_json(item).alias("item")).filter(F.col("place") <= most)

    file, name, kind = F.col("file_path").alias("file"), F.col("chunk_name").alias("symbol"), F.col("chunk_type").alias("type")
    lines = F.array_join(F.transform(F.slice(F.split(F.coalesce("body", F.lit("")), r"\r?\n", -1), 1, 6), lambda x: F.regexp_replace(x, r"\s+$", "")), "\n")
    related = lambda most: F.struct(file, name, "signature", "start_line", "end_line", "tokens", first_lines(F.col("body"), most).alias("body"))
    by_key = [F.col("tokens"), F.col("key")]
    parts = [
        top(listed, "candidate", 5, [F.col("score").desc(), F.col("key")], F.struct(file, name, kind, F.col("start_line").alias("line"), "score")),
        top(context, "snippet", 5, [F.col("slot")], F.struct(file, name, kind, F.array("start_line", "end_line").alias("lines"), lines.alias("snippet"))),
        top(deep.filter("role = 'target'"), "target", 1, by_key, related(120)),
        top(deep.filter("role = 'caller'"), "caller", 4, by_key, related(36)),
        top(deep.filter("role = 'callee'"), "callee", 4, by_key, related(36)),
        top(deep.filter(F.col("role").endswith("_overflow")), "overflow", 8, by_key, F.struct(file, name, "signature")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_text(neighbours: DataFrame) -> DataFrame:
    """node and text: what a module imports and what imports it, a line each. neighbours: node, imports, imported_by (sorted,
    null for none), as graph.neighbours gives them."""

    def part(title: str, items: Column, arrow: str) -> Column:
        lines = F.transform(items.cast("array<string>"), lambda x: F.concat(F.lit(f"\n  {arrow} "), x))
        return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(F.lit(f"## {title}"), F.array_join(lines, ""))).otherwise(f"## {title.split(' (')[0]}: (none)")

    head = F.concat(F.lit("# Import graph for: "), F.col("node").cast("string"), F.lit("\n\n"))
    return neighbours.select("node", F.concat(head, part("Imports (dependencies)", F.col("imports"), "→"), F.lit("\n\n"), part("Imported by (dependents)", F.col("imported_by"), "←")).alias("text"))


def mermaid(nodes: DataFrame, edges: DataFrame, direction: str = "TB") -> str:
    """A diagram of the nodes (module; in order) and the edges between them. nodes are few."""
    names = [r["module"] for r in nodes.select("module").collect()]
    ends = edges.filter(F.col("src").isin(names) & F.col("dst").isin(names) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct().orderBy("src", "dst").collect() if names else []
    leaves = [n.rsplit(".", 1)[-1] for n in names]
    label = [".".join(n.split(".")[-2:]) if leaves.count(x) > 1 else x for n, x in zip(names, leaves, strict=True)]
    number = {n: f"m{i}" for i, n in enumerate(names)}
    lines = ["```mermaid", f"graph {direction}", *(f'    {number[n]}["{x.replace(chr(34), chr(39))}"]' for n, x in zip(names, label, strict=True))]
    return "\n".join([*lines, *(f"    {number[e['src']]} --> {number[e['dst']]}" for e in ends), "```", ""])


def system_document(project: str, counts: dict, every: DataFrame, total: int, most: int = 15) -> str:
    """An overview document of a project: its largest modules and its counts. every: module, path, functions, classes and
    optionally description."""
    lines = [f"# {project}", "", "## Project Structure", ""]
    for r in modules.ranked_modules(every, most).collect():
        about = (r["description"] or "").split("\n")[0][:100] if "description" in every.columns else ""
        lines.append(f"- **[{r['module']}]({r['path']})**" + (f" - {about}" if about else ""))
    if total > most:
        lines.append(f"- ... and {total - most} more modules")
    return "\n".join([*lines, "", "## Statistics", "", *(f"- **{k}:** {v}" for k, v in counts.items()), ""])


# The older way to a context -------------------------------------------------------------------------------------------


def word_share(query: str, *fields: Column) -> Column:
    """The share of the query's words that the fields have together."""
    asked = sorted(set(re.findall(r"\w+", query.lower())))
    if not asked:
        return F.lit(0.0)
    own = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *fields)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return F.size(F.array_intersect(own, F.array(*map(F.lit, asked)))) / F.lit(float(len(asked)))


def old_context(chunks: DataFrame, query: str, tokens: int, recency: DataFrame | None = None, edges: DataFrame | None = None, include_tests: bool = True, most: int = 2000) -> DataFrame:
    """part (code, dependency, test, summary), file_path, name, tokens and place by the older way: word share over names,
    signatures and the beginning of bodies, with 0.15 of the recency; code by 40 % of the budget, signatures of imports by 30 %,
    tests by a quarter of the summaries' 20 % and what imports left, and summaries. Of the scored chunks the `most` best
    are filled in; the budget ends long before."""
    share = old_split(tokens, edges is not None)
    rows = chunks if include_tests else chunks.filter(T.file_category(F.col("file_path")) != "test")
    score = word_share(query, F.col("chunk_name"), F.col("signature"), F.substring(F.col("body"), 1, 300))
    scored = rows.withColumn("score", score)
    if recency is not None:
        fresh = F.greatest(F.lit(0.0), 1 - F.col("age_days") / 30.0)
        scored = scored.join(recency.groupBy("file_path").agg(F.max(fresh).alias("fresh")), "file_path", "left").withColumn("score", F.col("score") + 0.15 * F.coalesce("fresh", F.lit(0.0))).drop("fresh")
    best = scored.withColumn("tokens", T.token_count(F.col("body"))).withColumn("score", F.round("score", 9)).orderBy(F.col("score").desc(), "key").limit(most).withColumn("q", F.lit(1))
    order = [-F.col("score"), F.col("key")]
    code = budget.greedy_fill(best, "q", order, "key", "tokens", share["code"], ["file_path", "chunk_name"])
    out = code.select(F.lit("code").alias("part"), "file_path", F.col("chunk_name").alias("name"), "tokens", F.col("used").alias("place"))
    files = code.select(F.col("file_path").alias("path")).distinct()
    left = 0
    if edges is not None:
        deps = dependency_signatures(files, edges, chunks, share["imports"], include_tests)
        out = out.unionByName(deps.select(F.lit("dependency").alias("part"), "file_path", F.lit("(signatures)").alias("name"), "tokens", F.col("used").alias("place")))
        left = share["imports"] - int(deps.agg(F.coalesce(F.max("used"), F.lit(0))).first()[0])
    room = share["summaries"]
    if include_tests:
        tests = tests_of(files, chunks).withColumn("tokens", T.token_count(F.col("body"))).filter("coalesce(chunk_type, '') <> 'module'")
        taken = budget.prefix_fill(tests.withColumn("q", F.lit(1)), "q", [F.col("file_path"), F.col("start_line"), F.col("key")], "tokens", left + room // 4)
        out = out.unionByName(taken.select(F.lit("test").alias("part"), "file_path", F.col("chunk_name").alias("name"), "tokens", F.col("used").alias("place")))
        room = max(0, room - int(taken.agg(F.coalesce(F.max("used"), F.lit(0))).first()[0]))
    summ = file_summaries(files, chunks, room)
    return out.unionByName(summ.select(F.lit("summary").alias("part"), "file_path", F.lit("(summary)").alias("name"), "tokens", F.col("used").alias("place")))


def tests_of(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the test files of a result's files: test_name.py or name_test.py."""
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    names = files.select(F.explode(F.array(F.concat(F.lit("test_"), stem, F.lit(".py")), F.concat(stem, F.lit("_test.py")))).alias("leaf")).distinct()
    return chunks.withColumn("leaf", F.regexp_extract("file_path", "[^/]*$", 0)).join(F.broadcast(names), "leaf").drop("leaf")

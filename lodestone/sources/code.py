"""Source trees as tables: files, chunks (functions, classes, methods, constants), call references and imports.

Parsing needs a parser, so files go through Python in Arrow batches, one pass for each table, each file for itself.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob, is_excluded, language

CHUNKS = "file_path string, chunk_name string, chunk_type string, language string, start_line long, end_line long, signature string, body string"
REFS = "file_path string, ref_name string, ref_type string, line_number long, containing_chunk string"
IMPORTS = "file_path string, source_module string, target string, import_type string, ordinal long"
ROUTES = "file_path string, method string, path string, handler string, line_number long"
WHOLE = "file_path string, chunk_name string, chunk_type string, start_line long, end_line long, signature string, docstring string, body string"
WHOLE_KEYS = tuple(x.split()[0] for x in WHOLE.split(", "))
#: Characters of a chunk's body.
BODY = 5000


def files(spark: SparkSession, root: str) -> DataFrame:
    """file_path (below root), language, content_hash, text of every file in a known language that isn't excluded."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(re.sub("^file:(//)?", "", root.rstrip("/")) + "/")
    path = F.regexp_replace("path", "^file:(//)?", "")
    rel = F.substring(path, F.length(base) + 1, F.lit(1 << 20))
    out = raw.select(rel.alias("file_path"), F.sha2("content", 256).alias("content_hash"), F.decode("content", "utf-8").alias("text"))
    return out.withColumn("language", language(F.col("file_path"))).filter(F.col("language").isNotNull() & ~is_excluded(F.col("file_path")))


def module_name(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", path).replace("/", ".")


def _body(lines: list[str], start: int, end: int) -> str:
    text = "\n".join(lines[start - 1 : end])
    if len(text) <= BODY:
        return text
    cut = text.rfind("\n", 0, BODY)
    return text[: cut if cut > 0 else BODY] + "\n# ... truncated"


# --- Python ---------------------------------------------------------------------------------------------------------


def _python_spans(tree: ast.Module) -> Iterator[tuple[str, str, ast.AST, str]]:
    """Name, type, node and signature of what stands at the top and in classes there."""
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in tree.body:
        if isinstance(node, functions):
            yield node.name, "function", node, f"{node.name}({ast.unparse(node.args)})"
        elif isinstance(node, ast.ClassDef):
            yield node.name, "class", node, node.name
            for inner in node.body:
                if isinstance(inner, functions):
                    yield f"{node.name}.{inner.name}", "method", inner, f"{node.name}.{inner.name}({ast.unparse(inner.args)})"
        elif isinstance(node, ast.Assign):
            for target in node.targets:
                if isinstance(target, ast.Name) and target.id.isupper():
                    yield target.id, "constant", node, target.id


def _python_calls(tree: ast.Module) -> Iterator[tuple[str, int]]:
    """Dotted names that are called, with names that an import or a plain assignment gave another name put back."""
    other: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            other.update({a.asname: a.name for a in node.names if a.asname})
        elif isinstance(node, ast.ImportFrom):
            other.update({a.asname: a.name for a in node.names if a.asname})
        elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and isinstance(node.value, ast.Name):
            other[node.targets[0].id] = node.value.id
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            parts, f = [], node.func
            while isinstance(f, ast.Attribute):
                parts.append(f.attr)
                f = f.value
            if isinstance(f, ast.Name):
                seen, first = set(), f.id
                while first in other and first not in seen:
                    seen.add(first)
                    first = other[first]
                parts.append(first)
            name = parts[0].rpartition(".")[2] if parts else ""
            if len(name) >= 2 and not name.startswith("__"):
                yield name, node.lineno


# --- other languages: declarations by line, ends by braces ------------------------------------------------------------

_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_C_LIKE = rf"^[ \t]*(?:[\w:<>,*&\[\]?~]+[ \t]+[*&]*)+{_NAME}[ \t]*\([^;{{}}]*\)[ \t]*(?:const|noexcept|override|throws[\w ,.]*)?[ \t]*\{{"
_JS = [
    ("function", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}\s*[(<]"),
    ("function", rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|[\w$]+)\s*(?::[^=\n]+)?=>"),
    ("class", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface)\s+{_NAME}"),
]
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    **dict.fromkeys(("javascript", "jsx", "typescript", "tsx"), _JS),
    "go": [("method", rf"^func\s+\([^)]*\)\s*{_NAME}\s*[(\[]"), ("function", rf"^func\s+{_NAME}\s*[(\[]"), ("class", rf"^type\s+{_NAME}\s+(?:struct|interface)\b")],
    "rust": [("function", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+{_NAME}"), ("class", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+{_NAME}")],
    "java": [("class", rf"^[ \t]*(?:(?:public|private|protected|abstract|final|static)\s+)*(?:class|interface|enum|record)\s+{_NAME}"), ("method", rf"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?.]+\s+{_NAME}\s*\(")],
    "ruby": [("class", rf"^[ \t]*(?:class|module)\s+{_NAME}"), ("function", r"^[ \t]*def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)")],
    **dict.fromkeys(("c", "cpp"), [("class", rf"^[ \t]*(?:typedef\s+)?(?:class|struct)\s+{_NAME}[^;]*\{{"), ("function", _C_LIKE)]),
    "swift": [("class", rf"^[ \t]*(?:(?:public|private|open|final|internal)\s+)*(?:class|struct|enum|protocol)\s+{_NAME}"), ("function", rf"^[ \t]*(?:(?:public|private|open|static|override|internal|mutating)\s+)*func\s+{_NAME}")],
}
# Words before a bracket that aren't calls.
KEYWORDS = frozenset("if for while switch catch return function func fn def class new typeof sizeof match loop elif else await super this self do try with in of and or not assert print panic impl struct enum interface select case defer go".split())
# What looks like a declaration of C-like languages but is none.
CONTROL = frozenset("if for while switch catch return else do".split())
COMMENT = re.compile(r"^\s*(//|#|/\*|\*)")
IMPORT = {
    **dict.fromkeys(("javascript", "jsx", "typescript", "tsx"), re.compile(r"(?:\bfrom|\bimport|\brequire\s*\()\s*[\"']([^\"']+)[\"']")),
    "go": re.compile(r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$"),
    "rust": re.compile(r"^\s*(?:pub\s+)?use\s+([\w:]+)"),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+)"),
    "ruby": re.compile(r"^\s*require(?:_relative)?\s+[\"']([^\"']+)"),
    **dict.fromkeys(("c", "cpp"), re.compile(r"^\s*#\s*include\s+[<\"]([^>\"]+)")),
    "swift": re.compile(r"^\s*import\s+(\w+)"),
}


def _end(lines: list[str], first: int, lang: str) -> int:
    """The last line of what begins at line `first` (both from 1): where its braces close or, in Ruby, at its `end`."""
    if lang == "ruby":
        indent = len(lines[first - 1]) - len(lines[first - 1].lstrip())
        for n in range(first, len(lines)):
            if re.match(rf"^\s{{{indent}}}end\b", lines[n]):
                return n + 1
        return first
    depth, opened = 0, False
    for n in range(first - 1, len(lines)):
        line = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|//.*", "", lines[n])
        for c in line:
            depth += (c == "{") - (c == "}")
            opened |= c == "{"
        if opened and depth <= 0:
            return n + 1
        if not opened and n > first + 3:
            break
    return first


def _spans(path: str, lang: str, text: str) -> tuple[list[tuple[str, str, int, int, str]], list[str], ast.Module | None]:
    """Name, type, first and last line and signature of the declarations; the lines; a Python tree."""
    lines, out = text.split("\n"), []
    if lang == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return [], lines, None
        return [(n, k, node.lineno, node.end_lineno or node.lineno, sig) for n, k, node, sig in _python_spans(tree)], lines, tree
    rules = [(k, re.compile(p)) for k, p in DECLARATIONS.get(lang, [])]
    for i, line in enumerate(lines, 1):
        for kind, rule in rules:
            if (m := rule.match(line)) and m["name"] not in CONTROL:
                out.append((m["name"], kind, i, _end(lines, i, lang), line.strip().rstrip("{").strip()))
                break
    return out, lines, None


def narrowest(line: int, spans: list[tuple[str, str, int, int, str]]) -> str:
    """The shortest span around a line, the first of equals."""
    around = [(end - start, i, name) for i, (name, _, start, end, _) in enumerate(spans) if start <= line <= end]
    return min(around)[2] if around else "<module>"


def parse_chunks(path: str, lang: str, text: str) -> list[dict]:
    spans, lines, _ = _spans(path, lang, text)
    if not spans:
        spans = [(module_name(path), "module", 1, len(lines), module_name(path))]
    keys = ("file_path", "chunk_name", "chunk_type", "language", "start_line", "end_line", "signature", "body")
    return [dict(zip(keys, (path, n, k, lang, a, b, sig, text[:BODY] if k == "module" else _body(lines, a, b)), strict=True)) for n, k, a, b, sig in spans]


def parse_refs(path: str, lang: str, text: str) -> list[dict]:
    spans, lines, tree = _spans(path, lang, text)
    found: list[tuple[str, str, int]] = []
    if tree is not None:
        found = [(name, "call", line) for name, line in _python_calls(tree)]
    elif lang != "python":
        declared = {(n, a) for n, _, a, _, _ in spans}
        for i, line in enumerate(lines, 1):
            if COMMENT.match(line):
                continue
            found += [(m[1], "call", i) for m in re.finditer(r"([A-Za-z_$][\w$]*)\s*\(", line) if m[1] not in KEYWORDS and len(m[1]) >= 2 and (m[1], i) not in declared]
            if lang in ("jsx", "tsx", "javascript", "typescript"):
                found += [(m[1], "jsx_component", i) for m in re.finditer(r"<([A-Z]\w+)", line)]
    rows = dict.fromkeys((n, k, i, narrowest(i, spans)) for n, k, i in found)
    return [dict(zip(("file_path", "ref_name", "ref_type", "line_number", "containing_chunk"), (path, *r), strict=True)) for r in rows]


def parse_imports(path: str, lang: str, text: str) -> list[dict]:
    got: list[tuple[str, str]] = []
    if lang == "python":
        tree = _spans(path, lang, text)[2]
        for node in ast.walk(tree) if tree else ():
            if isinstance(node, ast.Import):
                got += [(a.name, "import") for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                dots = "." * (node.level or 0)
                got += [(dots + node.module, "from")] if node.module else [(dots + a.name, "from") for a in node.names]
    elif lang in IMPORT:
        got = [(m[1], "import") for line in text.split("\n") for m in IMPORT[lang].finditer(line)]
    return [dict(zip(("file_path", "source_module", "target", "import_type", "ordinal"), (path, module_name(path), t, k, i), strict=True)) for i, (t, k) in enumerate(got)]


def parse_routes(path: str, lang: str, text: str) -> list[dict]:
    """Routes that decorators declare; `route` is a GET, and no path is /."""
    out = []
    tree = _spans(path, lang, text)[2] if lang == "python" else None
    for node in ast.walk(tree) if tree else ():
        for d in getattr(node, "decorator_list", []):
            call = d.func if isinstance(d, ast.Call) else d
            verb = call.attr.lower() if isinstance(call, ast.Attribute) else ""
            if verb in ("get", "post", "put", "delete", "patch", "route"):
                first = d.args[0] if isinstance(d, ast.Call) and d.args else None
                at = first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else "/"
                out.append(dict(zip(("file_path", "method", "path", "handler", "line_number"), (path, "GET" if verb == "route" else verb.upper(), at, node.name, node.lineno), strict=True)))
    return out


def parse_whole(path: str, lang: str, text: str) -> list[dict]:
    """The older way to chunks: for Python a chunk of the module's docstring and imports, then functions, classes and methods
    with their first lines as signatures; the whole file for anything else."""
    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    lines, tree = text.split("\n"), None
    if lang == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            tree = None
    if tree is None:
        return [dict(zip(WHOLE_KEYS, (path, stem, "module", 1, len(lines), "", "", text), strict=True))]
    doc = ast.get_docstring(tree) or ""
    taken = [line for node in tree.body if isinstance(node, (ast.Import, ast.ImportFrom)) for line in lines[node.lineno - 1 : node.end_lineno]]
    head = "\n".join([*([f'"""{doc}"""', ""] if doc else []), *taken]).strip()
    out = [(path, f"{stem} (module)", "module", 1, max(1, len(taken)), "", doc, head)] if head else []
    for name, kind, node, _ in _python_spans(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append((path, name, kind, node.lineno, node.end_lineno, lines[node.lineno - 1].strip(), ast.get_docstring(node) or "", "\n".join(lines[node.lineno - 1 : node.end_lineno]).rstrip()))
    return [dict(zip(WHOLE_KEYS, row, strict=True)) for row in out]


def parse_outline(path: str, lang: str, text: str) -> list[dict]:
    """One row a Python file: its functions, classes and methods, a line each, with docstrings of the outer ones."""
    rows = []
    for r in parse_whole(path, lang, text) if lang == "python" else ():
        if r["chunk_type"] == "method":
            rows.append("    " + r["signature"])
        elif r["chunk_type"] in ("function", "class"):
            rows += [r["signature"], *([f'    """{r["docstring"]}"""'] if r["docstring"] else [])]
    return [{"file_path": path, "outline": "\n".join(rows)}] if rows else []


def _table(sources: DataFrame, parse: Callable[[str, str, str], list[dict]], schema: str) -> DataFrame:
    """sources: file_path, language, text."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200)
                rows = [r for p, lang, t in zip(*(c.to_pylist() for c in some.columns), strict=True) for r in parse(p, lang or "", t or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return sources.select("file_path", "language", "text").mapInArrow(run, schema)


def chunks(sources: DataFrame) -> DataFrame:
    return _table(sources, parse_chunks, CHUNKS)


def call_refs(sources: DataFrame) -> DataFrame:
    return _table(sources, parse_refs, REFS)


def imports(sources: DataFrame) -> DataFrame:
    return _table(sources, parse_imports, IMPORTS)


def routes(sources: DataFrame) -> DataFrame:
    return _table(sources, parse_routes, ROUTES)


def whole_chunks(sources: DataFrame) -> DataFrame:
    return _table(sources, parse_whole, WHOLE)


def outlines(sources: DataFrame) -> DataFrame:
    return _table(sources, parse_outline, "file_path string, outline string")


def kept_files(files: DataFrame, ignored: list[str] | None = None, included: list[str] | None = None) -> DataFrame:
    """files (file_path) without those that an ignore file's lines name, the last line that fits deciding (! takes back; a
    slash at the end means a folder, one before it a place below the root), and only those that a pattern includes."""
    path = F.col("file_path")
    out = F.lit(False)
    for line in ignored or []:
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        back, rule = rule.startswith("!"), rule.lstrip("!")
        bare = rule.strip("/")
        inner = "".join(".*" if x == "**" else "[^/]*" if x == "*" else "[^/]" if x == "?" else re.escape(x) for x in re.findall(r"\*\*|.", bare))
        begin = "^" if "/" in rule.rstrip("/") else "(^|/)"
        out = F.when(path.rlike(begin + inner + ("/" if rule.endswith("/") else "(/|$)")), F.lit(not back)).otherwise(out)
    files = files.filter(~out)
    return files.filter(F.exists(F.array(*[path.rlike(glob(p)) for p in included]), lambda x: x)) if included else files

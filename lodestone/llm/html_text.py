"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host and URL path, and each is paired with the page beside it, of the same host, whose path shares the
longer beginning with its own. Their lines (blocks of text) are aligned by longest common subsequence, and the lines that
both pages have go. Pages in a row that are copies of each other (recrawls, other query strings, mirrored rows) would delete
each other, so the page beside is the nearest one before or after the whole run of them: pages are copies when COPY of their
text agrees, by the characters in lines outside what markup sets beside it. With nothing but copies on its host a page is
compared with none. So a host whose pages all differ in less than a tenth of their text keeps the lines they share.

Markup supports the comparison where it can't know. Lines within an article or main element stay though the other page
repeats them; and what the other page lacks (or there is none) goes if it stands in navigation, headers, footers, asides,
forms, adverts, notices or comments. n_shared and n_marked count the lines that went by the one and the other.

Pages are parsed where they are read, and their lines dealt out by ranges of host, path and page_id (bounds from a sample of
SAMPLE keys a partition), so that neighbours come together and a host may hold any share of the pages. What a partition can
decide by itself is done there; its first and its last run of copies, which may go on in other partitions, meet the pages
beside them afterwards. So the result is the same for any partitioning. A run is held until it ends or its
partition does, equal lines once; aligning takes memory for the root of the other page's lines only.

Cases: null and empty pages have no text; null or unreadable URLs have the empty host and path; rows that share a page_id or
URL, or have none, each get a row; unclosed tags, comments and scripts end with their parent or the page; a very long page
takes a few times its size; an empty table gives an empty result; other columns may have any name and are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from . import bytewords as B
from .spaces import written

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|noscript|svg|math|iframe|object|textarea|select|title)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</?([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?([a-z][a-z0-9:-]*)([^>]*+)(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

# HTML's elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
MAIN = frozenset("article main".split())
BESIDE = frozenset("aside button dialog fieldset footer form head label menu nav".split())
ENDS_P = BLOCK - {"br", "button", "label", "option"}
ITEMS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "td": ("tr",), "th": ("tr",), "tr": ("table", "tbody", "thead", "tfoot"), "option": ()}
# Words of class, id and role names that mark what is beside the text.
MARKS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice popup promo related reply replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())

#: The share of two pages' text that copies have in common.
COPY = 0.9
#: Keys a partition in the sample that sets the ranges' bounds.
SAMPLE = 20
#: Characters in a batch of rows on their way out.
CHUNK = 1 << 21

_SURE, _OPEN, _BESIDE = 1, 0, 2


def lines(page: str) -> list[tuple[str, int]]:
    """The page's blocks of text, and whether each is in an article (1), beside one (2) or neither by markup (0)."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, str]] = []  # open elements: name, and whether by class or id they hold comments
    held: list[str] = []
    kinds = [_OPEN]  # of the text here, as the stack grows

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((text, kinds[-1]))
            held.clear()

    def close(to: int) -> None:
        del stack[to:], kinds[to + 1 :]

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[4] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            flush()
        if m[0][1] == "/":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in VOID or name not in BLOCK and not m[3 if m[2] else 5]:
            continue
        if name in ENDS_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if name in ITEMS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ITEMS[name]:
                    break
                if stack[i][0] == name or name in ("dt", "dd") and stack[i][0] in ("dt", "dd"):
                    close(i)
                    break
        words = {w for x in NAMES.findall(m[3 if m[2] else 5] or "") for w in re.split(r"[^a-z0-9]+", "".join(x).lower())}
        kind = kinds[-1]
        if words & MARKS and name not in ("html", "body", "main") or name in BESIDE or name == "header" and kind != _SURE:
            kind = _BESIDE
        elif (name in MAIN or "main" in words) and (kind != _BESIDE or name in MAIN and not any(n in ("aside", "footer", "nav") for n, _ in stack) and not _within(stack, "comment")):
            kind = _SURE
        if not m[0].endswith("/>") or name in BLOCK:
            stack.append((name, "comment" if words & {"comment", "comments", "disqus", "reply", "replies"} else ""))
            kinds.append(kind)
    held.append(page[at:])
    flush()
    return out


def _within(stack: list[tuple[str, str]], mark: str) -> bool:
    return any(m == mark for _, m in stack)


def common(a: Sequence, b: Sequence) -> set[int]:
    """Places in a of a longest common subsequence with b, by the bit-parallel method. Every so many of its rows are kept,
    and those between are made again on the way back."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1

    def rows(v: int, part: Sequence) -> list[int]:
        """v and the rows that follow. A zero bit at place i of a row: the subsequence of a[:i + 1] and b so far is one longer
        than that of a[:i]."""
        out = [v]
        for x in part:
            m = v & where.get(x, 0)
            v = (v + m | v - m) & full
            out.append(v)
        return out

    step = isqrt(len(b)) + 1
    parts = [b[j : j + step] for j in range(0, len(b), step)]
    kept = [full]
    for part in parts:
        kept.append(rows(kept[-1], part)[-1])
    got, i = set(), len(a) - 1
    for v, part in zip(reversed(kept[:-1]), reversed(parts), strict=True):
        below = rows(v, part)
        for j in range(len(part), 0, -1):
            while i >= 0 and below[j] >> i & 1:
                i -= 1
            if i < 0:
                return got
            if below[j - 1] >> i & 1:
                got.add(i)
                i -= 1
    return got


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


Lines = list[tuple[str, int]]


def main_text(own: Lines, other: Lines | None) -> tuple[str, int, int]:
    """The text, how many lines went because the other page has them, and how many by markup alone."""
    both = common([t for t, _ in own], [t for t, _ in other]) if other else set()
    gone = {i for i in both if own[i][1] != _SURE}
    left = [(t, kind) for i, (t, kind) in enumerate(own) if i not in gone]
    kept = [t for t, kind in left if kind != _BESIDE]
    return "\n".join(kept), len(gone), len(left) - len(kept)


def copies(a: Lines, b: Lines) -> bool:
    """Whether pages are copies: their lines (nearly) all agree, those beside the text left out."""
    x, y = (Counter(t for t, kind in page if kind != _BESIDE) for page in (a, b))
    most = max(sum(len(t) * n for t, n in c.items()) for c in (x, y))
    return most > 0 and sum(len(t) * n for t, n in (x & y).items()) >= COPY * most


@dataclass
class Page:
    host: str
    path: str
    page_id: int | None
    url: str | None
    lines: Lines

    def follows(self, other: Page) -> bool:
        """Whether this page continues a run of copies."""
        return self.host == other.host and copies(other.lines, self.lines)


def beside(page: Page, before: Page | None, after: Page | None) -> Page | None:
    """Of the pages before and after a run, that with which one of its pages is compared."""
    best = None
    for other in (before, after):
        if other and other.host == page.host and not copies(page.lines, other.lines) and (best is None or _shared(other.path, page.path) > _shared(best.path, page.path)):
            best = other
    return best


# What a row of a partition is: a page that is done; one of a run at its beginning, at its end, or of the only run there; or
# a page that others may need beside them: the first, the last, that after the first run and that before the last.
_DONE, _HEAD, _TAIL, _ONLY, _FIRST, _LAST, _AFTER, _BEFORE = range(8)
# Lines hold no line feed, so they travel as one string, and their kinds as digits.
_PAGE = "host string, path string, page_id long, url string, lines string, kinds string"
_ROWS = f"part long, role int, {_PAGE}, text string, n_shared long, n_marked long"


def _strings(own: Lines) -> tuple[str, str]:
    return "\n".join(t for t, _ in own), "".join(str(k) for _, k in own)


def _lines(texts: str, kinds: str) -> Lines:
    return list(zip(texts.split("\n"), map(int, kinds), strict=True)) if kinds else []


class _Rows:
    """Rows on their way out, as batches."""

    KINDS = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    NAMES = [x.split()[0] for x in _ROWS.split(", ")]

    def __init__(self, part: int):
        self.part, self.rows, self.size = part, [], 0

    def done(self, page: Page, found: tuple[str, int, int]) -> None:
        self.rows.append((self.part, _DONE, None, None, page.page_id, page.url, None, None, *found))
        self.size += len(found[0])

    def open(self, role: int, page: Page) -> None:
        self.rows.append((self.part, role, page.host, page.path, page.page_id, page.url, *_strings(page.lines), None, None, None))
        self.size += sum(len(t) for t, _ in page.lines)

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.size >= least or len(self.rows) >= 5000 or not least:
            columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(self.KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, self.KINDS, strict=True)], names=self.NAMES)
            self.rows, self.size = [], 0


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in order of host and path."""
    out, plain = _Rows(TaskContext.get().partitionId()), ZstdDecompressor()
    before, run, first = None, [], True
    known: dict[tuple[str, int], tuple[str, int]] = {}  # a run's lines
    for b in batches:
        for host, path, page_id, url, texts, kinds in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), b.column(5), strict=True):
            page = Page(host, path, page_id, url, _lines(plain.decompress(texts.as_py()).decode(), kinds.as_py()))
            if run and page.follows(run[-1]):
                page.lines = run[-1].lines if page.lines == run[-1].lines else [known.setdefault(x, x) for x in page.lines]
                run.append(page)
                continue
            if run and first:
                out.open(_FIRST, run[0])
                out.open(_AFTER, page)
                for one in run:
                    out.open(_HEAD, one)
                    yield from out.batches(CHUNK)
                first = False
            elif run:
                own = other = found = None
                for one in run:
                    best = beside(one, before, page)
                    if found is None or one.lines is not own or best is not other:
                        own, other = one.lines, best
                        found = main_text(own, best and best.lines)
                    out.done(one, found)
                    yield from out.batches(CHUNK)
            before = run[-1] if run else None
            run, known = [page], {x: x for x in page.lines}
    if run:
        if first:
            out.open(_FIRST, run[0])
        else:
            out.open(_BEFORE, before)
        out.open(_LAST, run[-1])
        for one in run:
            out.open(_ONLY if first else _TAIL, one)
            yield from out.batches(CHUNK)
    yield from out.batches(0)


def _pages(column: pa.StructArray) -> list[Page | None]:
    return [x and Page(x["host"], x["path"], x["page_id"], x["url"], _lines(x["lines"], x["kinds"])) for x in column.to_pylist()]


def _follows(one: pa.Array, other: pa.Array) -> pa.Array:
    return pa.array([bool(x and y and x.follows(y)) for x, y in zip(_pages(one), _pages(other), strict=True)])


def _found(page: pa.Array, before: pa.Array, after: pa.Array) -> pa.Array:
    out = []
    for x, y, z in zip(_pages(page), _pages(before), _pages(after), strict=True):
        best = beside(x, y, z)
        out.append(main_text(x.lines, best and best.lines))
    names = ("text", "n_shared", "n_marked")
    return pa.StructArray.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=names)


def _ends(parts: DataFrame) -> DataFrame:
    """part, role and the pages before and after its run, for the runs at partitions' ends. parts: _run's rows."""
    spark = parts.sparkSession
    page = F.struct("host", "path", "page_id", "url", "lines", "kinds").alias("page")
    contexts = parts.filter(F.col("role") >= _FIRST).select("part", "role", page)
    # The driver gets three numbers of each partition that has pages, no page.
    roles = contexts.groupBy("part").agg(F.max((F.col("role") == _AFTER).cast("int")).alias("more")).orderBy("part").collect()
    order, single = [r["part"] for r in roles], [not r["more"] for r in roles]
    follows = spark.createDataFrame([*zip(order[1:], order, strict=False)], "part long, prior long")
    pairs = follows.join(contexts.filter(F.col("role") == _FIRST).select("part", F.col("page").alias("one")), "part")
    pairs = pairs.join(contexts.filter(F.col("role") == _LAST).select(F.col("part").alias("prior"), F.col("page").alias("other")), "prior")
    joined = {r["part"] for r in pairs.select("part", F.arrow_udf(_follows, "boolean")("one", "other").alias("same")).filter("same").select("part").collect()}
    n, wanted = len(order), []
    back: list = [None] * n  # the page before each partition's first run: partition and role
    for i in range(1, n):
        back[i] = (order[i - 1], _LAST) if order[i] not in joined else back[i - 1] if single[i - 1] else (order[i - 1], _BEFORE)
    ahead: list = [None] * n
    for i in range(n - 2, -1, -1):
        ahead[i] = (order[i + 1], _FIRST) if order[i + 1] not in joined else ahead[i + 1] if single[i + 1] else (order[i + 1], _AFTER)
    for i, part in enumerate(order):
        if single[i]:
            wanted.append((part, _ONLY, back[i], ahead[i]))
        else:
            wanted += [(part, _HEAD, back[i], (part, _AFTER)), (part, _TAIL, (part, _BEFORE), ahead[i])]
    ends = spark.createDataFrame(wanted, "part long, role int, back struct<part:long,role:int>, ahead struct<part:long,role:int>")
    for side, name in (("back", "before"), ("ahead", "after")):
        ends = ends.join(contexts.select(F.struct("part", "role").alias(side), F.col("page").alias(name)), side, "left")
    return ends.select("part", "role", "before", "after")


def _key(host: str, path: str, page_id: int | None, url: str | None, row: int) -> tuple:
    return host, path, page_id is not None, page_id or 0, url is not None, url or "", row


def _dealt(given: DataFrame) -> DataFrame:
    """given's pages as lines (compressed), in partitions by ranges of host, path, page_id and URL, sorted by these."""
    spark = given.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows may lie in different partitions, so there may be any number of them.
    given = given.withColumn("row", F.monotonically_increasing_id())
    order = ["host", "path", "page_id", "url", "row"]
    rate = min(1.0, parts * SAMPLE / max(1, given.count()))
    some = given.select(order).filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1).collect()
    keys = sorted(_key(*r) for r in some)
    bounds = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []

    def parsed(html: pa.Array, host: pa.Array, path: pa.Array, page_id: pa.Array, url: pa.Array, row: pa.Array) -> pa.Array:
        found, pressed = [_strings(lines(x.as_py() or "")) for x in html], ZstdCompressor()
        part = [bisect_right(bounds, _key(*key)) for key in zip(*(x.to_pylist() for x in (host, path, page_id, url, row)), strict=True)]
        return pa.StructArray.from_arrays([pa.array(part, pa.int32()), pa.array([pressed.compress(t.encode()) for t, _ in found], pa.binary()), pa.array([k for _, k in found], pa.string())], names=["part", "lines", "kinds"])

    page = F.arrow_udf(parsed, "part int, lines binary, kinds string")("html", *order).alias("page")
    dealt = given.select(*order, page).select(*order, "page.*").repartitionById(parts, "part").sortWithinPartitions(*order)
    return dealt.select("host", "path", "page_id", "url", "lines", "kinds")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines that went because the paired page has them) and n_marked (lines that
    went by markup alone)."""
    B.lean(pages.sparkSession)
    url = F.col("url").cast("string")
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    given = pages.select(host.alias("host"), path.alias("path"), F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"))
    parts, _ = written(_dealt(given).mapInArrow(B.tidy(_run), _ROWS))
    done = parts.filter(F.col("role") == _DONE).select("page_id", "url", "text", "n_shared", "n_marked")
    open_ = parts.filter(F.col("role").isin(_HEAD, _TAIL, _ONLY)).select("part", "role", F.struct("host", "path", "page_id", "url", "lines", "kinds").alias("page"))
    found = F.arrow_udf(_found, "text string, n_shared long, n_marked long")("page", "before", "after").alias("found")
    late = open_.join(_ends(parts), ["part", "role"]).select("page.page_id", "page.url", found).select("page_id", "url", "found.*")
    return done.unionByName(late).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared", "n_marked")

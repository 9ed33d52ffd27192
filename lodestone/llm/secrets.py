"""Secret scans by a trigram inverted index, in DataFrame functions alone.

From each rule's regular expression come Boolean trigram queries. An index has the postings (trigram, document) of the
queries' trigrams over the lower-cased whole texts; the postings are intersected to candidate (document, rule) pairs, and only
candidates are matched. Rules without a mandatory trigram scan all texts. Rows without a doc_id are known to the index by
their text's hash; a key that several rows share only makes more candidates, which are verified one by one.

Places are code points. Rules are matched leftmost and without overlap, each for itself; then matches that are too short go.

Cases: null and empty texts have no spans; rows that share a doc_id, or have none, each get a row; a very long text is matched
whole, in memory for a few times its size; an empty table gives an empty result; other columns may have any name and are
ignored (scan) or kept (redacted).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trigrams import query


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # characters of the group
    group: int = 0


# The rules, in the order of their kinds. For access and hex the least length is in the pattern itself: their
# runs are maximal, so that a match by length is the same as a longer match filtered.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE = 3
SPANS = "array<struct<start:int,rule:int,end:int>>"


def postings(keyed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """trigram, key: the index of all trigrams that the rules ask for. keyed: key, text."""
    grams = sorted({g for r in rules for clause in query(r.pattern) for alt in clause for g in alt})
    # The lower-cased text is a variable of the outer function, so that it is made once a row.
    present = F.flatten(F.transform(F.array(F.lower("text")), lambda low: F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(low, g))))
    return keyed.select(F.explode(present).alias("trigram"), "key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, rules: the numbers of the rules whose trigram query the document's postings satisfy."""
    spark = index.sparkSession
    wanted = [(i, j, k, g) for i, r in enumerate(rules) for j, clause in enumerate(query(r.pattern)) for k, alt in enumerate(sorted(map(sorted, clause))) for g in alt]
    need = spark.createDataFrame(wanted, "rule int, clause int, alt int, trigram string")
    sizes = need.groupBy("rule", "clause", "alt").agg(F.count("*").alias("size"))
    number = need.select("rule", "clause").distinct().groupBy("rule").agg(F.count("*").alias("clauses"))
    # The rules' trigrams are a table of fixed size.
    met = index.join(F.broadcast(need.join(sizes, ["rule", "clause", "alt"]).join(number, "rule")), "trigram")
    alts = met.groupBy("key", "rule", "clause", "alt").agg(F.countDistinct("trigram").alias("n"), F.first("size").alias("size"), F.first("clauses").alias("clauses")).filter("n = size")
    hold = alts.groupBy("key", "rule").agg(F.countDistinct("clause").alias("n"), F.first("clauses").alias("clauses")).filter("n = clauses")
    return hold.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _spans(number: int, rule: Rule) -> Column:
    """All spans of a rule in text: what lies between the matches and the matches themselves add up to places."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    parts = F.struct(F.split(text, rule.pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("groups"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPANS})").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        first = state["at"] + F.length(x["gap"])
        last = first + F.length(x["hit"])
        span = F.array(F.struct(first.alias("start"), F.lit(number).alias("rule"), last.alias("end")))
        return F.struct(last.alias("at"), F.when(F.length(x["group"]) >= rule.least, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def add(p: Column) -> Column:
        each = F.arrays_zip(F.slice(p["gaps"], F.lit(1), F.size(p["hits"])).alias("gap"), p["hits"].alias("hit"), p["groups"].alias("group"))
        return F.aggregate(each, start, step, lambda s: s["spans"])

    return F.flatten(F.transform(F.array(parts), add))


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs' columns and __spans (SPANS), sorted by start, then rule."""
    names = docs.columns
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    keyed = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"))
    found = candidates(postings(keyed, rules), rules)
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key.alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The candidates' rows are short; hashing them spares sorting the texts.
    joined = texts.join(found.hint("shuffle_hash"), "key", "left")
    none = F.expr(f"cast(array() as {SPANS})")
    each = []
    for i, r in enumerate(rules):
        asked = F.coalesce(F.array_contains("rules", i), F.lit(False)) if query(r.pattern) else F.lit(True)
        each.append(F.when(asked & F.col("text").rlike(r.pattern), _spans(i, r)).otherwise(none))
    spans = F.array_sort(F.concat(*each))
    return joined.select("row.*", spans.alias("__spans"))


def _digest(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the three base kinds' spans) and spans (of all kinds), a row for each
    row of docs."""
    got = with_spans(docs.select("doc_id", "text"), rules).select("doc_id", "__spans")
    spans = F.col("__spans")

    def number(i: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["rule"] == i)).cast("long")

    counts = [number(i).alias(f"n_{r.kind}") for i, r in enumerate(rules[:BASE])]
    base = F.sha2(_digest(F.filter(spans, lambda s: s["rule"] < BASE), rules).cast("binary"), 256)
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, base.alias("base_sha256"), _digest(spans, rules).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span, or run of overlapping spans, replaced by the mark in text, and n_chars, if it is there, counted
    anew; all rows stay."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("made"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring("text", state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        more = F.concat(state["made"], gap, F.when((s["start"] >= state["at"]) | (state["made"] == ""), F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), more.alias("made"))

    made = F.aggregate("__spans", start, step, lambda s: F.concat(s["made"], F.substring("text", s["at"] + 1, F.length("text"))))
    out = with_spans(docs, rules).withColumn("text", F.when(F.size("__spans") > 0, made).otherwise(F.col("text"))).drop("__spans")
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out

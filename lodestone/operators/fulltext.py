"""Field-weighted full-text scoring, lanes of a search, and vocabularies."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARKED, PLAIN, words

K1, B = 1.2, 0.75
#: Terms of a query that count.
TERMS = 12


def phrase(term: str) -> list[str]:
    """The words of a query item; more than one make a phrase."""
    return re.findall(r"[^\W_]+", term.lower().translate(str.maketrans(MARKED, PLAIN)))


def _phrases(tokens: Column, wanted: list[str]) -> Column:
    """How often the words follow each other in tokens."""
    # Each word has a space of its own on both sides, and a look-ahead counts overlapping places too.
    line = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
    return F.regexp_count(line, F.lit(f"(?= {'  '.join(wanted)} )"))


def bm25(rows: DataFrame, key: str, fields: Mapping[str, float], terms: Sequence[str], every: bool = False) -> DataFrame:
    """key and score of the rows that hold any term (every: all terms, in whichever fields).

    A term's frequency is weighted by field; a row's length is all its words. The counts are made row by row, in one pass;
    what the score needs of the whole (rows, words, rows with each term) is one row, found in a second pass over the
    same small projection. Nothing is shuffled by word.
    """
    items = [p for p in map(phrase, list(terms)[:TERMS]) if p]
    if not items or every and len(items) < 2:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    tokens = rows.select(key, *[words(F.col(f)).alias(f"w{i}") for i, f in enumerate(fields)])
    single = [p[0] for p in items if len(p) == 1]
    # Of each field stays its length, its words that the query has, and the counts of its phrases.
    kept = []
    for i in range(len(fields)):
        w = F.col(f"w{i}")
        kept += [F.size(w).alias(f"l{i}"), F.filter(w, lambda t: t.isin(single) if single else F.lit(False)).alias(f"h{i}")]
        kept += [_phrases(w, p).alias(f"p{i}_{j}") for j, p in enumerate(items) if len(p) > 1]
    small = tokens.select(key, *kept)

    def times(word: str, i: int) -> Column:
        return F.size(F.filter(F.col(f"h{i}"), lambda t: t == word))

    hits = [[times(p[0], i) if len(p) == 1 else F.col(f"p{i}_{j}") for i in range(len(fields))] for j, p in enumerate(items)]
    length = sum((F.col(f"l{i}") for i in range(len(fields))), F.lit(0)).alias("length")
    freq = [sum((w * h for w, h in zip(fields.values(), hs, strict=True)), F.lit(0.0)).alias(f"f{j}") for j, hs in enumerate(hits)]
    counted = small.select(key, length, *freq)
    whole = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"f{j}") > 0).alias(f"n{j}") for j in range(len(items))])
    has = [F.col(f"f{j}") > 0 for j in range(len(items))]
    idf = [F.log((F.col("n") - F.col(f"n{j}") + 0.5) / (F.col(f"n{j}") + 0.5)) for j in range(len(items))]
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean"))
    total = sum((F.when(i > 0, i).otherwise(1e-6) * F.col(f"f{j}") * (K1 + 1) / (F.col(f"f{j}") + norm) for j, i in enumerate(idf)), F.lit(0.0))
    some = has[0]
    for h in has[1:]:
        some = some & h if every else some | h
    # `whole` is one row. A row without a hit has no score, and a test of the score, which needs `whole`, stays above the join:
    # a test of the counts would move below them and count all over again.
    return counted.crossJoin(F.broadcast(whole)).select(key, F.when(some, total).otherwise(0.0).alias("score")).filter(F.col("score") > 0)


def top(scored: DataFrame, key: str, n: int) -> DataFrame:
    """The n best, by the score to nine places, then the key."""
    return scored.orderBy(F.round("score", 9).desc(), F.col(key)).limit(n)


def exact_lane(rows: DataFrame, key: str, name: str, path: str, identifiers: Sequence[str], limit: int) -> DataFrame:
    """Rows whose name holds an identifier (100), and those whose path does (80); an underscore stands for any character."""
    parts = []
    for ident in identifiers:
        for column, score in ((name, 100.0), (path, 80.0)):
            parts.append(rows.filter(F.col(column).ilike(f"%{ident}%")).select(key, F.lit(score).alias("score")).orderBy(key).limit(limit))
    out = parts[0] if parts else rows.select(key, F.lit(0.0).alias("score")).limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.max("score").alias("score"))


def vocabulary(rows: DataFrame, key: str, text: str) -> DataFrame:
    """term, doc (rows that have it), cnt (occurrences)."""
    each = rows.select(key, F.explode(words(F.col(text))).alias("term")).groupBy(key, "term").count()
    return each.groupBy("term").agg(F.count("*").alias("doc"), F.sum("count").alias("cnt"))


def nearest_terms(vocab: DataFrame, terms: Sequence[str], limit: int) -> DataFrame:
    """Terms that begin as the first five query words do (three characters), most frequent first."""
    starts = sorted({t[:3].lower() for t in list(terms)[:5] if len(t) >= 2})
    test = F.lit(False)
    for s in starts:
        test = test | F.col("term").startswith(s)
    return vocab.filter(test).select("term", "doc").orderBy(F.col("doc").desc(), "term").limit(limit)


def overlap_score(text: Column, query: Sequence[str]) -> Column:
    """The share of the query's words that text has, half for those that only a prefix joins."""
    own, asked = F.array_distinct(words(text)), F.array(*[F.lit(q) for q in dict.fromkeys(query)])

    def each(q: Column) -> Column:
        return F.when(F.array_contains(own, q), 1.0).when(F.exists(own, lambda w: F.startswith(q, w) | F.startswith(w, q)), 0.5).otherwise(0.0)

    total = F.aggregate(F.transform(asked, each), F.lit(0.0), lambda a, x: a + x)
    return total / len(set(query))

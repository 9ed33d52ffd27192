"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are words (runs of letters, digits and bytes beyond ASCII; A-Z lower-cased). An item that
shares a seed, `least` words in a row, with a document is a candidate. Between a document and each of its candidates,
running Karp-Rabin matching marks the longest non-overlapping matches again and again, down to matches of `least` words.
An item whose words are covered to `coverage` or more is contained, whatever the order of its passages.

An item of fewer words is one seed itself. What an item's shared seeds cover bounds its coverage, so only items that may be
contained, or be the most covered one, are tiled: a seed that many items have costs no tiling of them all. Items of equal
text are one. The benchmark goes to the executors in parts of about PART_WORDS words (or one longer item), each with a pass
of its own, so what a task holds is bounded; an ordinary benchmark is one part.

Cases: null and empty texts and items have no words and match nothing; rows that share a doc_id or an item_id, or have
none, count each for itself (a contained item without an id counts in n_items only); an empty benchmark leaves all
documents clean; very long texts take memory in proportion to their words, and repetitive ones no more (pairs of equal runs
are looked at PAIRS at a time, and only maximal matches are kept); other columns may have any name and are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .spaces import unused, written

PART_WORDS = 2_000_000
#: Pairs of equal runs looked at in one go.
PAIRS = 1 << 18
#: The length that Karp-Rabin matching searches for first.
FIRST = 32


def _hashes(column) -> list[np.ndarray]:
    out = []
    for s in B.slices(column):
        low = B.Slice(s.first, s.offsets, B.LOWER[s.data])
        w = B.words(low, B.PUNCT)
        h = B.Prefix(low.data).spans(w.starts, w.ends)
        out += [h[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    return out


def _runs(words: np.ndarray, free: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the runs of k free words."""
    h, at = B.runs(words, np.array([0, len(words)]), k)
    taken = np.concatenate([[0], np.cumsum(~free)])
    whole = taken[at + k] == taken[at]
    return h[whole], at[whole]


def _meet(doc: np.ndarray, item: np.ndarray, free_d: np.ndarray, free_i: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Maximal matches of at least k free words, longest first: length, place in doc, place in item."""
    hd, at_d = _runs(doc, free_d, k)
    hi, at_i = _runs(item, free_i, k)
    order = np.argsort(hi, kind="stable")
    hi, at_i = hi[order], at_i[order]
    lo, up = np.searchsorted(hi, hd, "left"), np.searchsorted(hi, hd, "right")
    n = up - lo
    total, found, first = np.cumsum(n), [], 0
    while first < len(n):
        # Places in doc whose pairs are at most PAIRS, or one place.
        last = max(first + 1, int(np.searchsorted(total, total[first] - n[first] + PAIRS, "right")))
        m, skip = n[first:last], lo[first:last]
        p = np.repeat(at_d[first:last], m)
        q = at_i[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(skip, m)]
        # A match begins where the pair of words before is none.
        prior = (p > 0) & (q > 0)
        prior[prior] = (doc[p[prior] - 1] == item[q[prior] - 1]) & free_d[p[prior] - 1] & free_i[q[prior] - 1]
        found += [(_length(doc, item, free_d, free_i, a, b), a, b) for a, b in zip(p[~prior].tolist(), q[~prior].tolist(), strict=True)]
        first = last
    return sorted(found, key=lambda x: (-x[0], x[1], x[2]))


def _length(doc: np.ndarray, item: np.ndarray, free_d: np.ndarray, free_i: np.ndarray, a: int, b: int) -> int:
    """Of the match that begins at a and b."""
    most, at, step = min(len(doc) - a, len(item) - b), 0, 64
    while at < most:
        to = min(most, at + step)
        ends = np.flatnonzero((doc[a + at : a + to] != item[b + at : b + to]) | ~free_d[a + at : a + to] | ~free_i[b + at : b + to])
        if len(ends):
            return at + int(ends[0])
        at, step = to, 2 * step
    return most


def greedy_tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Length, place in doc and place in item of each tile. Of equally long matches the one that is earlier in doc, then in
    item, is marked first."""
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles, k = [], max(least, min(FIRST, len(item)))
    while True:
        found = _meet(doc, item, free_d, free_i, k)
        if found and found[0][0] > 2 * k:
            k = found[0][0]
            continue
        for n, a, b in found:
            if free_d[a : a + n].all() and free_i[b : b + n].all():
                free_d[a : a + n] = free_i[b : b + n] = False
                tiles.append((n, a, b))
            else:
                break  # what is left of this one may be shorter than others: look again
        else:
            if k <= least:
                return tiles
            k = max(least, k // 2)


class Seeds:
    """The seeds of items, and which words of an item seeds cover."""

    def __init__(self, items: list[np.ndarray], least: int):
        sizes = np.array([len(x) for x in items], np.int64)
        self.base = np.concatenate([[0], np.cumsum(sizes)])  # the items' words in a row
        self.kinds = []
        for k in sorted({min(least, int(n)) for n in sizes if n}):
            h, place = [], []
            for i in np.flatnonzero(np.minimum(sizes, least) == k):
                got, at = B.runs(items[i], np.array([0, sizes[i]]), k)
                h.append(got)
                place.append(at + self.base[i])
            h, place = np.concatenate(h), np.concatenate(place)
            order = np.lexsort((place, h))
            known, first = np.unique(h[order], return_index=True)
            self.kinds.append((k, known, np.append(first, len(h)), place[order]))

    def covered(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each document that has seeds: its number, the items that share one, and how many words of each the shared
        seeds cover: no tiling covers more."""
        hits = []
        for kind, (k, known, _, _) in enumerate(self.kinds):
            h, at = B.runs(words, bounds, k)
            i = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = np.flatnonzero(known[i] == h)
            doc = np.searchsorted(bounds, at[hit], "right") - 1
            hits.append(np.unique(np.column_stack([doc, np.full(len(hit), kind), i[hit]]), axis=0))
        hits = np.concatenate(hits) if hits else np.zeros((0, 3), np.int64)
        for d in np.unique(hits[:, 0]).tolist():
            of, n = [], []
            for kind, (k, _, first, place) in enumerate(self.kinds):
                i = hits[(hits[:, 0] == d) & (hits[:, 1] == kind), 2]
                m = first[i + 1] - first[i]
                at = np.sort(place[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[i], m)])
                if len(at):
                    item = np.searchsorted(self.base, at, "right") - 1
                    far = np.append(np.where(item[1:] == item[:-1], np.minimum(at[1:] - at[:-1], k), k), k)
                    ids, which = np.unique(item, return_inverse=True)
                    of.append(ids)
                    n.append(np.bincount(which, far).astype(np.int64))
            yield d, np.concatenate(of), np.concatenate(n)


def _scan(items: list[np.ndarray], names: list, rows: list[int], least: int, coverage: float):
    """items: different ones, in the order of names (nulls last); rows: how many items of the benchmark are equal to each."""
    seeds = Seeds(items, least)

    def run(column: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        for s in B.slices(column):
            low = B.Slice(s.first, s.offsets, B.LOWER[s.data])
            w = B.words(low, B.PUNCT)
            words = B.Prefix(low.data).spans(w.starts, w.ends)
            out += [[] for _ in range(s.n)]
            for d, of, n in seeds.covered(words, w.bounds):
                doc, best, at = words[w.bounds[d] : w.bounds[d + 1]], 0.0, len(items)
                most = n / np.array([len(items[j]) for j in of])
                for i in np.lexsort((of, -most)).tolist():
                    j = int(of[i])
                    if most[i] < min(coverage, best):
                        break
                    if most[i] < coverage and most[i] == best and j > at:
                        continue
                    got = sum(t[0] for t in greedy_tiles(doc, items[j], min(least, len(items[j])))) / len(items[j])
                    if got >= coverage or got >= best:
                        out[-s.n + d].append({"item_id": names[j], "coverage": got, "n": rows[j]})
                    if got > best or got == best and j < at:
                        best, at = got, j
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("n", pa.int64())])))

    return run


_FOUND = "array<struct<item_id:long,coverage:double,n:long>>"


def matches(docs: DataFrame, benchmark: DataFrame, name: str, least: int = 5, coverage: float = 0.5) -> DataFrame:
    """docs' columns and one called `name`: array of item_id, coverage and n (equal items), with all items covered to
    `coverage` and, where there is none, the most covered one among others."""
    spark = docs.sparkSession
    B.lean(spark)
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    texts = texts.groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n"))
    words = texts.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10ffff}]+")))).first()[0] or 0
    parts = max(1, math.ceil(words / PART_WORDS))
    out = docs
    for part in range(parts):
        # A part is of about PART_WORDS words, or one longer item.
        some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).orderBy(F.col("item_id").asc_nulls_last(), "text").toArrow()
        items = _hashes(some.column("text"))
        scan = B.column(_scan(items, some.column("item_id").to_pylist(), some.column("n").to_pylist(), least, coverage), _FOUND)
        found = scan(F.col("text").cast("string"))
        out = out.withColumn(name, F.concat(F.col(name), found) if part else found)
        if parts > 1:
            out, _ = written(out)  # so that no task holds two parts
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5) -> DataFrame:
    """doc_id, contaminated, n_items (items covered to `coverage`), item_id (of the most covered item, the smallest of
    equals) and its coverage (0 where nothing is shared), a row for each row of docs."""
    items = F.col("items")
    best = F.array_sort(items, lambda a, b: F.when(a["coverage"] > b["coverage"], -1).when(a["coverage"] < b["coverage"], 1).when(F.coalesce(a["item_id"], F.lit(2**63 - 1)) < F.coalesce(b["item_id"], F.lit(2**63 - 1)), -1).otherwise(1))
    found = matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, "items", least, coverage)
    n = F.aggregate(F.filter(items, lambda x: x["coverage"] >= coverage), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    top = F.get(best, F.lit(0))
    return found.select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), top["item_id"].alias("item_id"), F.coalesce(top["coverage"], F.lit(0.0)).alias("coverage"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5) -> DataFrame:
    """docs less those that contain an item; their columns as they are."""
    name = unused(docs, "items")
    return matches(docs, benchmark, name, least, coverage).filter(~F.exists(name, lambda x: x["coverage"] >= coverage)).drop(name)

"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at `radius` or fewer differing bits by tiled exact
comparison (exclusive-or and bit counts in numpy), and connected into groups.

Equal fingerprints are one node. Population counts are taken in each of four 16-bit quarters: the counts of two fingerprints
differ by no more, summed over the quarters, than their bits do, so tile pairs whose counts are farther apart than the radius
are skipped and no link is lost. That happens twice. Nodes are dealt into cells of bounded size by their counts, and only
pairs of cells that the counts don't rule out are shuffled together, each pair a task that holds two bounded arrays; within a
task nodes form tiles of equal counts. A task returns the links it found as stars (each node with the smallest node it
reaches there), never all pairs, so a group of n near copies gives fewer than n rows a task.

The comparison is quadratic in the number of different fingerprints, less what the counts rule out (over nine tenths of the
pairs of random fingerprints). The driver gets the counts' histogram (at most 17 ** 4 rows), never fingerprints.

Cases: null and empty texts, and texts of white space, have no words and fingerprint zero, which links like any other;
texts are taken PIECE bytes at a time, so a very long one takes a few times its own size; rows that share a doc_id or have
none each get a row, and null doc_ids are no one's component_id unless nothing else is reachable; an empty table gives an
empty result; other columns may have any name and are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .components import Forest, components
from .spaces import unused, written

SEED = 42
#: Bytes of a text that are taken at a time, and comparisons in one go.
PIECE, BLOCK = 1 << 18, 1 << 20
#: Fingerprints in one of a task's two arrays at most; smaller tables make CELLS cells of CELL at least.
GROUP, CELL, CELLS = 1 << 16, 1 << 12, 12
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """text in pieces of about PIECE bytes that end where a word does."""
    at = 0
    while len(text) - at > PIECE:
        end = SPACE.search(text, at + PIECE)
        if not end:
            break
        yield text[at : end.start()]
        at = end.end()
    yield text[at:]


def _ones(hashes: bytes) -> np.ndarray:
    """How many hashes (of eight big-endian bytes) have each bit."""
    return np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def shingle_hashes(words: list[bytes], k: int) -> bytes:
    """XXH64 of each k words in a row, eight big-endian bytes each."""
    digest = xxhash.xxh64_digest
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    return b"".join([digest(line[i:j], SEED) for i, j in zip(starts, ends[k - 1 :].tolist(), strict=True)])


def fingerprint_of(text: bytes, k: int) -> int:
    """A text's fingerprint, held piece by piece."""
    ones, n, held = np.zeros(64, np.int64), 0, []
    for piece in _pieces(text):
        held += piece.lower().split()
        if len(held) >= k:
            hashes = shingle_hashes(held, k)
            ones, n = ones + _ones(hashes), n + len(hashes) // 8
            held = held[len(held) - k + 1 :]
    if not n:
        if not held:
            return 0
        ones, n = _ones(xxhash.xxh64_digest(b" ".join(held), SEED)), 1
    return int(np.packbits(2 * ones > n).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprint(text: Column, k: int = 4) -> Column:
    """The fingerprint's bits as a signed long."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(x.as_buffer().to_pybytes(), k) if x.is_valid else 0 for x in column], pa.int64())

    return B.column(run, "long")(text.cast("string"))


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, fp, a row for each row of docs."""
    B.lean(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text"), k).alias("fp"))


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def links(left: np.ndarray, right: np.ndarray | None, radius: int, forest: Forest, at_left: np.ndarray, at_right: np.ndarray | None) -> None:
    """Join in forest what lies within the radius; right None: pairs within left."""
    own = right is None
    if own:
        right, at_right = left, at_left
    tiles = []
    for fp in (left, right):
        q = _quarters(fp)
        kinds, of = np.unique(q, axis=0, return_inverse=True)
        order = np.argsort(of.ravel(), kind="stable")
        tiles.append((kinds, order, np.searchsorted(of.ravel()[order], np.arange(len(kinds) + 1))))
    (kinds_l, order_l, bounds_l), (kinds_r, order_r, bounds_r) = tiles
    sizes = np.diff(bounds_r)
    for t, kind in enumerate(kinds_l):
        near = np.abs(kinds_r - kind).sum(axis=1) <= radius
        if own:
            near[:t] = False
        these = order_r[np.repeat(near, sizes)]
        if not len(these):
            continue
        mine, theirs = order_l[bounds_l[t] : bounds_l[t + 1]], right[these]
        step = max(1, BLOCK // len(these))
        for i in range(0, len(mine), step):
            some = mine[i : i + step]
            x, y = np.nonzero(np.bitwise_count(left[some][:, None] ^ theirs[None, :]) <= radius)
            if len(x):
                forest.join(at_left[some[x]], at_right[these[y]])


class Cells:
    """Nodes dealt into cells of at most `most` by the bit counts of their quarters: kinds of counts are halved along the
    quarter in which they spread most, and a kind of more nodes than that is dealt out at random. kinds: n x 4, sizes: n."""

    def __init__(self, kinds: np.ndarray, sizes: np.ndarray, most: int):
        self.first = np.zeros(17**4, np.int32)
        self.split = np.ones(17**4, np.int32)
        low, high, todo = [], [], [np.arange(len(kinds))] if len(kinds) else []
        while todo:
            own = todo.pop()
            if sizes[own].sum() > most and len(own) > 1:
                wide = np.argmax(kinds[own].max(axis=0) - kinds[own].min(axis=0))
                own = own[np.argsort(kinds[own][:, wide], kind="stable")]
                counts, total = kinds[own][:, wide], np.cumsum(sizes[own])
                cuts = np.flatnonzero(counts[1:] != counts[:-1]) + 1
                at = cuts[np.argmin(np.abs(total[cuts - 1] - total[-1] / 2))]
                todo += [own[:at], own[at:]]
                continue
            n = -(-int(sizes[own].sum()) // most) if len(own) == 1 else 1
            at = self.code(kinds[own])
            self.first[at], self.split[at] = len(low), n
            low += [kinds[own].min(axis=0)] * n
            high += [kinds[own].max(axis=0)] * n
        self.low, self.high = np.array(low, np.int8).reshape(-1, 4), np.array(high, np.int8).reshape(-1, 4)

    @staticmethod
    def code(kinds: np.ndarray) -> np.ndarray:
        return kinds.astype(np.int64) @ np.array([17**3, 17**2, 17, 1])

    def of(self, fp: np.ndarray) -> np.ndarray:
        """Each node's cell."""
        at = self.code(_quarters(fp))
        return self.first[at] + (B.mix(fp.view(np.uint64)) % self.split[at].astype(np.uint64)).astype(np.int64)

    def near(self, cell: int, radius: int) -> np.ndarray:
        """The cells that may hold nodes within the radius of one of this cell, itself included."""
        apart = np.maximum(0, np.maximum(self.low - self.high[cell], self.low[cell] - self.high)).astype(np.int64)
        return np.flatnonzero(apart.sum(axis=1) <= radius)


def _dealt(cells: Cells, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            of = cells.of(fp)
            order = np.argsort(of, kind="stable")
            fp, of = fp[order], of[order]
            keys, at = np.unique(of, return_index=True)
            ends = [*at[1:], len(of)][: len(keys)]
            near = [cells.near(k, radius) for k in keys.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([fp[i:j].tobytes() for i, j in zip(at, ends, strict=True)], pa.binary()), pa.array(near, pa.list_(pa.int64()))], names=["part", "fps", "others"])

    return run


def _compare(radius: int):
    def run(key, table):
        parts = table.column("part").to_numpy()
        blobs = table.column("fps").to_pylist()
        sides = [np.frombuffer(b"".join(b for b, p in zip(blobs, parts, strict=True) if p == part), np.int64) for part in sorted(set(parts.tolist()))]
        nodes = np.sort(np.concatenate(sides))
        at = [np.searchsorted(nodes, s) for s in sides]
        forest = Forest(len(nodes))
        if key[0].as_py() == key[1].as_py():
            links(sides[0].view(np.uint64), None, radius, forest, at[0], None)
        elif len(sides) == 2:
            links(sides[0].view(np.uint64), sides[1].view(np.uint64), radius, forest, *at)
        moved = np.flatnonzero(forest.up != np.arange(len(nodes)))
        return pa.table({"a": pa.array(nodes[moved]), "b": pa.array(nodes[forest.up[moved]])})

    return run


def _bits(n: int) -> Column:
    return F.bit_count(F.shiftrightunsigned("fp", 16 * n).bitwiseAND(F.lit(0xFFFF))).alias(f"q{n}")


def linked(fps: DataFrame, radius: int = 4) -> DataFrame:
    """fps: fp long, all different. node and component, for those that are not alone."""
    # At most 17 ** 4 kinds of counts, whatever the input's size.
    counts = np.array(fps.groupBy(*[_bits(n) for n in range(4)]).count().toPandas(), np.int64).reshape(-1, 5)
    counts = counts[np.lexsort(counts.T[:4])]
    total = int(counts[:, 4].sum())
    cells = Cells(counts[:, :4], counts[:, 4], min(GROUP, max(CELL, -(-total // CELLS))))
    dealt = fps.select("fp").mapInArrow(_dealt(cells, radius), "part long, fps binary, others array<long>")
    pairs = dealt.select("part", "fps", F.explode("others").alias("other"))
    pairs = pairs.select(F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "fps")
    return components(pairs.groupBy("one", "two").applyInArrow(_compare(radius), "a long, b long"))


def grouped(each: DataFrame, radius: int = 4) -> DataFrame:
    """each: a written table with fp and doc_id. Its columns, component (a fingerprint of the group) and component_id (the
    smallest doc_id that it reaches by links)."""
    nodes, _ = written(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = linked(nodes.select("fp"), radius)
    # Only nodes with links have a component to look up; the others keep their own smallest doc_id.
    named = nodes.join(found, nodes["fp"] == found["node"])
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(least, "component").select("fp", F.col("component_id").alias("joined"), "component")
    nodes = nodes.join(of, "fp", "left").select("fp", F.coalesce("joined", "least").alias("component_id"), F.coalesce("component", "fp").alias("component"))
    return each.join(nodes, "fp").select(*each.columns, "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that it reaches by links)."""
    each, _ = written(fingerprints(docs, k))
    return grouped(each, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """docs' columns; of each group one row stays, that with the smallest doc_id (of several rows with that doc_id the one with
    the smallest fingerprint, then the first in the table's order), and rows without a doc_id."""
    B.lean(docs.sparkSession)
    fp, row = unused(docs, "fp"), unused(docs, "row")
    # Numbered and fingerprinted once; texts then travel once at most, to meet the rows that go.
    numbered, _ = written(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(fp, fingerprint(F.col("text"), k)))
    each = numbered.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row")).filter("doc_id is not null")
    groups, _ = written(grouped(each, radius).select("component", F.struct("doc_id", "fp", "row").alias("at")))
    first = groups.groupBy("component").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    gone = groups.join(first, "component").filter(F.col("at") != F.col("first")).select(F.col("at.row").alias(row))
    gone, _ = written(gone)  # a table of known size: few enough rows are broadcast, and texts stay where they are
    return numbered.join(gone, row, "left_anti").select(*docs.columns)

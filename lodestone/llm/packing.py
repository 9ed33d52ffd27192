"""Best-fit packing of tokenized documents by length-histogram planning.

Documents become ids, and those above the capacity are cut into pieces of exactly the capacity and a rest. Only the
histogram of piece lengths (at most `capacity` counts) comes to the driver. There best fit runs over counts, longest
first: all pieces of a length that meet the same remaining room are placed in one step, so the plan is a table of
(length, first rank, count, first sequence, offset) and its size follows the number of lengths, not of documents. Pieces
then take the slots that their rank within their length has in the plan. Ranks come from groups of about RANKS pieces of
one length and the groups' sums, so one length may hold any share of all pieces.

Cases: a null or empty text is the end id alone; rows that share a doc_id, or have none, are packed each for itself; a very
long text becomes pieces of the capacity, its ids (four bytes each) held at once; an empty table gives an empty result; other columns are ignored. Special tokens' strings in a text become what the
tokenizer makes of them.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytewords as B
from .spaces import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RANKS = 20_000
#: Different words that a worker keeps with their ids, some 40 bytes each, and bytes of text looked at in one go.
WORDS, SLICE = 1_200_000, 1 << 20

# Fixed by the vocabulary file: kinds of bytes in UTF-8 text of ASCII and Latin-1 letters: 0 white space, 1 letters, 2 digits, 3
# other signs, 4 what such text doesn't have, or what needs the tokenizer itself (an apostrophe, which may join letters).
_KIND = np.full(256, 4, np.uint8)
_KIND[0x20:0x7F] = 3
_KIND[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x27] = 4


class Encoder:
    """ids of whole texts as a tokenizer of word_bpe_49k.json's kind gives them: it lower-cases, parts words at white space
    and at changes between letters, digits (each a word) and the rest, and joins nothing across these parts. So a slice's
    words are found in its bytes at once, told apart by 64-bit hashes, and each different one is encoded once. Texts with characters for which that is
    not certain, or with special tokens, go to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Words by their 64-bit hash, sorted, and where their ids are in `ids`.
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _words(self, h: np.ndarray, blob: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where in an array of ids those of each word are, how many, and the array. h: sorted."""
        place = np.searchsorted(self.hashes, h)
        there = np.zeros(len(h), bool)
        if len(self.hashes):
            there = self.hashes[np.minimum(place, len(self.hashes) - 1)] == h
        at, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        at[there], size[there] = self.at[place[there]], self.size[place[there]]
        new = np.flatnonzero(~there)
        fresh = [self.tokenizer.encode(blob[a:b].decode(), add_special_tokens=False).ids for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
        size[new] = [len(x) for x in fresh]
        at[new] = len(self.ids) + np.cumsum(size[new]) - size[new]
        ids = np.concatenate([self.ids, np.array([i for x in fresh for i in x], np.uint32)])
        if len(self.hashes) + len(new) <= WORDS:
            self.hashes, self.at, self.size, self.ids = np.insert(self.hashes, place[new], h[new]), np.insert(self.at, place[new], at[new]), np.insert(self.size, place[new], size[new]), ids
        return at, size, ids

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for s in B.slices(column, SLICE):
            for i, ids in enumerate(self._slice(s)):
                yield self.whole(s.data[s.offsets[i] : s.offsets[i + 1]].tobytes().decode()) if ids is None else ids

    def _slice(self, s: B.Slice) -> Iterator[np.ndarray | None]:
        data = s.data
        if not len(data):
            yield from (np.zeros(0, np.uint32) for _ in range(s.n))
            return
        kind = _KIND[data]
        after = np.zeros(len(data), bool)  # what stands behind the first byte of a Latin-1 letter
        after[1:] = data[:-1] == 0xC3
        odd = (kind == 4) | after & ((data == 0x97) | (data == 0xB7))
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        low = B.LOWER[data]
        low[after & (data >= 0x80) & (data <= 0x9E)] += 0x20
        new = np.ones(len(data), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        new[s.offsets[:-1][s.offsets[:-1] < len(data)]] = True
        at = np.flatnonzero(new)
        ends = np.append(at[1:], len(data))
        word = kind[at] != 0
        starts, ends = at[word], ends[word]
        bounds = np.searchsorted(starts, s.offsets)
        plain = np.bincount(np.searchsorted(s.offsets, np.flatnonzero(odd), "right") - 1, minlength=s.n) == 0
        # Words of texts that go whole are not looked up.
        use = np.repeat(plain, np.diff(bounds))
        h = B.Prefix(low).spans(starts[use], ends[use])
        kinds, first, of = np.unique(h, return_index=True, return_inverse=True)
        begin, size, flat = self._words(kinds, low.tobytes(), starts[use][first], ends[use][first])
        n, begin = size[of], begin[of]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(upto[-1]) - np.repeat(upto[:-1], n) + np.repeat(begin, n)]
        place = upto[np.concatenate([[0], np.cumsum(use)])[bounds]]
        for i in range(s.n):
            yield ids[place[i] : place[i + 1]] if plain[i] else None


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(docs: DataFrame, tokenizer: str, capacity: int, end: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = _encoder(tokenizer), np.array([end], np.uint32)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, got in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids = np.concatenate([got, last])
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for column, x in zip(out, (doc, piece, at, len(part), zlib.crc32(part.astype("<u4", copy=False))), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    B.lean(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(B.tidy(run), PIECES)


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows of length, first rank, count, first sequence, offset, sorted by length and rank: the slots of best fit in order
    of decreasing length."""
    rows: list[tuple[int, ...]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # by remaining room: (first sequence, count)
    rooms: list[int] = []  # its keys, sorted
    sequences = 0

    def leave(left: int, first: int, count: int) -> None:
        if left and count:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while count:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
                m = min(n, count)
                leave(left, first + m, n - m)
                leave(left - length, first, m)
                rows.append((length, rank, m, first, capacity - left))
                rank, count = rank + m, count - m
                continue
            each = capacity // length
            for n, k in ((count // each, each), (1, count % each)):
                if not n or not k:
                    continue
                for j in range(k):
                    rows.append((length, rank, n, sequences, j * length))
                    rank += n
                leave(capacity - k * length, sequences, n)
                sequences += n
            count = 0
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """pieces with rank, from 0 within their length."""
    spark = pieces.sparkSession
    groups = spark.createDataFrame([(k, -(-n // RANKS)) for k, n in histogram.items()], "length long, groups long")
    dealt = pieces.join(F.broadcast(groups), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "groups")).drop("groups")
    sums = dealt.groupBy("length", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("length", "part", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    return dealt.withColumn("within", within).join(sums, ["length", "part"]).withColumn("rank", F.col("before") + F.col("within") - 1)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces, _ = written(cut(docs, tokenizer, capacity, end))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = plan(histogram, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(slots[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            order = np.argsort(length, kind="stable")
            at = np.zeros(len(length), np.int64)
            for k, i, n in zip(*np.unique(length[order], return_index=True, return_counts=True), strict=True):
                these = order[i : i + n]
                at[these] = first[k] + np.searchsorted(slots[first[k] : first[k + 1], 1], rank[these], "right") - 1
            took = slots[at]
            columns = [*(batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(took[:, 3] + rank - took[:, 1]), pa.array(took[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = PIECES + ", sequence_id long, offset long"
    return ranked(pieces, histogram).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(B.tidy(run), out)

"""Words of whole Arrow string columns as numpy arrays: spans, hashes, and hashes of runs of words.

Texts are read as UTF-8 in place; no Python string is made. Columns are cut into slices of whole documents of about
SLICE bytes, so that the arrays beside a slice stay small; a longer document is a slice of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORDS = np.uint64(0xD6E8FEB86659FD93)
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: What parts words when letters, digits and all beyond ASCII make words.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def tidy(run):
    """run, a function of Arrow batches, so that a worker gives memory back to the system when its task ends: workers stay
    for later tasks, and what their allocators would keep adds up."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def column(score: Callable[[pa.Array], pa.Array], returns: str):
    """A function of a string column, from one of Arrow arrays. Only that column goes through Python; a row's others wait in
    the JVM, which spills them."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(lambda given: map(score, given))(batches)

    return F.arrow_udf(run, returns)


def lean(spark: SparkSession, size: int = 8 << 20) -> None:
    """Lets the session's Arrow batches be of at most `size` bytes, unless it has a limit of its own: JVM and worker each
    hold some batches a task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(size))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 1), base, U)
        have[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(have)
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


@dataclass
class Slice:
    first: int  # of its documents in the column
    offsets: np.ndarray  # n + 1 places in data
    data: np.ndarray  # uint8

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[Slice]:
    """Slices of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield Slice(i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
        i = j


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # n + 1: document d has words bounds[d] .. bounds[d + 1]

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(s: Slice, parts: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that parts doesn't hold, within one document."""
    inside = ~parts[s.data]
    if not len(inside):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(s.n + 1, np.int64))
    first = np.zeros(len(inside) + 1, bool)
    first[s.offsets] = True
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, s.offsets))


class Prefix:
    """Polynomial sums over a slice's bytes, from which the hash of any span comes in constant time."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(_BASE, len(data)), out=self.sums[1:])
        self.back = powers(inverse(_BASE), len(data) + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(U) * _WORDS)


def runs(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every k consecutive words of a document, and the first word of each."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    sums = np.zeros(n + 1, U)
    np.cumsum(hashes * powers(_WORDS, n), out=sums[1:])
    left = np.zeros(n, np.int64)  # words from here to the document's end
    counts = np.diff(bounds)
    left = np.repeat(bounds[1:], counts) - np.arange(n)
    at = np.flatnonzero(left >= k)
    return mix((sums[at + k] - sums[at]) * powers(inverse(_WORDS), n)[at]), at

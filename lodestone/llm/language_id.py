"""Language identification by string kernels: the blended spectrum of n-gram presence, Nystrom landmarks, and one-versus-rest
kernel ridge regression, scored by batched matrix products.

A text is the set of its byte runs of 1 to 3 bytes (A-Z lower-cased, digits and other ASCII signs all taken as one space), hashed
into DIMS places. The kernel of two texts is the size of their sets' intersection over the geometric mean of their sizes.
Landmarks are documents of the sample, as many of each language as can be. The models are fitted on the driver on a bounded
sample (`size` documents of each language).

Cases: `und` with score 0 for null texts and texts without a letter, and for all if no language was learned; rows that share
a doc_id, or have none, each get a row; a very long text is read whole, in memory for some thirty times its bytes; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .sampling import draw

DIMS, SPAN = 4096, 3
SIZE, LANDMARKS, RIDGE = 600, 192, 1e-3
#: Texts of one matrix product.
ROWS = 256

_LETTER = regex.compile(r"\p{L}")
_FOLD = B.LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def presence(s: B.Slice) -> np.ndarray:
    """A row of zeros and ones for each document."""
    out = np.zeros((s.n, DIMS), np.float32)
    if not len(s.data):
        return out
    flat = out.ravel()
    data = _FOLD[s.data].astype(np.uint32)
    row = np.repeat(np.arange(s.n, dtype=np.int64) * DIMS, np.diff(s.offsets))
    left = np.repeat(s.offsets[1:], np.diff(s.offsets)) - np.arange(len(data))
    h = np.zeros(len(data), np.uint32)
    for n in range(1, SPAN + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(257) + data[n - 1 :]
        whole = left[:m] >= n
        place = ((h ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
        flat[(row[:m] + place)[whole]] = 1
    return out


def _kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """landmarks: rows of unit length."""
    size = np.sqrt(x.sum(axis=1, keepdims=True))
    return (x @ landmarks.T) / np.maximum(size, 1)


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray  # from kernel values to languages, Nystrom map and ridge regression in one
    bias: np.ndarray

    def __call__(self, s: B.Slice) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number and its score."""
        y = np.concatenate([_kernel(presence(_part(s, i, ROWS)), self.landmarks) @ self.weights + self.bias for i in range(0, s.n, ROWS)])
        best = y.argmax(axis=1)
        return best, np.clip(y[np.arange(len(y)), best], 0, 1).astype(np.float64)


def _part(s: B.Slice, i: int, n: int) -> B.Slice:
    o = s.offsets[i : i + n + 1]
    return B.Slice(s.first + i, o - o[0], s.data[o[0] : o[-1]])


def fit(texts: pa.Array | pa.ChunkedArray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    languages = sorted(set(langs))
    x = np.concatenate([np.zeros((0, DIMS), np.float32), *(presence(s) for s in B.slices(texts))])
    y = np.array([[float(a == b) for b in languages] for a in langs], np.float32).reshape(len(langs), len(languages))
    turn = {}
    order = sorted(range(len(langs)), key=lambda i: (turn.setdefault(langs[i], []).append(i) or len(turn[langs[i]]), i))
    marks = x[[i for i in order if x[i].any()][:landmarks]]
    marks = marks / np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
    if not len(marks):
        return Model(languages, marks, np.zeros((0, len(languages)), np.float32), np.zeros(len(languages), np.float32))
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))  # kernel values to the landmarks' feature space
    z = _kernel(x, marks) @ root
    mean = y.mean(axis=0)
    zm = z.mean(axis=0)
    w = np.linalg.solve((z - zm).T @ (z - zm) + ridge * len(z) * np.eye(z.shape[1]), (z - zm).T @ (y - mean))
    return Model(languages, marks, (root @ w).astype(np.float32), (mean - zm @ w).astype(np.float32))


def train(docs: DataFrame, size: int = SIZE) -> Model:
    """docs: doc_id, text, lang; rows without a lang teach nothing."""
    got = draw(docs.select("doc_id", "text"), docs.select("doc_id", F.col("lang").cast("string").alias("lang")), "lang", size)
    return fit(got.column("text"), got.column("lang").to_pylist())


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            best, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
            for s in B.slices(batch.column(1)):
                b, p = model(s) if model.languages else (np.zeros(s.n, np.int64), np.zeros(s.n))
                best.append(b)
                scores.append(p)
            best, scores = np.concatenate(best), np.concatenate(scores)
            blank = np.array([not t.is_valid or not _LETTER.search(t.as_py()) for t in batch.column(1)], bool)
            best[blank], scores[blank] = len(model.languages), 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(B.tidy(run), "doc_id long, lang_pred string, score double")

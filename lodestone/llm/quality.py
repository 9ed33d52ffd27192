"""Text quality by a byte-level convolutional network in numpy.

A whole document is UTF-8 bytes, cut into chunks of CHUNK places whose bytes overlap by the filters' width less one. Learned
filters run over every place; a chunk keeps each filter's largest response, a document the mean and the maximum of its
chunks', and a logistic layer makes one probability of them. The network is fitted on the driver by Adam on a bounded sample
(`size` documents of each label), over all of each document's chunks.

Cases: a null or empty text is a chunk of padding alone and gets a score like any other; with no labels the score is 0.5;
rows that share a doc_id, or have none, each get a row; a very long text is scored whole, in memory for some forty times its
bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .sampling import draw

WIDTH, FILTERS, CHUNK = 6, 8, 250
SIZE, EPOCHS, BATCH, RATE = 1500, 8, 32, 0.01
#: Chunks whose responses are held at a time in training.
HELD = 2048
#: Bytes of a slice: the responses beside it take 4 x FILTERS times as much.
SLICE = 1 << 18


@dataclass
class Net:
    table: np.ndarray  # WIDTH x 256 x FILTERS: what each byte at each place of a filter adds
    bias: np.ndarray
    mean: np.ndarray
    most: np.ndarray
    base: float

    def pairs(self) -> list[np.ndarray]:
        """The same by two bytes at a time."""
        return [(self.table[j][:, None] + self.table[j + 1][None, :]).reshape(1 << 16, -1) for j in range(0, WIDTH, 2)]


def padded(s: B.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with WIDTH zero bytes after each document, and the documents' bounds in them."""
    bounds = s.offsets + WIDTH * np.arange(s.n + 1)
    data = np.zeros(bounds[-1] + WIDTH, np.uint8)
    data[np.arange(len(s.data)) + WIDTH * np.repeat(np.arange(s.n), np.diff(s.offsets))] = s.data
    return data, bounds


def chunk_starts(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each chunk, and the number of chunks of each document. The last places' filters see padding."""
    places = np.maximum(1, np.diff(bounds) - WIDTH)
    n = -(-places // CHUNK)
    first = np.cumsum(n) - n
    return np.repeat(bounds[:-1], n) + CHUNK * (np.arange(n.sum()) - np.repeat(first, n)), n


def score(net: Net, pairs: list[np.ndarray], s: B.Slice) -> np.ndarray:
    data, bounds = padded(s)
    two = data[:-1].astype(np.int32) * 256 + data[1:]
    places = len(data) - WIDTH
    out = pairs[0][two[:places]]
    for j in range(1, WIDTH // 2):
        out += pairs[j][two[2 * j : 2 * j + places]]
    starts, n = chunk_starts(bounds)
    # Between a document's last place and the next document are places of padding that no chunk holds.
    ends = np.minimum(starts + CHUNK, np.repeat(bounds[:-1] + np.maximum(1, np.diff(bounds) - WIDTH), n))
    cuts = np.column_stack([starts, np.minimum(ends, places - 1)]).ravel()
    pooled = np.maximum(np.maximum.reduceat(out, cuts, axis=0)[::2] + net.bias, 0)
    first = np.cumsum(n) - n
    z = (np.add.reduceat(pooled, first, axis=0) / n[:, None]) @ net.mean + np.maximum.reduceat(pooled, first, axis=0) @ net.most + net.base
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _chunks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of a document's bytes (with its padding), and how many places each has."""
    places = max(1, len(raw) - WIDTH)
    k = -(-places // CHUNK)
    data = np.zeros(k * CHUNK + WIDTH - 1, raw.dtype)
    whole = raw[: places + WIDTH - 1]
    data[: len(whole)] = whole
    x = np.lib.stride_tricks.sliding_window_view(data, CHUNK + WIDTH - 1)[::CHUNK]
    return x, np.minimum(CHUNK, places - CHUNK * np.arange(k))


def gradients(w: list[np.ndarray], docs: list[np.ndarray], y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean logistic loss of documents' bytes, and its derivatives by the filters (WIDTH x 256 x FILTERS), their bias, the
    weights of mean and maximum, and the base."""
    parts = [_chunks(d) for d in docs]
    n = np.array([len(x) for x, _ in parts])
    x, places = np.concatenate([x for x, _ in parts]), np.concatenate([p for _, p in parts])
    first, doc = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    peak, pre = np.empty((len(x), w[1].size), np.int64), np.empty((len(x), w[1].size), w[0].dtype)
    for i in range(0, len(x), HELD):
        some = x[i : i + HELD]
        resp = sum(w[0][j][some[:, j : j + CHUNK]] for j in range(WIDTH))
        resp[np.arange(CHUNK) >= places[i : i + HELD, None]] = -np.inf
        peak[i : i + HELD] = resp.argmax(axis=1)
        pre[i : i + HELD] = np.take_along_axis(resp, peak[i : i + HELD, None], 1)[:, 0] + w[1]
    pooled = np.maximum(pre, 0)
    mean, most = np.add.reduceat(pooled, first, axis=0) / n[:, None], np.maximum.reduceat(pooled, first, axis=0)
    z = np.clip(mean @ w[2] + most @ w[3] + w[4], -30, 30)
    loss = float(np.mean(np.logaddexp(0, z) - y * z))
    dz = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(w[0].dtype)
    dpool = (dz[:, None] * w[2] / n[:, None])[doc] + (dz[:, None] * w[3])[doc] * (pooled == most[doc])
    dpool *= pre > 0
    grads = [np.zeros_like(w[0]), dpool.sum(0), mean.T @ dz, most.T @ dz, dz.sum(keepdims=True)]
    rows, f = np.nonzero(dpool)
    for j in range(WIDTH):
        np.add.at(grads[0][j], (x[rows, peak[rows, f] + j], f), dpool[rows, f])
    return loss, grads


def fit(texts: list[str], y: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Net:
    r = np.random.default_rng(seed)
    w = [r.normal(0, 0.1, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.3, FILTERS), r.normal(0, 0.3, FILTERS), np.zeros(1)]
    w = [x.astype(np.float32) for x in w]
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in w]
    raw = [np.frombuffer(t.encode() + bytes(WIDTH), np.uint8) for t in texts]
    step = 0
    for _ in range(epochs if len(set(y.tolist())) > 1 else 0):
        order = r.permutation(len(raw))
        for at in range(0, len(order), BATCH):
            these = order[at : at + BATCH]
            _, grads = gradients(w, [raw[d] for d in these], y[these])
            step += 1
            for p, g, (m, v) in zip(w, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if not step:
        w[2][:] = w[3][:] = 0
    return Net(w[0], w[1], w[2], w[3], float(w[4][0]))


def train(docs: DataFrame, labels: DataFrame, size: int = SIZE) -> Net:
    """labels: doc_id, quality (0 or 1)."""
    got = draw(docs, labels.select("doc_id", F.col("quality").cast("int").alias("quality")), "quality", size)
    return fit(got.column("text").to_pylist(), np.array(got.column("quality").to_pylist(), np.float32))


def quality(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs()
        for batch in batches:
            p = np.concatenate([np.zeros(0), *(score(net, pairs, s) for s in B.slices(batch.column(1), SLICE))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(B.tidy(run), "doc_id long, score double, predicted int")

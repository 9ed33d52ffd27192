"""Toxicity by a classifier chain: categories are predicted one after another, and the probabilities of the earlier ones are
inputs of the later linear models. The later models are trained with out-of-fold probabilities of the earlier ones.

Inputs are the presence of words and of word beginnings of 4 to 7 bytes (runs of letters, digits and bytes beyond ASCII, A-Z
lower-cased), over the whole text, chosen on the sample by how strongly they go with a category. The models are fitted on
the driver on a bounded sample (`size` documents of each value of the last category); scoring is a pass over the documents.

Cases: null and empty texts hold no feature and get the models' base rates; with no labels, or labels of one kind only, that
rate is the answer; rows that share a doc_id, or have none, each get a row; a very long text is scored whole, in memory for
some fifty times its bytes; an empty table gives an empty result; other columns may have any name and are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .sampling import draw

# English words of the two finer categories; a labelled toxic document that has one is of that category.
INSULT = "clown idiot loser moron stupid"
CONTEMPT = "disgusting pathetic scum trash worthless"

SIZE, FEATURES, FOLDS = 2500, 1000, 5
_MASK = (1 << 20) - 1


def features(s: B.Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents and feature hashes, kind by kind, repeats included."""
    low = B.Slice(s.first, s.offsets, B.LOWER[s.data])
    w = B.words(low, B.PUNCT)
    sums, doc, size = B.Prefix(low.data), w.doc, w.ends - w.starts
    yield doc, sums.spans(w.starts, w.ends)
    for n in (4, 5, 6, 7):
        long = size > n
        at = w.starts[long]
        yield doc[long], sums.spans(at, at + n) ^ B.U(n)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 250) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent; the bias isn't shrunk."""
    n, d = x.shape
    y = y.astype(np.float32)
    rate = float(np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3))
    w, b = np.zeros(d, np.float32), float(np.log(rate / (1 - rate)))
    if not n or y.min() == y.max() or not d:
        return w, b
    v = np.full(d, 1, np.float32)
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1.0
    step = float(1.0 / (0.25 * (np.linalg.norm(x @ v) ** 2 + n) + l2))
    pw, pb, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(x @ pw + pb, -30, 30))) - y
        nw, nb = pw - step * (x.T @ r + l2 * pw), pb - step * float(r.sum())
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Chain:
    categories: list[str]
    known: np.ndarray  # sorted feature hashes
    weights: list[tuple[np.ndarray, np.ndarray, float]]  # of features, of earlier categories, bias
    threshold: float = 0.5  # of the last category

    def __post_init__(self):
        self.maybe = np.zeros(_MASK + 1, bool)
        self.maybe[(self.known & B.U(_MASK)).astype(np.int64)] = True

    def present(self, s: B.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Documents and numbers of the known features, each pair once."""
        pairs = [np.zeros(0, np.int64)]
        if len(self.known):
            for doc, h in features(s):
                some = np.flatnonzero(self.maybe[(h & B.U(_MASK)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.known, h[some]), len(self.known) - 1)
                hit = self.known[at] == h[some]
                pairs.append(doc[some][hit] * len(self.known) + at[hit])
        both = np.unique(np.concatenate(pairs))
        return np.divmod(both, max(1, len(self.known)))

    def score(self, s: B.Slice) -> np.ndarray:
        """A row of probabilities for each document."""
        doc, at = self.present(s)
        out = np.zeros((s.n, 0))
        for own, earlier, bias in self.weights:
            z = np.bincount(doc, own[at], s.n) if len(doc) else np.zeros(s.n)
            out = np.column_stack([out, _sigmoid(z + out @ earlier + bias)])
        return out


def cut(p: np.ndarray, y: np.ndarray) -> float:
    """A threshold from out-of-fold probabilities: midway between what 999 in 1000 negatives stay below and what 995 in 1000
    positives reach. If these cross, the one with the largest share of positives found less twice the share of negatives
    taken for such; of equals, the middle of the widest gap."""
    if not len(y) or y.min() == y.max():
        return 0.5
    low, high = np.quantile(p[y == 0], 0.999), np.quantile(p[y == 1], 0.005)
    if low < high:
        return float(np.clip((low + high) / 2, 0.1, 0.9))
    order = np.argsort(p, kind="stable")
    p, y = p[order], y[order]
    found, wrong = 1 - np.cumsum(y) / y.sum(), 1 - np.cumsum(1 - y) / (1 - y).sum()
    gain = np.round(found - 2 * wrong, 9)[:-1]
    best = np.flatnonzero(gain == gain.max())
    i = best[np.argmax((p[1:] - p[:-1])[best])]
    return float(np.clip((p[i] + p[i + 1]) / 2, 0.1, 0.9))


def fit(texts: pa.Array | pa.ChunkedArray, labels: dict[str, np.ndarray], count: int = FEATURES, folds: int = FOLDS) -> Chain:
    """labels: 0 or 1 for each text, by category, in the chain's order."""
    n = len(texts)
    pairs = []
    for s in B.slices(texts):
        for doc, h in features(s):
            pairs.append(np.unique(np.rec.fromarrays([h, doc + s.first], names="h,d")))
    pairs = np.concatenate(pairs) if pairs else np.rec.fromarrays([np.zeros(0, np.uint64), np.zeros(0, np.int64)], names="h,d")
    kinds, of, total = np.unique(pairs["h"], return_inverse=True, return_counts=True)
    often = np.zeros(len(kinds))
    for y in labels.values():
        pos = np.bincount(of, y[pairs["d"]], len(kinds)) if len(kinds) else np.zeros(0)
        n1, n0 = max(1, y.sum()), max(1, n - y.sum())
        p = total / max(1, n)
        z = (pos / n1 - (total - pos) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
        often = np.maximum(often, np.where(total >= 5, np.abs(z), 0))
    keep = np.sort(np.argsort(-often, kind="stable")[:count])
    keep = keep[often[keep] >= 4]
    number = np.full(len(kinds), -1)
    number[keep] = np.arange(len(keep))
    x = np.zeros((n, len(keep)), np.float32)
    hit = number[of] >= 0
    x[pairs["d"][hit], number[of][hit]] = 1
    fold, weights, oof = np.arange(n) % folds, [], np.zeros((n, 0), np.float32)
    for y in labels.values():
        inputs = np.column_stack([x, oof]).astype(np.float32)
        w, b = _logistic(inputs, y)
        weights.append((w[: len(keep)], w[len(keep) :], b))
        held = np.zeros(n, np.float32)
        for k in range(folds):
            w, b = _logistic(inputs[fold != k], y[fold != k])
            held[fold == k] = _sigmoid(inputs[fold == k] @ w + b)
        oof = np.column_stack([oof, held])
    return Chain(list(labels), kinds[keep], weights, cut(oof[:, -1].astype(np.float64), y))


def train(docs: DataFrame, labels: DataFrame, size: int = SIZE) -> Chain:
    """A chain of insult, contempt and toxic. labels: doc_id, toxic (0 or 1). A document is insulting or contemptuous if it is
    labelled toxic and holds a word of that list."""
    got = draw(docs, labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")), "toxic", size)
    toxic = np.array(got.column("toxic").to_pylist(), np.float64)
    texts = got.column("text")
    has = lambda words: np.array([bool(re.search(rf"\b(?:{'|'.join(words.split())})\b", t, re.I)) for t in texts.to_pylist()], bool)
    return fit(texts, {"insult": toxic * has(INSULT), "contempt": toxic * has(CONTEMPT), "toxic": toxic})


def scored(text: Column, chain: Chain) -> Column:
    """The categories' probabilities, in order."""

    def run(column: pa.Array) -> pa.Array:
        p = [chain.score(s) for s in B.slices(column)]
        rows = np.concatenate(p) if p else np.zeros((0, len(chain.categories)))
        return pa.array(rows.tolist(), pa.list_(pa.float64()))

    return B.column(run, "array<double>")(text.cast("string"))


def toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, a probability p_<category> for each category, and toxic (the last one reaches the chain's threshold)."""
    B.lean(docs.sparkSession)
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scored(F.col("text"), chain).alias("p"))
    p = [F.get("p", F.lit(i)).alias(f"p_{c}") for i, c in enumerate(chain.categories)]
    return got.select("doc_id", *p, (F.get("p", F.lit(len(p) - 1)) >= chain.threshold).alias("toxic"))


def without_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs less those whose last category reaches the chain's threshold; their columns as they are."""
    B.lean(docs.sparkSession)
    return docs.filter(F.get(scored(F.col("text"), chain), F.lit(len(chain.categories) - 1)) < chain.threshold)

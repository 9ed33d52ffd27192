import numpy as np
import pytest

from lodestone.llm import toxicity as T
from lodestone.llm.sampling import bucket

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def chain(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return T.train(docs, labels.filter(bucket("doc_id", 5) != 0))


def test_held_out_accuracy(spark, chain):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = T.toxicity(docs, chain).withColumnRenamed("toxic", "says").join(labels.filter(bucket("doc_id", 5) == 0), "doc_id").collect()
    right = [bool(r.toxic) == r.says for r in got]
    assert len(right) > 40 and np.mean(right) > 0.9
    assert not any(r.says for r in got if not r.toxic)


def test_odd_rows(spark, chain):
    rows = [(1, None, 1.0), (2, "", None), (None, "you IDIOT, you moron: stupid clown", 1.0), (2, "word " * 50000, 2.0), (2, "word " * 50000, 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic double").repartition(3)
    got = {(r.doc_id, round(r.p_toxic, 6)): r for r in T.toxicity(docs, chain).collect()}
    assert got.keys() and all(0 <= p <= 1 for _, p in got)
    assert [r.toxic for (d, _), r in got.items() if d is None] == [True]
    kept = T.without_toxic(docs, chain)
    assert kept.columns == docs.columns and kept.count() == 4
    assert T.toxicity(docs.limit(0), chain).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    chain = T.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not T.toxicity(docs, chain).first().toxic


def test_chain_feeds_earlier_probabilities():
    import pyarrow as pa

    r = np.random.default_rng(0)
    texts, first = [], []
    for _ in range(400):
        y = r.random() < 0.5
        first.append(float(y))
        texts.append(" ".join(r.choice(["aa", "bb", "cc"], 6)) + (" marker" if y else ""))
    first = np.array(first)
    chain = T.fit(pa.array(texts), {"one": first, "two": first})
    assert [len(w[1]) for w in chain.weights] == [0, 1] and chain.weights[1][1][0] > 0


def test_chain_equals_a_plain_one():
    """Presence of words, logistic models and out-of-fold inputs written out, against the chain's probabilities."""
    import pyarrow as pa

    from lodestone.llm import bytewords as B

    r = np.random.default_rng(5)
    words = ["aa", "bb", "cc", "dd", "ee"]
    rows = [set(r.choice(words, 3, replace=False)) for _ in range(120)]
    one = np.array([float("aa" in w and r.random() < 0.9) for w in rows])
    two = np.array([float(("bb" in w or o) and r.random() < 0.9) for w, o in zip(rows, one)])
    texts = pa.array([" ".join(sorted(w)) for w in rows])
    chain = T.fit(texts, {"one": one, "two": two}, folds=4)
    hashes = {w: T.B.Prefix(np.frombuffer(w.encode(), np.uint8)).spans(np.array([0]), np.array([2]))[0] for w in words}
    kept = [next(w for w in words if hashes[w] == h) for h in chain.known]
    x = np.array([[float(w in row) for w in kept] for row in rows], np.float32)
    fold, inputs, want = np.arange(120) % 4, x, []
    for y in (one, two):
        w, b = T._logistic(inputs, y)
        want.append((w, b))
        held = np.zeros(120, np.float32)
        for k in range(4):
            wk, bk = T._logistic(inputs[fold != k], y[fold != k])
            held[fold == k] = 1 / (1 + np.exp(-(inputs[fold == k] @ wk + bk)))
        inputs = np.column_stack([inputs, held]).astype(np.float32)
    p1 = 1 / (1 + np.exp(-(x @ want[0][0] + want[0][1])))
    p2 = 1 / (1 + np.exp(-(np.column_stack([x, p1]) @ want[1][0] + want[1][1])))
    got = np.concatenate([chain.score(s) for s in B.slices(texts)])
    assert "aa" in kept and np.allclose(got, np.column_stack([p1, p2]), atol=1e-4)


def test_cut():
    y = np.array([0.0] * 6 + [1.0] * 4)
    assert T.cut(np.array([0.0, 0.1, 0.1, 0.15, 0.2, 0.2, 0.6, 0.7, 0.8, 0.9]), y) == pytest.approx(0.4, abs=0.01)
    assert T.cut(np.array([0.0, 0.1, 0.1, 0.15, 0.2, 0.2, 0.19, 0.7, 0.8, 0.9]), y) == pytest.approx(0.45)
    assert T.cut(np.zeros(3), np.zeros(3)) == 0.5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bytewords as B
from lodestone.llm import language_id as L
from lodestone.llm import quality as Q
from lodestone.llm.sampling import bucket, draw

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


def test_quality_held_out(spark, tables):
    docs, labels = tables
    net = Q.train(docs, labels.filter(bucket("doc_id", 3) != 1))
    got = Q.quality(docs, net).join(labels.filter(bucket("doc_id", 3) == 1), "doc_id").collect()
    assert len(got) > 80 and np.mean([r.quality == r.predicted for r in got]) > 0.9
    rows = [(1, None, 0.5), (2, "", 0.5), (None, "A plain text.", 0.5), (2, "&&& %%%" * 9000, 0.1), (2, "x", 0.1)]
    odd = Q.quality(spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(2), net).collect()
    assert len(odd) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert Q.quality(docs.limit(0), net).count() == 0


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    net = Q.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert Q.quality(docs, net).first().score == 0.5


def test_network_equals_a_plain_one():
    r = np.random.default_rng(4)
    net = Q.Net(r.normal(size=(Q.WIDTH, 256, Q.FILTERS)).astype(np.float32), r.normal(size=Q.FILTERS).astype(np.float32), r.normal(size=Q.FILTERS).astype(np.float32), r.normal(size=Q.FILTERS).astype(np.float32), 0.3)
    texts = ["", "a", "abc" * 50, "é" * 125, "x" * 250, "y" * 251, "long " * 300]
    for text, got in zip(texts, np.concatenate([Q.score(net, net.pairs(), s) for s in B.slices(pa.array(texts), 300)]), strict=True):
        data = text.encode() + bytes(Q.WIDTH)
        places = max(1, len(text.encode()))
        resp = np.array([sum(net.table[j][data[i + j]] for j in range(Q.WIDTH)) for i in range(places)])
        pooled = np.maximum(np.array([resp[c : c + Q.CHUNK].max(0) for c in range(0, places, Q.CHUNK)]) + net.bias, 0)
        z = pooled.mean(0) @ net.mean + pooled.max(0) @ net.most + net.base
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-3)


def test_gradients_equal_differences():
    """All derivatives, over whole documents of several chunks, against differences of the loss."""
    r = np.random.default_rng(2)
    w = [r.normal(size=(Q.WIDTH, 256, 3)), r.normal(size=3), r.normal(size=3), r.normal(size=3), r.normal(size=1)]
    docs = [np.frombuffer(bytes(r.integers(97, 103, n, dtype=np.uint8)) + bytes(Q.WIDTH), np.uint8) for n in (0, 3, 249, 250, 251, 700)]
    y = np.array([0.0, 1, 1, 0, 1, 0])
    _, grads = Q.gradients(w, docs, y)
    for part, g in zip(w, grads, strict=True):
        places = np.argwhere(np.abs(g) > 1e-6)
        for at in [tuple(places[i]) for i in r.permutation(len(places))[:12]]:
            old, step = part[at], 1e-6
            part[at] = old + step
            up, _ = Q.gradients(w, docs, y)
            part[at] = old - step
            down, _ = Q.gradients(w, docs, y)
            part[at] = old
            assert (up - down) / (2 * step) == pytest.approx(g[at], rel=1e-3, abs=1e-6)


def test_training_sees_the_end_of_a_long_document(monkeypatch):
    monkeypatch.setattr(Q, "HELD", 3)  # in pieces
    r = np.random.default_rng(1)
    texts = ["".join(r.choice(list("abcde "), 6000)) + ("#" * 60 if i % 2 else "") for i in range(60)]
    y = np.arange(60) % 2
    net = Q.fit(texts, y.astype(np.float32), epochs=12)
    p = np.concatenate([Q.score(net, net.pairs(), s) for s in B.slices(pa.array(texts))])
    assert np.mean((p >= 0.5) == y) > 0.95


def test_language_model_equals_a_plain_one():
    """Nystrom features and ridge regression, written out."""
    r = np.random.default_rng(3)
    texts = [" ".join(r.choice(["the", "of", "and"] if i % 2 else ["der", "und", "ist"], 12)) for i in range(40)]
    langs = ["en" if i % 2 else "de" for i in range(40)]
    model = L.fit(pa.array(texts), langs, landmarks=10, ridge=1e-2)
    rows = np.concatenate([L.presence(s) for s in B.slices(pa.array(texts))]).astype(np.float64)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    marks = unit[[i for j in range(5) for i in (2 * j + 1, 2 * j)]]  # as many of each language
    marks = marks if np.allclose(marks, model.landmarks, atol=1e-5) else unit[[i for j in range(5) for i in (2 * j, 2 * j + 1)]]
    assert np.allclose(marks, model.landmarks, atol=1e-5)
    values, vectors = np.linalg.eigh(marks @ marks.T)
    z = unit @ marks.T @ vectors / np.sqrt(np.maximum(values, 1e-6))
    y = np.array([[a == b for b in ("de", "en")] for a in langs], float)
    zc, yc = z - z.mean(0), y - y.mean(0)
    want = zc @ np.linalg.inv(zc.T @ zc + 1e-2 * 40 * np.eye(10)) @ zc.T @ yc + y.mean(0)
    best, score = (np.concatenate(x) for x in zip(*(model(s) for s in B.slices(pa.array(texts))), strict=True))
    assert list(best) == list(want.argmax(1)) and np.allclose(score, np.clip(want.max(1), 0, 1), atol=5e-3)


def test_language_held_out(spark, tables):
    docs, _ = tables
    model = L.train(docs.filter(bucket("doc_id", 4) != 2))
    got = L.languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(bucket("doc_id", 4) == 2).collect()
    assert len(got) > 150 and np.mean([r.lang == r.lang_pred for r in got]) > 0.93
    rows = [(1, None, "a"), (2, "12 !?", "a"), (None, "the and of", "a"), (2, "ß" * 60000, "a"), (3, "", "a")]
    odd = {(r.doc_id, r.lang_pred, r.score) for r in L.languages(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string").repartition(2), model).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= odd and len(odd) == 5
    assert L.languages(docs.limit(0), model).count() == 0


def test_language_without_any(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert L.languages(docs, L.train(docs)).first().lang_pred == "und"


def test_kernel_is_that_of_sets():
    texts = ["Ab", "abc", "zz", ""]
    x = np.concatenate([L.presence(s) for s in B.slices(pa.array(texts))])
    assert list(x.sum(1)) == [3, 6, 2, 0]  # a b ab; a b c ab bc abc; z zz
    assert x[0] @ x[1] == 3 and x[0] @ x[2] == 0


def test_sample_is_bounded_and_fixed(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(3000)] + [(5, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(3000)] + [(6, 1), (None, 1), (7, None)], "doc_id long, y int")
    got = draw(docs, labels, "y", 100)
    ones = sum(got.column("y").to_pylist())
    assert got.num_rows <= 200 and 70 <= ones <= 100 and len(set(got.column("text").to_pylist())) == got.num_rows
    assert draw(docs.repartition(7), labels.repartition(5), "y", 100).equals(got)
    often = docs.unionByName(docs.filter("doc_id % 3 = 0").withColumn("text", F.lit("zz")).crossJoin(spark.range(20)).drop("id"))
    assert draw(often, labels.unionByName(labels.withColumn("y", F.lit(1))), "y", 100).num_rows <= 200

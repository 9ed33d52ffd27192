import numpy as np

from lodestone.llm.nearest import nearest, probes


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for i, q in good:
        if i % every == 0:
            near = sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out[i] = [(j, d) for d, j in near]
    return out


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=16).tolist()) for i in range(600)]
    rows += [(700 + i, rows[20][1]) for i in range(300)] + [(2000, None), (2010, [0.0] * 16), (2020, [1.0, None] * 8), (2030, [float("nan")] * 16), (None, rows[3][1]), (2040, [1.0, 2.0]), (2041, [1.0, 2.5])]
    want = brute(rows, 10, 10)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, ids int").repartition(5)
    got = {}
    for x in sorted(nearest(df, every=10).collect(), key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert got[2040] == [(2041, 0.5)] and got.keys() <= want.keys()
    hit = [len({j for j, _ in got.get(i, [])} & {j for j, _ in w}) / len(w) for i, w in want.items()]
    assert np.mean(hit) >= 0.9
    vectors = {i: np.array(v) for i, v in rows if v and None not in v}
    for i, found in got.items():
        for j, d in found:
            assert abs(d - np.sqrt(((vectors[i] - vectors[j]) ** 2).sum())) < 1e-12
        assert found == sorted(found, key=lambda x: (x[1], x[0])) and i not in dict(found)
    assert got[700] == [(20, 0.0)] + [(701 + i, 0.0) for i in range(9)]


def test_real_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, 25, 10)
    got = {}
    for x in nearest(df, every=25).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    assert np.mean([len(got.get(i, set()) & {j for j, _ in w}) / 10 for i, w in want.items()]) >= 0.9


def test_probes_go_by_cost():
    place = np.array([0.2, 0.9, 0.5, 3.4])
    cost = [sum(0 if c == np.floor(x) else (x - c - 1) ** 2 if c < x else (c - x) ** 2 for c, x in zip(cell, place, strict=True)) for cell in probes(place, 60)]
    assert cost == sorted(cost) and cost[0] == 0


def test_empty(spark):
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def found(df, **k):
    got = {}
    for x in sorted(nearest(df, **k).collect(), key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    return got


def same(got, want):
    return [j for j, _ in got] == [j for j, _ in want] and np.allclose([d for _, d in got], [d for _, d in want], rtol=0, atol=1e-12)


def test_no_query_is_short(spark, monkeypatch):
    monkeypatch.setattr("lodestone.llm.nearest.BLOCK", 256)  # several blocks of entries
    r = np.random.default_rng(5)
    unit = lambda n, size: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True) * size)(r.normal(size=(n, 16)))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([unit(2000, 1), unit(20, 20)]))] + [(5000 + i, [float(i), 1.0]) for i in range(3)]
    want = brute(rows, 1, 10)
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), every=1)
    assert {i: len(x) for i, x in got.items()} == {i: len(x) for i, x in want.items()}
    assert all(same(got[i], want[i]) for i in [*range(2000, 2020), 5000, 5001, 5002])


def test_fewer_rows_than_k(spark):
    r = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(8, 16)))] + [(8, (40 * r.normal(size=16)).tolist())]
    want, got = brute(rows, 1, 10), found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1)
    assert got.keys() == want.keys() and all(len(got[i]) == 8 and same(got[i], want[i]) for i in want)

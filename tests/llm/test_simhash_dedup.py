import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import components as C
from lodestone.llm.components import components
from lodestone.llm import simhash_dedup as S
from lodestone.llm.simhash_dedup import near_duplicates


def fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, radius=4):
    fps = [fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted([(d, f"{fps[i]:016x}", least.get(find(i), d)) for i, (d, _) in enumerate(rows)], key=str)


def test_equals_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}É" for i in range(300)]
    rows = []
    for i in range(40):
        words = [r.choice(vocab) for _ in range(r.choice([0, 1, 3, 4, 5, 200, 400]))]
        for c in range(r.choice([1, 1, 2, 6])):
            copy = list(words)
            if c and len(copy) > 100:
                copy[r.randrange(len(copy))] = "changed"
            rows.append((len(rows) * 3, r.choice(" \n").join(copy).upper() if c == 2 else " ".join(copy)))
    rows += [(1, None), (None, None), (None, "alone in the world with words"), (2, " \t"), (6, rows[2][1]), (6, "a " * 5000)]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int").repartition(4)
    assert sorted(map(tuple, near_duplicates(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("few", [0, 100, 1 << 20])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW", few)  # rounds only, some rounds, one task
    r = np.random.default_rng(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, int(x)) for x in r.integers(200, 400, 300)] + [(300, 90), (300, 300)]
    want = {}
    for a, b in pairs:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(70):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    assert dict(map(tuple, got.collect())) == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_texts_are_taken_in_pieces(monkeypatch):
    r = random.Random(2)
    for size in (1, 7, 50):
        monkeypatch.setattr(S, "PIECE", size)
        for n in (0, 1, 3, 4, 5, 60):
            text = "".join(r.choice(["a", "É", "bc" * 9]) + r.choice(" \n\t") * r.randrange(1, 4) for _ in range(n))
            assert S.fingerprint_of(text.encode(), 4) % (1 << 64) == fingerprint(text)


def test_cells_hold_all_and_rule_out_no_link():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << r.integers(0, 64, 300, dtype=np.uint64)) for _ in range(6)], np.zeros(1, np.uint64)]))
    kinds, sizes = np.unique(S._quarters(fp), axis=0, return_counts=True)
    for most in (1, 5, 40, 10_000):
        cells = S.Cells(kinds, sizes, most)
        of = cells.of(fp.view(np.int64))
        assert of.min() >= 0 and of.max() < len(cells.low)
        one = cells.split[S.Cells.code(S._quarters(fp))] == 1
        assert np.bincount(of[one]).max(initial=0) <= most
        near = [set(cells.near(c, 4).tolist()) for c in range(len(cells.low))]
        x, y = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
        assert all(of[j] in near[of[i]] for i, j in zip(x.tolist(), y.tolist()))


def test_many_cells_give_the_same(spark, monkeypatch):
    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 62, 200)
    fps = np.unique(np.concatenate([base, base ^ 5, base ^ (1 << 61), base ^ (7 << 30), r.integers(0, 1 << 62, 400)]))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    want = sorted(map(tuple, S.linked(df).collect()))
    monkeypatch.setattr(S, "CELL", 16)
    monkeypatch.setattr(S, "GROUP", 32)
    assert len({c for _, c in want}) >= 200 and sorted(map(tuple, S.linked(df).collect())) == want

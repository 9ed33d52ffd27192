import random
import re

import numpy as np

from lodestone.llm import decontamination as D
from lodestone.llm.decontamination import contaminated, greedy_tiles, without_contaminated


def slow_tiles(a, b, least):
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return out
        n, i, j = best
        fa[i : i + n] = fb[j : j + n] = [False] * n
        out.append(best)


def test_tiles_equal_the_plain_algorithm():
    r = random.Random(3)
    for _ in range(300):
        size = r.choice([2, 3, 8])
        a, b = ([r.randrange(size) for _ in range(r.randrange(1, 60))] for _ in range(2))
        if r.random() < 0.5:
            i = r.randrange(len(b))
            a = a + b[i:] + [9] + b[:i]
        least = r.choice([2, 3, 5])
        got = greedy_tiles(np.array(a, np.uint64), np.array(b, np.uint64), least)
        assert [t[0] for t in got] == [t[0] for t in slow_tiles(a, b, least)]
        assert got == slow_tiles(a, b, least)


def coverage(doc, item, least=5):
    split = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    a, b = split(doc), split(item)
    return sum(t[0] for t in slow_tiles(a, b, min(least, len(b)))) / len(b) if b else 0.0


def test_equals_brute_force(spark):
    r = random.Random(4)
    word = lambda: r.choice(["un", "dé", "trois", "Four", "x5", "six", "sept,", "h-u"])
    items = [(i, " ".join(word() for _ in range(r.choice([0, 2, 4, 12, 30])))) for i in range(14)] + [(20, None), (None, "no id but words in it here")]
    rows = []
    for d in range(40):
        text = " ".join(word() for _ in range(r.randrange(30)))
        if d % 3 == 0:
            w = (items[d % 14][1] or "").split()
            k = len(w) // 2
            text = f"{text} {' '.join(w[k:])}. And {' '.join(w[:k])}"
        rows.append((d, text))
    rows += [(7, None), (None, "no id but words in it here"), (8, "")]
    docs = spark.createDataFrame([(d, t, 1.0, "i") for d, t in rows], "doc_id long, text string, coverage double, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(docs, bench).collect()
    want = []
    for d, t in rows:
        cov = [(coverage(t, x), i) for i, x in items]
        want.append((d, sum(c >= 0.5 for c, _ in cov), round(max([0.0, *(c for c, _ in cov)]), 9)))
    assert sorted([(g.doc_id, g.n_items, round(g.coverage, 9)) for g in got], key=str) == sorted(want, key=str)
    assert all(g.contaminated == (g.n_items > 0) for g in got)
    kept = without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not n for _, n, _ in want)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs, bench).first().contaminated is False
    assert contaminated(docs.limit(0), bench).count() == 0


def test_long_repetitive_texts_take_little_memory():
    import tracemalloc

    doc, item = np.tile(np.array([1, 2], np.uint64), 30_000), np.tile(np.array([1, 2], np.uint64), 1000)
    tracemalloc.start()
    tiles = greedy_tiles(doc, item, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tiles == [(2000, 0, 0)] and peak < 200 << 20


def test_repeated_items_count_and_a_common_seed_costs_no_tiling(spark, monkeypatch):
    seed = "one two three four five"
    items = [(i, f"{seed} {' '.join(f'w{i}x{j}' for j in range(30))}") for i in range(200)]
    items += [(300, "alpha beta gamma delta epsilon zeta")] * 3 + [(None, "alpha beta gamma delta epsilon zeta")]
    docs = spark.createDataFrame([(1, f"x {seed} y"), (2, f"{seed} alpha beta gamma delta epsilon"), (3, items[7][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in contaminated(docs, bench).collect()}
    assert [(got[d].n_items, got[d].item_id) for d in (1, 2, 3)] == [(0, 0), (4, 300), (1, 7)]
    assert abs(got[1].coverage - 5 / 35) < 1e-12 and got[3].coverage == 1.0
    monkeypatch.setattr(D, "PART_WORDS", 1500)  # several passes give the same
    assert {r.doc_id: r for r in contaminated(docs, bench).collect()} == got

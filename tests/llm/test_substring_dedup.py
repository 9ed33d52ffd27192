import hashlib
import random
import re

import pytest

from lodestone.llm.substring_dedup import repeated_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        if i is not None:
            for a in range(len(w) - k + 1):
                g = tuple(w[a : a + k])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in docs:
        gone = set()
        for a in range(len(w) - k + 1):
            if i is not None and first[tuple(w[a : a + k])] < i:
                gone |= set(range(a, a + k))
        kept = " ".join(x for a, x in enumerate(w) if a not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [3, 13])
def test_equals_brute_force(spark, k):
    r = random.Random(k)
    vocab = ["à", "b", "cc", "dé", "e."] if k == 3 else ["x", "y"]
    rows = [(i * 7, r.choice(" \t\n").join(r.choice(vocab) for _ in range(r.randrange(60)))) for i in range(60)]
    rows += [(3, None), (4, ""), (None, rows[9][1]), (None, None), (14, rows[9][1]), (1000, "y " * 4000)]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, n_words string").repartition(5)
    got = repeated_passages(df, k).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k)


def test_empty(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0

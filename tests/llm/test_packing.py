import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def test_encoder_equals_the_tokenizer():
    r = random.Random(2)
    encode, whole = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    chars = ["a", "B", "é", "Ü", "ß", " ", "\n", "\t", "'s", "'LL", "1", "23", "_", "-", "!!", "<|endoftext|>", "é", " ", " ", "µ", "×", "İ", "字", "\x1c", "x", "́", "."]
    texts = ["".join(r.choice(chars) for _ in range(r.randrange(14))) for _ in range(1500)]
    texts += ["", "a" * 5000, "é" * 3000 + " x", "\n \t"] + ["Ünd 12 drei-vier " * r.randrange(9) for _ in range(50)]
    for size in (1, 40, 1 << 20):
        packing.SLICE, old = size, packing.SLICE
        try:
            for _ in range(2):  # the second time words are known
                for text, got in zip(texts, encode(pa.array([*texts, None])), strict=False):
                    assert got.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
        finally:
            packing.SLICE = old


def test_few_kept_words_give_the_same(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 5)
    encode, whole = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = [f"word{i} two three{i % 3} élan" for i in range(40)]
    assert [x.tolist() for t in texts for x in encode(pa.array([t]))] == [whole.encode(t, add_special_tokens=False).ids for t in texts] and len(encode.hashes) <= 5


@pytest.mark.parametrize("capacity", [16, 4096])
def test_pack(spark, capacity, monkeypatch):
    monkeypatch.setattr(packing, "RANKS", 7)
    r = random.Random(capacity)
    rows = [(i, " ".join(r.choice(["one", "Two,", "élan", "zzyzx"]) for _ in range(int(r.paretovariate(0.6)) % 9000))) for i in range(150)]
    rows += [(500, None), (501, ""), (None, "no id"), (3, "twice"), (3, "twice")] + [(600 + i, "x") for i in range(60)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, length int").repartition(3)
    got = packing.pack(df, PATH, capacity).collect()
    want = sorted(((d, p, p * capacity, len(x := all_ids[p * capacity : (p + 1) * capacity]), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t in rows for all_ids in [ids(t)] for p in range(-(-len(all_ids) // capacity))), key=str)
    assert sorted([tuple(g)[:5] for g in got], key=str) == want
    bins = {}
    for g in got:
        bins.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    # Best fit in decreasing order, piece by piece, needs as many sequences.
    left = []
    for length in sorted((g.length for g in got), reverse=True):
        fits = [x for x in left if x >= length]
        x = min(fits) if fits else capacity
        if fits:
            left.remove(x)
        left.append(x - length)
    assert len(bins) == len(left)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0

import re

import numpy as np
from pyspark.sql import functions as F
from test_decontamination import coverage
from test_simhash_dedup import brute

import corpus_pipeline as P
from lodestone.llm.simhash_dedup import fingerprint, fingerprints

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "simhash", "decontamination", "secrets", "packing"]

    clean = stages["toxicity"](spark, docs, SF).cache()
    assert clean.columns == docs.columns

    rows = [(r.doc_id, r.text) for r in clean.collect()]
    once = stages["simhash"](spark, clean, SF).cache()
    assert once.columns == docs.columns
    assert sorted(r.doc_id for r in once.collect()) == sorted({c for d, _, c in brute(rows) if d == c})

    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    fair = stages["decontamination"](spark, once, SF).cache()
    assert fair.columns == docs.columns
    words = lambda t: set(re.findall(r"\w+", t.lower()))
    tests = [(b, words(b)) for b in bench]
    for r in once.collect():
        w = words(r.text)
        near = [b for b, v in tests if len(w & v) >= len(v) / 2 and len(r.text) < 4000]
        if len(r.text) < 4000:
            assert (fair.filter(f"doc_id = {r.doc_id}").count() == 0) == any(coverage(r.text, b) >= 0.5 for b in near) if near else True

    masked = stages["secrets"](spark, fair, SF).cache()
    assert masked.columns == docs.columns and masked.count() == fair.count()
    assert not [r for r in masked.collect() if re.search(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", r.text or "")]

    packed = stages["packing"](spark, masked, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in masked.collect()}


def test_toxic_documents_go(spark):
    """On sf0.01, with 51 toxic labels (sf0.001 has eleven, too few to learn from)."""
    at = SF.replace("0.001", "0.01")
    kept = {r.doc_id for r in P.drop_toxic(spark, spark.read.parquet(f"{at}/documents.parquet"), at).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    assert np.mean([i in kept for i, t in labels.items() if not t]) > 0.97
    assert np.mean([i in kept for i, t in labels.items() if t]) < 0.2


def test_copies_and_rows_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(4, text, "en", "s", 1), (4, text, "en", "s", 1), (9, text, "en", "s", 1), (5, "other words here", "en", "s", 1), (None, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = P.drop_near_copies(spark, docs, SF)
    assert sorted((r.doc_id for r in got.collect()), key=str) == [4, 5, None] and got.columns == docs.columns


def test_different_texts_under_one_id(spark):
    text = lambda x, more="": " ".join(f"{x}{i}" for i in range(400)) + more
    rows = [(1, text("a")), (1, text("b")), (2, text("c")), (3, text("c")), (3, text("d")), (4, text("e")), (4, text("e", " z0 z1 z2")), (5, text("b"))]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    fps = {r.text: r.fp for r in docs.select("text", fingerprint(F.col("text")).alias("fp")).collect()}
    assert fps[text("e")] != fps[text("e", " z0 z1 z2")] and sorted(r.fp for r in fingerprints(docs).collect()) == sorted(fps[t] for _, t in rows)
    got = sorted((r.doc_id, r.text) for r in P.drop_near_copies(spark, docs, SF).collect())
    assert [r for r in got if r[0] != 4] == [(1, text("a")), (1, text("b")), (2, text("c")), (3, text("d"))]
    assert len([r for r in got if r[0] == 4]) == 1  # near copies of each other


def test_run(spark):
    got = P.run(spark, SF)
    assert got.count() > 100 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)


def test_empty_table_and_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    names = ["fp", "row", "items", "p", "component", "at", "found", "spans", "sequence_id", "kept"]
    more = docs.select("*", *[F.lit(i).alias(x) for i, x in enumerate(names)])
    for given in (more, more.limit(0)):
        now = given
        for name, stage in P.STAGES[:-1]:
            before, now = now, stage(spark, now, SF).cache()
            assert now.columns == given.columns, name
            assert now.count() <= before.count()
            assert not now.count() or list(now.first()[5:]) == list(range(len(names)))
        assert P.pack(spark, now, SF).select("doc_id").distinct().count() == now.count()

"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact distances.

TABLES tables hash a vector by HASHES random projections each, cut into cells as wide as WIDTH times the spread of the
projections, which is measured on a bounded sample of SAMPLE vectors. Every vector is indexed in every table. A query visits
PROBES cells a table in order of estimated success: by the sum of its squared distances to the cells' borders. What it meets
in a cell is ranked by exact Euclidean distance in double precision; the cells' best lists are merged.

Equal vectors are one entry of the index, with the smallest ids of those that have it (as many as an answer can use), and equal
queries are asked once. A cell that holds more than its share is dealt out into salted blocks, so that no task holds an
unbounded part; only each block's best come out of it.

A query that met fewer than it can use (a long or outlying vector, a small table) is ranked exactly against all entries of its
length, block by block of both, so every query has k rows wherever there are k candidates.

Cases: rows whose vec_id or vector is null, or whose vector is all zero or holds nulls or non-finite components, take no part;
vectors of different lengths never meet; rows that share a vec_id are one candidate each at its own distance, the nearest
counting; fewer candidates than k give fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import U, mix
from .spaces import written

TABLES, HASHES, WIDTH, PROBES, SAMPLE = 4, 4, 1.0, 140, 2000
#: Entries of a cell in one task.
BLOCK = 4096
SEED = 11


@lru_cache(8)
def _planes(dim: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng([SEED, dim])
    return r.normal(size=(dim, TABLES * HASHES)), r.random(TABLES * HASHES)


def _places(x: np.ndarray, width: float) -> np.ndarray:
    """Where vectors are on the projections, in cells: rows x TABLES x HASHES."""
    a, b = _planes(x.shape[1])
    return (x @ a / width + b).reshape(len(x), TABLES, HASHES)


def _cells(of: np.ndarray, dim: int) -> np.ndarray:
    """A number for each cell; of: ... x TABLES x HASHES (or TABLES x n x HASHES with the table first)."""
    h = np.full(of.shape[:-1], dim, np.uint64)
    for j in range(HASHES):
        h = mix(h * U(31) + of[..., j].astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def probes(place: np.ndarray, n: int) -> np.ndarray:
    """The n best cells for a query's places in one table, best first; n x HASHES."""
    home = np.floor(place)
    inside = place - home
    options = []
    for x in inside:
        way = [(0.0, 0)] + [((x + d - 1) ** 2, -d) for d in range(1, 6)] + [((1 - x + d - 1) ** 2, d) for d in range(1, 6)]
        options.append(sorted(way))
    first = (0,) * len(options)
    seen, heap, out = {first}, [(0.0, first)], []
    while heap and len(out) < n:
        cost, at = heapq.heappop(heap)
        out.append([home[j] + options[j][i][1] for j, i in enumerate(at)])
        for j, i in enumerate(at):
            if i + 1 < len(options[j]) and (more := at[:j] + (i + 1,) + at[j + 1 :]) not in seen:
                seen.add(more)
                heapq.heappush(heap, (cost - options[j][i][0] + options[j][i + 1][0], more))
    return np.array(out)


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors, by the vectors' length."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(), column.offsets.to_numpy()[:-1]
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield rows, flat[starts[rows][:, None] + np.arange(dim)]


def _index(width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrix(batch.column("vector")):
                cells = _cells(np.floor(_places(x.astype(np.float64), width)), x.shape[1])
                for t in range(TABLES):
                    some = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(cells[:, t]), some.column("ids"), some.column("vector")], names=["tab", "cell", "ids", "vector"])

    return run


def _asks(width: float, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrix(batch.column("vector")):
                places = _places(x.astype(np.float64), width)
                for i in range(0, len(rows), 64):
                    some, of = rows[i : i + 64], places[i : i + 64]
                    for t in range(TABLES):
                        cells = [_cells(probes(p[t], n), x.shape[1]) for p in of]
                        counts = [len(c) for c in cells]
                        take = batch.take(pa.array(np.repeat(some, counts)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(sum(counts), t, np.int32)), pa.array(np.concatenate(cells)), take.column("qid"), take.column("vector")], names=["tab", "cell", "qid", "vector"])

    return run


def _best(distances: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest of different ids, ties to the smaller one."""
    order = np.lexsort((ids, distances))
    _, first = np.unique(ids[order], return_index=True)
    keep = order[np.sort(first)][:n]
    return distances[keep], ids[keep]


def _rank(n: int):
    def run(key, asked, held):
        out: dict[str, list] = {"qid": [], "ids": [], "distances": []}
        if asked.num_rows and held.num_rows:
            x = np.array(held.column("vector").to_pylist(), np.float64)
            ids = held.column("ids").to_pylist()
            least = np.array([i[0] for i in ids])
            norms = (x * x).sum(1)
            for some in asked.to_batches(max_chunksize=256):
                q = np.array(some.column("vector").to_pylist(), np.float64)
                rough = norms - 2 * (q @ x.T)  # less the query's own norm
                for qid, v, r in zip(some.column("qid").to_pylist(), q, rough, strict=True):
                    near = np.arange(len(x))
                    if len(x) > n:
                        # Products are near enough to say who can't be among the n nearest.
                        near = np.flatnonzero(r <= np.partition(r, n - 1)[n - 1] + 1e-9 * (norms.max() + v @ v))
                    d = np.sqrt(((x[near] - v) ** 2).sum(1))
                    near, d = (o := np.lexsort((least[near], d))[:n], near[o])[1], d[o]
                    each = [(a, i) for a, j in zip(d, near, strict=True) for i in ids[j]]
                    d, i = _best(np.array([e[0] for e in each]), np.array([e[1] for e in each]), n)
                    out["qid"].append(qid)
                    out["ids"].append(i.tolist())
                    out["distances"].append(d.tolist())
        return pa.table([pa.array(out["qid"], pa.int64()), pa.array(out["ids"], pa.list_(pa.int64())), pa.array(out["distances"], pa.list_(pa.float64()))], names=["qid", "ids", "distances"])

    return run


def _merge(n: int):
    def run(key, lists):
        ids, d = lists.column("ids").combine_chunks().flatten().to_numpy(), lists.column("distances").combine_chunks().flatten().to_numpy()
        d, ids = _best(d, ids, n)
        return pa.table({"qid": pa.array([key[0].as_py()]), "ids": pa.array([ids.tolist()], pa.list_(pa.int64())), "distances": pa.array([d.tolist()], pa.list_(pa.float64()))})

    return run


def _salted(index: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with salt: cells of more than BLOCK entries in blocks, queries to each block of their cell."""
    # Fewer than TABLES rows for BLOCK entries, as a table of known size: it is broadcast only if it is small enough.
    hot = index.groupBy("tab", "cell").count().filter(F.col("count") > BLOCK).select("tab", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    hot, _ = written(hot)
    index = index.join(hot, ["tab", "cell"], "left").withColumn("salt", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    asks = asks.join(hot, ["tab", "cell"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return index, asks


def _completed(best: DataFrame, asked: DataFrame, entries: DataFrame, count: int, n: int) -> DataFrame:
    """best, with the lists of queries that met fewer than n ids ranked anew against all entries of their length."""
    best, _ = written(best)
    enough = best.filter(F.size("ids") >= n)
    short, _ = written(asked.join(enough.select("qid"), "qid", "left_anti"))
    asking = short.count()
    if not asking:
        return best
    dim, salt = F.size("vector").alias("dim"), F.xxhash64("vector")
    rows, columns = -(-asking // BLOCK), -(-count // BLOCK)
    asks = short.select("qid", "vector", dim, F.pmod(salt, F.lit(rows).cast("long")).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"))
    held = entries.select("ids", "vector", dim, F.pmod(salt, F.lit(columns)).cast("int").alias("column"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("row"))
    held = held.join(F.broadcast(short.select(dim).distinct()), "dim", "left_semi")
    place = ["dim", "row", "column"]
    lists = asks.groupBy(*place).cogroup(held.groupBy(*place)).applyInArrow(_rank(n), "qid long, ids array<long>, distances array<double>")
    return enough.unionByName(lists.groupBy("qid").applyInArrow(_merge(n), "qid long, ids array<long>, distances array<double>"))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, tables_probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k nearest other rows found,
    or all there are, if fewer. vectors: vec_id, embedding."""
    n = k + 1  # the query itself may be among them
    # Floats travel as floats; distances are of doubles.
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    good = good.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(fine)
    # The window's limit is applied before the shuffle too, so that a vector many rows have sends few of them.
    first = good.withColumn("at", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("at") <= n)
    entries, _ = written(first.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    rows = good.filter(F.pmod("vec_id", F.lit(every)) == 0)
    asked = rows.groupBy("vector").agg(F.min("vec_id").alias("qid"))
    count = entries.count()
    sample = entries.orderBy(F.xxhash64(F.get("ids", F.lit(0)))).limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
    spread = [_matrix_spread(x) for _, x in _matrix(sample)] if len(sample) else []
    width = WIDTH * (max(spread, default=1.0) or 1.0)
    asks = asked.mapInArrow(_asks(width, tables_probes), f"tab int, cell long, qid long, vector array<{kind}>")
    index = entries.select("ids", "vector").mapInArrow(_index(width), f"tab int, cell long, ids array<long>, vector array<{kind}>")
    index, asks = _salted(index, asks)
    place = ["tab", "cell", "salt"]
    lists = asks.groupBy(*place).cogroup(index.groupBy(*place)).applyInArrow(_rank(n), "qid long, ids array<long>, distances array<double>")
    best = lists.groupBy("qid").applyInArrow(_merge(n), "qid long, ids array<long>, distances array<double>")
    best = _completed(best, asked, entries, count, n)
    named = rows.join(asked, "vector").select(F.col("vec_id").alias("query_id"), "qid").join(best, "qid")
    others = F.slice(F.filter(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("distances").alias("score")), lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return named.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _matrix_spread(x: np.ndarray) -> float:
    """The standard deviation of projections on random directions."""
    return float(np.sqrt(np.square(x - x.mean(axis=0)).sum(axis=1).mean())) if len(x) > 1 else float(np.linalg.norm(x))

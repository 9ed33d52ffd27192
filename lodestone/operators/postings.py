"""A stored full-text index: postings by term, so that a search reads the postings of its own terms and nothing else.

postings: bucket, term, key, field (a number), places (of the term in the field, from 0), length (all words of the row).
They are written by bucket (a hash of the term) and sorted by term within, so a search for some terms reads few files, and of
these the row groups that may hold them. totals is one row. A row's length travels with each of its postings, so that no
table of all rows is read or joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from .fulltext import K1, TERMS, B, phrase

#: Buckets of terms, and tasks that write one.
BUCKETS, SHARES = 64, 8


@dataclass
class Index:
    postings: DataFrame
    totals: DataFrame  # one row: n, mean, weights (of the fields, in order), buckets
    key: str


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.hash(term), F.lit(buckets)).cast("int")


def build(rows: DataFrame, key: str, fields: Mapping[str, float], buckets: int = BUCKETS) -> Index:
    """Keys are unique. A term's places are grouped by row, so no term is ever in one place as a whole."""
    split = [words(F.col(f)) for f in fields]
    length = reduce(lambda a, b: a + b, [F.size(w) for w in split]).cast("long")
    each = rows.select(key, length.alias("length"), F.explode(F.array(*[F.struct(F.lit(i).alias("field"), w.alias("words")) for i, w in enumerate(split)])).alias("f"))
    at = each.select(key, "length", F.col("f.field").alias("field"), F.posexplode("f.words").alias("place", "term"))
    grouped = at.groupBy("term", key, "field", "length").agg(F.array_sort(F.collect_list("place")).alias("places"))
    postings = grouped.select(_bucket(F.col("term"), buckets).alias("bucket"), "term", key, "field", "places", "length")
    weights = F.array(*[F.lit(float(w)) for w in fields.values()])
    totals = rows.select(length.alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean")).select("n", "mean", weights.alias("weights"), F.lit(buckets).alias("buckets"))
    return Index(postings, totals, key)


def save(index: Index, path: str) -> None:
    # A frequent term's bucket is written by several tasks.
    dealt = index.postings.repartition(F.col("bucket"), F.pmod(F.xxhash64(index.key), F.lit(SHARES))).sortWithinPartitions("bucket", "term", index.key)
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index.totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def load(spark: SparkSession, path: str, key: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals"), key)


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def bm25(index: Index, terms: Sequence[str], every: bool = False) -> DataFrame:
    """key and score as fulltext.bm25 has them, from the postings of the terms' words alone."""
    key, spark = index.key, index.postings.sparkSession
    items = [p for p in map(phrase, list(terms)[:TERMS]) if p]
    if not items or every and len(items) < 2:
        return index.postings.select(key, F.lit(0.0).alias("score")).limit(0)
    whole = index.totals.first()
    wanted = sorted({w for p in items for w in p})
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "term string").select(_bucket(F.col("term"), whole["buckets"])).distinct().collect()]
    read = index.postings.filter(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))
    # One row for each row and field that has any of the words: a map from word to places.
    fields = read.groupBy(key, "field", "length").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))

    def times(p: list[str]) -> Column:
        first = F.coalesce(F.try_element_at("at", F.lit(p[0])), F.expr("cast(array() as array<int>)"))
        for i, w in enumerate(p[1:], 1):
            then = F.coalesce(F.try_element_at("at", F.lit(w)), F.expr("cast(array() as array<int>)"))
            first = F.array_intersect(first, _moved(then, i))
        return F.size(first)

    weight = F.element_at(F.array(*[F.lit(float(w)) for w in whole["weights"]]), F.col("field") + 1)
    counted = fields.groupBy(key, "length").agg(*[F.sum(weight * times(p)).alias(f"f{j}") for j, p in enumerate(items)])
    df = F.broadcast(counted.agg(*[F.count_if(F.col(f"f{j}") > 0).alias(f"n{j}") for j in range(len(items))]))
    n, mean = F.lit(whole["n"]), F.lit(whole["mean"])
    idf = [F.log((n - F.col(f"n{j}") + 0.5) / (F.col(f"n{j}") + 0.5)) for j in range(len(items))]
    norm = K1 * (1 - B + B * F.col("length") / mean)
    total = reduce(lambda a, b: a + b, [F.when(i > 0, i).otherwise(1e-6) * F.col(f"f{j}") * (K1 + 1) / (F.col(f"f{j}") + norm) for j, i in enumerate(idf)])
    has = [F.col(f"f{j}") > 0 for j in range(len(items))]
    some = reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), has)
    return counted.crossJoin(df).select(key, F.when(some, total).otherwise(0.0).alias("score")).filter(F.col("score") > 0)


def vocabulary(index: Index) -> DataFrame:
    """term, doc and cnt."""
    each = index.postings.groupBy("term", index.key).agg(F.sum(F.size("places")).alias("cnt"))
    return each.groupBy("term").agg(F.count("*").alias("doc"), F.sum("cnt").alias("cnt"))

"""Point lookups in a store of chunks (file_path, chunk_name, chunk_type, signature, start_line) and its index of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_name(chunks: DataFrame, name: str, limit: int = 20) -> DataFrame:
    return chunks.filter(F.col("chunk_name") == name).orderBy("file_path", "start_line").limit(limit)


def methods_by_suffix(chunks: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Methods whose name is a class's and this one's, whatever the case."""
    hit = (F.col("chunk_type") == "method") & F.lower("chunk_name").endswith("." + name.lower())
    return chunks.filter(hit).orderBy("file_path", "start_line").limit(limit)


def in_file(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.filter(F.col("file_path") == path).orderBy("start_line")


def signatures(chunks: DataFrame, path: str | None = None) -> DataFrame:
    rows = chunks if path is None else chunks.filter(F.col("file_path") == path)
    return rows.select("file_path", "chunk_name", "chunk_type", "signature", "start_line").orderBy("file_path", "start_line")


def file_hash(index: DataFrame, path: str) -> DataFrame:
    return index.filter(F.col("file_path") == path).select("content_hash")


def indexed_files(index: DataFrame) -> DataFrame:
    return index.select("file_path").distinct()


def matching_files(chunks: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """file_path of files whose path holds one of the query's first five words (an underscore stands for any character, a
    per cent sign for any), for a search without results."""
    words = query.split()[:5]
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col("file_path").ilike(f"%{w}%")
    return chunks.filter(hit).select("file_path").distinct().orderBy("file_path").limit(limit)


def refresh_candidates(chunks: DataFrame, refs: DataFrame, found: DataFrame, name: str, limit: int = 25) -> DataFrame:
    """file_path of the files that a question about a symbol may need anew: those with a chunk of that name, with a call of
    it or in it, and those that a search (found: file_path) has; the file that the name gives among them. refs: file_path,
    ref_name, containing_chunk."""
    hint, colon, symbol = name.strip().rpartition(":")
    symbol = symbol.strip() or name.strip()
    names = sorted({name.strip(), symbol, symbol.rsplit(".", 1)[-1]} - {""})
    if not names:
        return chunks.select("file_path").limit(0)
    parts = [found.select("file_path")]
    for n in names:
        parts.append(chunks.filter(F.col("chunk_name") == n).select("file_path").orderBy("file_path").limit(limit))
        parts.append(refs.filter(F.col("ref_name") == n).select("file_path").orderBy("file_path").limit(limit))
        parts.append(refs.filter(F.col("containing_chunk") == n).select("file_path").orderBy("file_path").limit(limit))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if colon and ("/" in hint or hint.endswith((".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".swift"))):
        out = out.unionByName(chunks.sparkSession.createDataFrame([(hint.strip(),)], "file_path string"))
    return out.filter("file_path <> ''").distinct().orderBy("file_path").limit(limit)


def deep_target(context: DataFrame, listed: DataFrame) -> DataFrame:
    """One row at most, chunk_name and file_path: the first function, method or class of a context (slot is its order), else
    the first function, method, class, constant or module of a map (score is its order). Both: chunk_name, chunk_type,
    file_path."""
    ranks = {"function": 0, "method": 1, "class": 2, "constant": 3, "module": 4}

    def ranked(rows: DataFrame, source: int, most: int, order) -> DataFrame:
        kind = F.lower("chunk_type")
        rank = F.coalesce(*[F.when(kind == k, i) for k, i in ranks.items() if i <= most])
        return rows.select("chunk_name", "file_path", F.lit(source).alias("source"), rank.alias("rank"), order.cast("double").alias("place")).filter("rank is not null and chunk_name <> ''")

    both = ranked(context, 0, 2, F.col("slot")).unionByName(ranked(listed, 1, 4, -F.col("score")))
    return both.orderBy("source", "rank", "place", "file_path", "chunk_name").limit(1).select("chunk_name", "file_path")

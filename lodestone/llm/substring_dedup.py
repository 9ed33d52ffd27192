"""Removal of passages that an earlier document has: Rabin-Karp hashes of every window of `window` words, counted in
Spark; the repeated windows of a document merge into maximal removal intervals.

A window is repeated if its words also start in a document with a smaller doc_id. Every window of every document is
hashed (64 bits) and dealt out by hash range; within a range the smallest doc_id of each hash is found. A task that
reads documents first folds its own repeats: of several documents of a batch that hold a window only the smallest goes
on, the rest are known to lose it, so that a window in a third of all documents makes one entry a batch, not one a
document. Entries are packed, many to a row, as differences. What a document loses comes back by document bucket, beside its text.

Cases: a null text has no words; null doc_ids are neither looked up nor removed from, and come back with n_removed 0;
rows that share a doc_id never remove from each other; fewer words than a window: nothing is removed; an empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .spaces import scan_bytes

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"
PACKED = "kind int, part long, hashes binary, docs binary"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
#: Bytes of input for each range of hashes and each bucket of documents.
RANGE_BYTES, BUCKET_BYTES = 4 << 20, 2 << 20


def _windows(s: B.Slice, window: int):
    w = B.words(s)
    return w, *B.runs(B.Prefix(s.data).spans(w.starts, w.ends), w.bounds, window)


def prime(n: int) -> int:
    """The least prime from n on; doc_ids with a common factor still spread over so many buckets."""
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _squeeze(x: np.ndarray) -> bytes:
    """Ascending or nearby 64-bit values in few bytes: the smallest, then what each has above it or above the one
    before, whichever is less, without leading bytes that are zero in all."""
    x = x.view(np.uint64)
    steps = np.diff(x, prepend=x[:1]) if (x[1:] >= x[:-1]).all() else None
    base = x[0] if steps is not None else x.min()
    rest = steps if steps is not None else x - base
    wide = (int(rest.max()).bit_length() + 7) // 8
    planes = np.ascontiguousarray(rest).view(np.uint8).reshape(-1, 8)[:, :wide]
    return bytes([wide, steps is not None]) + int(base).to_bytes(8, "little") + planes.T.tobytes() + len(x).to_bytes(8, "little")


def _spread(blob: bytes) -> np.ndarray:
    n, wide = int.from_bytes(blob[-8:], "little"), blob[0]
    rest = np.zeros((n, 8), np.uint8)
    if wide:
        rest[:, :wide] = np.frombuffer(blob, np.uint8, n * wide, 10).reshape(wide, n).T
    rest = rest.view(np.uint64).ravel()
    return (np.cumsum(rest, dtype=np.uint64) if blob[1] else rest) + np.uint64(int.from_bytes(blob[2:10], "little"))


def _all(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_spread(b).view(kind) for b in column.to_pylist())])


def _rows(kind: int, part: np.ndarray, hashes: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """One row for each part, with what belongs to it."""
    order = np.lexsort((hashes, part))
    part, hashes, docs = part[order], hashes[order], docs[order]
    keys, at = np.unique(part, return_index=True)
    ends = [*at[1:], len(part)][: len(keys)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(keys), kind, np.int32)),
            pa.array(keys.astype(np.int64)),
            pa.array([_squeeze(hashes[i:j]) for i, j in zip(at, ends, strict=True)], pa.binary()),
            pa.array([_squeeze(docs[i:j]) for i, j in zip(at, ends, strict=True)], pa.binary()),
        ],
        names=["kind", "part", "hashes", "docs"],
    )


def _first(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted hashes and docs; of each entry, whether its doc is the smallest with that hash, and the first such entry."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    smallest = docs[np.flatnonzero(new)][np.cumsum(new) - 1] if len(hashes) else docs
    return hashes, docs, docs == smallest, new


def _read(window: int, ranges: int, buckets: int):
    shift = B.U(64 - (ranges - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, known = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            got: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0

            def flush():
                hashes, docs, smallest, new = _first(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]))
                lost = ~smallest
                out = [_rows(0, (hashes[new] >> shift).astype(np.int64), hashes[new], docs[new])]
                if lost.any():
                    out.append(_rows(1, docs[lost] % buckets, hashes[lost], docs[lost]))
                got.clear()
                return out

            for s in B.slices(batch.column(1)):
                w, hashes, at = _windows(s, window)
                doc = w.doc[at] + s.first
                keep = known[doc]
                got.append((hashes[keep], ids[doc[keep]]))
                held += len(hashes)
                if held > 2_000_000:
                    yield from flush()
                    held = 0
            if held:
                yield from flush()

    return run


def _count(buckets: int):
    def run(key, table):
        """All entries of a range of hashes: what each document loses, by bucket. Losses known before pass on."""
        if key[0].as_py() == 1:
            return table
        hashes, docs, smallest, _ = _first(_all(table.column("hashes"), np.uint64), _all(table.column("docs"), np.int64))
        lost = ~smallest
        return pa.Table.from_batches([_rows(1, docs[lost] % buckets, hashes[lost], docs[lost])])

    return run


def _remove(window: int):
    def run(key, texts, losses):
        out: dict[str, list] = {x: [] for x in ("doc_id", "n_words", "n_removed", "kept_sha256", "spans")}
        hashes, docs = _all(losses.column("hashes"), np.uint64), _all(losses.column("docs"), np.int64)
        order = np.argsort(docs, kind="stable")
        hashes, docs = hashes[order], docs[order]
        for batch in texts.to_batches(max_chunksize=2000):
            ids = batch.column("doc_id").to_pylist()
            for s in B.slices(batch.column("text")):
                w = B.words(s)
                full = None
                data = s.data.tobytes()
                for d in range(s.n):
                    doc, a, b = ids[s.first + d], w.bounds[d], w.bounds[d + 1]
                    i, j = (np.searchsorted(docs, [doc, doc + 1]) if doc is not None else (0, 0))
                    gone, spans = 0, []
                    tokens = data[s.offsets[d] : s.offsets[d + 1]].split()
                    if i < j:
                        if full is None:
                            full = _windows(s, window)
                        _, run_hashes, at = full
                        x, y = np.searchsorted(at, [a, b])
                        hit = at[x:y][np.isin(run_hashes[x:y], hashes[i:j])] - a
                        if len(hit):
                            change = np.zeros(b - a + 1, np.int64)
                            np.add.at(change, hit, 1)
                            np.add.at(change, hit + window, -1)
                            covered = np.cumsum(change[:-1]) > 0
                            edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
                            spans = [{"start": int(p), "end": int(q)} for p, q in edges.reshape(-1, 2)]
                            gone = int(covered.sum())
                            tokens = [t for t, c in zip(tokens, covered, strict=True) if not c]
                    out["doc_id"].append(doc)
                    out["n_words"].append(int(b - a))
                    out["n_removed"].append(gone)
                    out["kept_sha256"].append(hashlib.sha256(b" ".join(tokens)).hexdigest())
                    out["spans"].append(spans)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), SPANS)
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)})

    return run


def repeated_passages(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and spans (removed words, by
    place among the document's words, end exclusive), a row for each row of docs."""
    size = scan_bytes(docs)
    ranges = 1 << max(8, (size // RANGE_BYTES).bit_length())
    buckets = prime(max(256, size // BUCKET_BYTES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(B.tidy(_read(window, ranges, buckets)), PACKED)
    counted = found.groupBy("kind", "part").applyInArrow(_count(buckets), PACKED)
    # Nothing is looked up for a null doc_id; its text places it, so that many of them don't meet in one bucket.
    texts = texts.withColumn("part", F.pmod(F.coalesce("doc_id", F.xxhash64("text")), F.lit(buckets)))
    return texts.groupBy("part").cogroup(counted.groupBy("part")).applyInArrow(_remove(window), SCHEMA)

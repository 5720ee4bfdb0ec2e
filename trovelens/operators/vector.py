"""Exact nearest neighbours: queries against all vectors, in blocks, top k kept at every step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IMAGE_FLOOR = 0.10
#: The most rows that a query may ask for, queries of one pass, and vectors that a task multiplies at once.
MOST_K, BATCH_QUERIES, BLOCK_ROWS = 4096, 1000, 1 << 14


def matrix_of(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """A column of equally long lists as a matrix; the values are not copied one by one."""
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)


def nearest(sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest similarities, ties by the smaller id, best first."""
    if len(sims) > k:
        least = np.partition(sims, len(sims) - k)[len(sims) - k]
        some = np.flatnonzero(sims >= least)
    else:
        some = np.arange(len(sims))
    return some[np.lexsort((ids[some], -sims[some]))[:k]]


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, file_id, similarity: the k nearest of each query, ties by chunk_id; k is at most MOST_K. Of root and mute those that ``vectors`` has come along.

    A task multiplies its blocks with the query matrix and keeps k rows for each query, so what is
    shuffled is k times the queries for each task, whatever the number of vectors. More than
    BATCH_QUERIES queries are answered in several passes, so a pass's matrix is bounded.
    """
    if k > MOST_K:
        raise ValueError(f"at most {MOST_K} rows")
    passes = -(-queries.count() // BATCH_QUERIES)
    if passes <= 1:
        return _knn(vectors, queries, k)
    parts = [_knn(vectors, queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(2 * passes)) == p), k) for p in range(2 * passes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    q = queries.select("query_id", "embedding").orderBy("query_id").collect()  # about BATCH_QUERIES
    ids, matrix = [r[0] for r in q], np.array([r[1] for r in q], np.float64)

    extra = [c for c in ("root", "mute") if c in vectors.columns]
    kinds = {"root": pa.string(), "mute": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        book: dict[tuple, int] = {}  # what comes along, by number: a few roots

        def add(held: list[tuple]) -> None:
            chunk, file, along, block = (np.concatenate(x) for x in zip(*held, strict=True))
            sims = np.round(matrix @ block.T, 9)
            for i, s in enumerate(sims):
                every = [np.concatenate([x, y]) for x, y in zip(kept[i], (s, chunk, file, along), strict=True)]
                pick = nearest(every[0], every[1], k)
                kept[i] = tuple(x[pick] for x in every)

        held, n = [], 0
        for b in batches:
            if b.num_rows == 0 or not ids:
                continue
            told = zip(*[b.column(3 + j).to_pylist() for j in range(len(extra))], strict=True) if extra else [()] * b.num_rows
            along = np.array([book.setdefault(t, len(book)) for t in told], np.int64)
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), along, matrix_of(b, 2)))
            n += b.num_rows
            if n >= BLOCK_ROWS:
                add(held)
                held, n = [], 0
        if held:
            add(held)
        names = list(book)
        out = [(np.full(len(s), i), c, f, s, t) for i, (s, c, f, t) in zip(ids, kept, strict=True) if len(s)]
        for a in range(0, len(out), 50):
            i, c, f, s, t = (np.concatenate(x) for x in zip(*out[a : a + 50], strict=True))
            columns = [pa.array(i.astype(np.int64)), pa.array(c.astype(np.int64)), pa.array(f.astype(np.int64)), pa.array(s)]
            columns += [pa.array([names[x][j] for x in t.tolist()], kinds[e]) for j, e in enumerate(extra)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "file_id", "similarity", *extra])

    schema = ", ".join(["query_id long, chunk_id long, file_id long, similarity double", *[f"{e} {vectors.schema[e].dataType.simpleString()}" for e in extra]])
    near = vectors.select("chunk_id", "file_id", "embedding", *extra).mapInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return near.withColumn("row", F.row_number().over(order)).filter(F.col("row") <= k).drop("row")


def sampled(vectors: DataFrame, n: int, by: str = "file_id") -> DataFrame:
    """A systematic sample of about n vectors by id, 2 n at most."""
    most = vectors.agg(F.max(by)).first()[0] or 0
    return vectors.filter(F.col(by) % max(1, most // n) == 0).orderBy(by).limit(2 * n)


def cosines(sample: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, file_id, similarity of every vector of a sample of MOST_K rows at most."""
    return knn(sample, queries, MOST_K).select("query_id", "chunk_id", "file_id", "similarity")

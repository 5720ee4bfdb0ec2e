"""Embedding whitening by TSQR: the right vectors of a tree of QR factors, no covariance is formed.

Entries are scaled to whole numbers, so sums and with them the centre are exact. Each task reduces its
centred rows to one triangular factor, block after block; factors are merged by QR in a tree until one is
left, whose singular values and right vectors are those of all rows. Rows times these vectors, over the
deviations, are white.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelens.plans.lineage import cut

#: A whole entry is floor(SCALE * entry) + SHIFT; results have COMPONENTS components at most.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Whole entries beyond this are held there, so that they and their sums stay exact.
LARGEST = 1 << 52
#: Entries of a block of rows, and bytes of the factors that one task merges, about.
BLOCK_ENTRIES, MERGE_BYTES = 1 << 21, 1 << 26
#: Singular values below this times the largest one and the number of dimensions are no deviation but rounding.
NOTHING = 1e-13


class Whitening(NamedTuple):
    n: int
    sums: list[int]  # exact, of whole entries by dimension
    values: np.ndarray  # eigenvalues of the covariance, falling, those of components only
    vectors: np.ndarray  # a column for each component
    trace: float

    @property
    def components(self) -> int:
        return len(self.values)


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, x) of the rows with a vector of finite entries only, x in double precision."""
    x = F.transform(column, lambda c: c.cast("double"))
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.select(F.col(key).cast("long").alias("id"), x.alias("x")).filter(F.col("x").isNotNull() & F.coalesce(whole, F.lit(False)))


def of_one_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows of the commonest length (the longer of two), and that length; lengths alone come to the driver."""
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    return rows.filter(F.size("x") == d), d


def blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, whole entries as longs) of about BLOCK_ENTRIES entries, but no fewer rows than 4 d where a batch has them."""
    step = max(4 * d, BLOCK_ENTRIES // max(d, 1), 1)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)
            yield part.column(0), (np.clip(np.floor(SCALE * x) + SHIFT, -LARGEST, LARGEST)).astype(np.int64)


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of whole entries by dimension: halves are summed apart, so that no sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for _, x in blocks(batches, d):
            n += len(x)
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + lo for t, h, lo in zip(total, high, low, strict=True)]
        at = [-1, *range(d)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([v >> 32 for v in (n, *total)], pa.int64()), pa.array([v & 0xFFFFFFFF for v in (n, *total)], pa.int64())], names=["at", "high", "low"])

    halves = rows.mapInArrow(run, "at int, high long, low long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    found = {r["at"]: (r["high"] << 32) + r["low"] for r in halves.collect()}  # d + 1 numbers
    return found.get(-1, 0), [found.get(k, 0) for k in range(d)]


class Centre:
    """Exact deviations: n * x - sum for each entry, reduced by the whole part of the mean so that they fit a long as a rule."""

    def __init__(self, n: int, sums_: list[int]):
        self.n = n
        self.base = [s // n for s in sums_]
        self.rest = [s - n * b for s, b in zip(sums_, self.base, strict=True)]  # 0 to n - 1

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sum as longs, or as Python numbers where these would overflow."""
        y = x - np.array(self.base, np.int64)
        if (int(np.abs(y).max(initial=0)) + 1) * self.n < 1 << 62:
            return y * self.n - np.array(self.rest, np.int64)
        return y.astype(object) * self.n - np.array(self.rest, object)

    def centred(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(np.float64)


def squares(deviations: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; null where one is no long."""
    most = max(int(deviations.max(initial=0)), -int(deviations.min(initial=0)))
    if deviations.dtype != object and most * most * max(1, deviations.shape[1]) < 1 << 63:
        return (deviations * deviations).sum(axis=1).tolist()
    found = [sum(v * v for v in row) for row in deviations.tolist()]
    return [v if v < 1 << 63 else None for v in found]


def upper(stack: np.ndarray) -> np.ndarray:
    """The triangular factor of a stack of rows."""
    return np.linalg.qr(stack, mode="r")


def factor(rows: DataFrame, n: int, sums_: list[int]) -> np.ndarray:
    """The triangular factor of all centred rows: one for each task, merged in a tree of written tables."""
    d = len(sums_)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, r = Centre(n, sums_), np.zeros((0, d))
        for _, x in blocks(batches, d):
            r = upper(np.vstack([r, centre.centred(centre.deviations(x))]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def merged(table: pa.Table) -> pa.Table:
        r = np.zeros((0, d))
        for x in table["r"]:
            r = upper(np.vstack([r, np.frombuffer(x.as_buffer()).reshape(-1, d)]))
        return pa.table({"r": pa.array([r.tobytes()], pa.binary())})

    fan = max(2, min(32, MERGE_BYTES // (8 * d * d)))
    level = cut(rows.mapInArrow(reduced, "r binary").withColumn("k", F.monotonically_increasing_id()))
    left = level.count()
    while left > 1:
        left = -(-left // fan)
        level = cut(level.groupBy(F.pmod(F.xxhash64("k"), F.lit(left)).alias("p")).applyInArrow(merged, "r binary").withColumn("k", F.monotonically_increasing_id()))
        left = min(left, level.count())
    found = level.select("r").collect()  # one factor of d x d numbers
    return np.frombuffer(found[0]["r"]).reshape(-1, d) if found else np.zeros((0, d))


def fitted(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``rows`` (id, x of length d)."""
    n, sums_ = sums(rows, d)
    if n == 0 or d == 0:
        return Whitening(n, sums_, np.zeros(0), np.zeros((d, 0)), 0.0)
    _, s, vt = np.linalg.svd(factor(rows, n, sums_), full_matrices=False)
    trace = float((s * s).sum() / n)
    k = min(components, int((s > NOTHING * d * s[0]).sum())) if len(s) and s[0] > 0 else 0
    return Whitening(n, sums_, (s[:k] ** 2) / n, np.ascontiguousarray(vt[:k].T), trace)


def _white(w: Whitening):
    """A function from blocks of whole entries to (deviations, whitened rows)."""
    centre, project = Centre(w.n, w.sums), w.vectors / np.sqrt(w.values)

    def of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dev = centre.deviations(x)
        return dev, centre.centred(dev) @ project

    return of


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened rows' own covariance minus the identity: a check of the result, by two passes.

    The first pass gives the whitened rows' means, the second multiplies what is centred by them.
    """
    k, d = w.components, len(w.sums)
    if k == 0:
        return 0.0

    def total(batches: Iterator[pa.RecordBatch], by) -> Iterator[pa.RecordBatch]:
        white = _white(w)
        out = sum(by(white(x)[1]) for _, x in blocks(batches, d))
        if isinstance(out, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], names=["at", "v"])

    def summed(by) -> np.ndarray:
        found = rows.mapInArrow(lambda b: total(b, by), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
        return np.array([r["v"] for r in found])  # k, or k x k numbers

    mean = summed(lambda y: y.sum(axis=0)) / w.n
    covariance = summed(lambda y: (y - mean).T @ (y - mean)).reshape(k, k) / w.n
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(rows: DataFrame, w: Whitening) -> DataFrame:
    """id, component, deviation, whitened for each of ``rows`` (id, x) and each component, from 1; nothing is shuffled."""
    k, d = w.components, len(w.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white = _white(w)
        for ids, x in blocks(batches, d):
            dev, y = white(x)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [ids.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(squares(dev), pa.int64()).take(at), pa.array(y.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "deviation", "whitened"])

    schema = "id long, component int, deviation long, whitened double"
    return rows.mapInArrow(run, schema) if k else rows.sparkSession.createDataFrame([], schema)


def report(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key``, component, n, deviation, whitened, explained, identity_error for each usable row and component.

    Rows whose vector is null or holds null or non-finite entries are left out, and so are, in a table of mixed
    lengths, those of another length than the commonest one. Null ids are carried, repeated rows and equal vectors each
    count, other columns are ignored whatever their names. Components without deviation (constant or dependent dimensions) can't be
    whitened and are not there, so one row, equal rows and an empty table give an empty result. Whole entries are
    held within 2**52; a deviation that is no long is null.
    """
    rows, d = of_one_length(usable(vectors, key, column))
    w = fitted(rows, d, components)
    shares = F.array(*[F.lit(float(v / w.trace)) for v in w.values]) if w.components else F.array().cast("array<double>")
    return whitened(rows, w).select(
        F.col("id").alias(key), "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("component") - 1).alias("explained"), F.lit(identity_error(rows, w)).alias("identity_error")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

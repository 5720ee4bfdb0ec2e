"""Bounded, documented samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier is fitted on, at most; each is read whole.
SAMPLE_ROWS = 4000


def held_out(doc_id):
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def set_aside(key: int) -> bool:
    """Whether a sampled row is in the quarter that a first model does not learn from, to set thresholds on."""
    return zlib.crc32(str(key).encode()) % 4 == 0


def sampled(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """_id, _text, _label of at most ``rows`` labelled documents that are not held out, the first by hash of the id.

    The ids are chosen from ``labels`` alone before the join, so only the sample's texts move. This
    bound is for fitting only and on rows only: texts are whole.
    """
    ids = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    ids = ids.filter(F.col("_label").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    chosen = ids.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    # Of rows that repeat an id one is taken (the least text), or one id's copies would break the bound.
    return texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")).select("_id", "_text", "_label")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """The sample as (whole text, label), collected: for small inputs only."""
    return [(r["_text"], r["_label"]) for r in sorted(sampled(docs, labels, label, rows).collect(), key=lambda r: (r["_id"], r["_text"]))]

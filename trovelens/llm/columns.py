"""What the Python operators share: reading the needed columns by batch, under their own names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are Python objects at once. Spark bounds a batch's bytes itself
#: (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set), so very long texts come few at a time.
SLICE_ROWS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def needed(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others (whatever their names) stay out of the scan and the result."""
    return df.select(*[df[n] for n in names])


def folded(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that none clashes with names of ours; ``select("x.*")`` gives them back."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def kept_rows(df: DataFrame, run) -> DataFrame:
    """``df.mapInArrow`` of a function that keeps whole rows; columns go by place meanwhile, so their names may be any (Spark's own call fails on dots)."""
    placed = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return placed.mapInArrow(run, placed.schema).toDF(*df.columns)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of SLICE_ROWS rows at most; empty ones are left out. No session setting is touched."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(k, SLICE_ROWS)


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """(column values as Python lists) of each slice, in the order of names."""
    for batch in slices(batches):
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)

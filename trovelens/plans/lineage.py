"""Cutting lineage with written tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where none is set, a session on this machine alone gets a temporary one; on a cluster a folder of one
    machine would lose rows, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='trovelens-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, partition_by: str | None = None, row_group: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again. ``row_group`` bounds the bytes of what a scan skips or reads as one.

    Unlike an RDD checkpoint the plan runs once, the files are columnar and compressed, and a lost
    executor costs only a re-read. The cluster's own cleaning of the folder removes the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trovelens/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if row_group:
        writer = writer.option("parquet.block.size", row_group)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Streams over tables of events: fed in slices, run until all that is there is done, kept by batch, continued after a stop."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelens.streaming.files import STATE_PROVIDER

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that timers need; what was set before is set again."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, STATE_PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class Feed:
    """A folder of event files that a stream reads as they come."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def add(self, events: DataFrame) -> None:
        """More events; a run that begins after it reads them as one batch."""
        events.select(*self.schema.names).write.mode("append").parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def run(result: DataFrame, path: str, mode: str = "append") -> None:
    """Run a stream until it has read all that is there; each batch's rows are a folder of their own, so that a batch that is run again replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    writer = result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()


def rows(spark: SparkSession, path: str) -> DataFrame:
    """All batches' rows, with batch, their number."""
    return spark.read.parquet(f"{path}/rows")


def subscribe(stream: DataFrame, status: Callable[[DataFrame], DataFrame], key: str, path: str) -> None:
    """Follow the newest row of each ``key`` in a stream (``key``, at, ..) and keep the one-row ``status`` of these wherever it changes.

    The newest rows and the statuses are tables by batch; a batch that is run again writes the same. A status that equals the
    one before it is not kept, so who reads the statuses hears of each change once.
    """
    spark = stream.sparkSession

    def last(table: str, before: int) -> DataFrame | None:
        try:
            found = spark.read.parquet(f"{path}/{table}").filter(F.col("batch") < before)
        except AnalysisException:
            return None
        number = found.agg(F.max("batch")).first()[0]
        return None if number is None else found.filter(F.col("batch") == number).drop("batch")

    def follow(batch: DataFrame, number: int) -> None:
        old = last("newest", number)
        every = batch if old is None else old.select(batch.columns).unionByName(batch)
        newest = every.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "at").alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/newest/batch={number}")
        now, was = status(spark.read.parquet(f"{path}/newest/batch={number}")), last("statuses", number)
        changed = now if was is None else now.exceptAll(was)
        if not changed.isEmpty():
            now.write.mode("overwrite").parquet(f"{path}/statuses/batch={number}")

    stream.writeStream.foreachBatch(follow).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()

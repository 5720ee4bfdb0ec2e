"""Catalogue: the streams over the table of events, stopped and continued in the middle, with the SQL of their results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trovelens.plans.lineage import shared_dir
from trovelens.sources import tables as t
from trovelens.streaming import files as streams
from trovelens.streaming import runs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Days of events that come at once, bursts' gap and the hold of deletions in seconds.
SLICE_DAYS, GAP_S, HOLD_S = 6, 3600, 7200


def register(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def fed(spark: SparkSession, events: DataFrame, consume: Callable[[DataFrame, str], None], end: DataFrame | None = None) -> str:
    """Give ``events`` (at, a time, ..) to a stream in slices of days, each in a run of its own that goes on where the one before has ended. Returns the folder of results.

    ``end`` is a last slice, which closes what still waits for its time.
    """
    path = f"{shared_dir(spark)}/trovelens/{uuid.uuid4().hex}"
    feed = runs.Feed(spark, f"{path}/feed", StructType(events.schema.fields))
    days = F.floor(F.unix_seconds("at") / (86_400 * SLICE_DAYS))
    numbers = sorted(r[0] for r in events.select(days).distinct().collect())  # one for each slice
    for slice_ in [*[events.filter(days == n) for n in numbers], *([] if end is None else [end])]:
        feed.add(slice_)
        consume(feed.stream(), f"{path}/out")
    return f"{path}/out"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


def _end(events: DataFrame) -> DataFrame:
    """A row long after the last one, of no one: it brings the watermark past all that waits."""
    last = events.agg((F.max("at") + F.expr("INTERVAL 30 DAYS")).alias("at"))
    return last.select(*[(F.col("at") if c == "at" else F.lit(-1).cast(k) if k in ("bigint", "int") else F.lit("end").cast(k)).alias(c) for c, k in events.dtypes])


@register("debounce_stream", f"""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= {GAP_S * 1_000_000} OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WHERE event_type <> 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id AS root, min(ts) AS started, count(DISTINCT event_id % 5) AS n_paths, bool_or(event_type = 'error') AS rescan FROM b GROUP BY user_id, burst""")
def debounce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a root's events by session windows; an event of the type view is an access, one of error an overflow."""
    kind = F.when(F.col("event_type") == "view", "access").when(F.col("event_type") == "error", "overflow").otherwise("change")
    e = _events(spark, sf_dir).select(F.col("user_id").alias("root"), F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string")).alias("path"), kind.alias("kind"), "at")

    def consume(stream: DataFrame, out: str) -> None:
        runs.run(streams.debounced_paths(stream.withColumnRenamed("at", "ts"), f"{GAP_S} seconds"), out)

    found = runs.rows(spark, fed(spark, e, consume, _end(e))).filter("root >= 0")
    return found.select("root", F.col("burst.start").cast("timestamp_ntz").alias("started"), F.size("paths").cast("long").alias("n_paths"), "rescan")


@register("held_stream", f"""WITH RECURSIVE e AS (SELECT user_id AS file_id, epoch_us(ts) AS us, event_type = 'error' AS vanished, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT file_id, 0::BIGINT AS k, NULL::BIGINT AS due, NULL::BIGINT AS gone FROM (SELECT DISTINCT file_id FROM e)
  UNION ALL SELECT e.file_id, e.k, CASE WHEN vanished AND us <= due * 1000 THEN due WHEN vanished THEN us // 1000 + {HOLD_S * 1000} END, CASE WHEN us > due * 1000 THEN due END FROM s JOIN e ON e.file_id = s.file_id AND e.k = s.k + 1),
l AS (SELECT file_id, max_by(due, k) AS gone FROM (SELECT file_id, k, struct_pack(d := due) AS due FROM s) GROUP BY 1)
SELECT file_id, make_timestamp(gone * 1000) AS deleted_at FROM s WHERE gone IS NOT NULL UNION ALL SELECT file_id, make_timestamp(gone.d * 1000) FROM l WHERE gone.d IS NOT NULL""")
def held_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions that are held until their file was not seen again for the hold; an event of the type error is a vanishing, any other one a sight."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("file_id"), F.when(F.col("event_type") == "error", "vanished").otherwise("seen").alias("kind"), "event_id", "at")

    def consume(stream: DataFrame, out: str) -> None:
        runs.run(streams.held_deletions(stream.withColumnRenamed("at", "ts"), HOLD_S, nth="event_id"), out)

    with runs.rocks(spark):
        found = runs.rows(spark, fed(spark, e, consume, _end(e)))
    return found.filter("file_id >= 0").select("file_id", F.col("deleted_at").cast("timestamp_ntz").alias("deleted_at"))


@register("status_changes", f"""WITH e AS (SELECT *, epoch_us(ts) // 1000000 // {86_400 * SLICE_DAYS} AS slice FROM events), sl AS (SELECT DISTINCT slice FROM e),
n AS (SELECT sl.slice, user_id, max_by(event_type, (ts, event_id)) AS state FROM sl JOIN e ON e.slice <= sl.slice GROUP BY ALL),
c AS (SELECT slice, CASE WHEN count(*) FILTER (WHERE state = 'error') * 5 > count(*) THEN 'indexing' ELSE 'idle' END AS state, count(*) // 100 AS hundreds FROM n GROUP BY 1),
d AS (SELECT *, lag((state, hundreds)) OVER (ORDER BY slice) AS was FROM c) SELECT dense_rank() OVER (ORDER BY slice) AS nth, state, hundreds FROM d WHERE was IS NULL OR was <> (state, hundreds)""")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an index whose files' last events are its state: the statuses that a subscriber hears of, in order."""
    e = _events(spark, sf_dir).select("user_id", "event_type", F.struct("at", "event_id").alias("place"), "at")

    def status(newest: DataFrame) -> DataFrame:
        n = newest.agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("files"))
        return n.select(F.when(F.col("errors") * 5 > F.col("files"), "indexing").otherwise("idle").alias("state"), F.floor(F.col("files") / 100).alias("hundreds"))

    def consume(stream: DataFrame, out: str) -> None:
        runs.subscribe(stream.select("user_id", "event_type", F.col("place").alias("at")), status, "user_id", out)

    found = spark.read.parquet(f"{fed(spark, e, consume)}/statuses")
    earlier = found.select(F.col("batch").alias("b")).distinct()  # one row for each change
    return found.join(earlier, F.col("b") <= F.col("batch")).groupBy("batch", "state", "hundreds").agg(F.count(F.lit(1)).alias("nth")).select("nth", "state", "hundreds")

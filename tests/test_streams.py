"""Runs of streams: what is kept, what is told, and going on after an end."""

import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from trovelens.streaming import files as streams
from trovelens.streaming import runs

SCHEMA = StructType([StructField("file", LongType()), StructField("at", LongType()), StructField("state", StringType())])


def test_equal_statuses_in_a_row_are_told_once(spark, tmp_path):
    feed, out = runs.Feed(spark, f"file://{tmp_path}/feed", SCHEMA), f"file://{tmp_path}/out"
    status = lambda newest: newest.agg(F.count_if(F.col("state") == "pending").alias("pending"))
    slices = [[(1, 1, "pending"), (2, 1, "pending")], [(1, 2, "error"), (1, 3, "pending")], [(2, 4, "done"), (2, 2, "pending")], [(3, 5, "done")]]
    told = []
    for rows in slices:
        feed.add(spark.createDataFrame(rows, SCHEMA))
        runs.subscribe(feed.stream(), status, "file", out)
        told.append([tuple(r) for r in spark.read.parquet(f"{out}/statuses").orderBy("batch").select("batch", "pending").collect()])
    assert told == [[(0, 2)], [(0, 2)], [(0, 2), (2, 1)], [(0, 2), (2, 1)]]


def test_a_run_goes_on_where_the_last_one_ended(spark, tmp_path):
    feed, out = runs.Feed(spark, f"file://{tmp_path}/feed", SCHEMA), f"file://{tmp_path}/out"
    for k in range(3):
        feed.add(spark.createDataFrame([(k, k, "done")], SCHEMA))
        for _ in range(2):  # the second finds nothing new
            runs.run(feed.stream().select("file"), out)
    assert sorted((r.batch, r.file) for r in runs.rows(spark, out).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_held_deletions_of_one_time_follow_their_order_and_files_share_groups(spark, tmp_path):
    """What a batch costs is its events: files share their group's call, state and timer. Of one time the given order holds; nulls are a file too."""
    schema, path = "file_id long, kind string, ts timestamp, n long", f"file://{tmp_path}"
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, 0, 1000) + datetime.timedelta(seconds=s)
    files = [*range(1, 5001), None]
    first = [(i, kind, at(0), n) for i in files for n, kind in ((2, "vanished"), (1, "seen"))]  # so it is held
    first += [(-1, kind, at(0), n) for n, kind in ((1, "vanished"), (2, "seen"))]  # so it is not
    second = [(i, "vanished", at(200), 3) for i in range(1, 11)] + [(i, "seen", at(100), 3) for i in range(11, 21)] + [(i, "seen", at(101), 3) for i in range(21, 31)]
    feed = runs.Feed(spark, f"{path}/feed", spark.createDataFrame([], schema).schema)
    with runs.rocks(spark):
        for rows in (first, second, [(-2, "seen", at(10_000), 9)]):
            feed.add(spark.createDataFrame(rows, schema))
            runs.run(streams.held_deletions(feed.stream(), 100, nth="n"), f"{path}/out")
    got = runs.rows(spark, f"{path}/out").select("file_id", F.unix_millis("deleted_at").alias("ms")).collect()
    ms = lambda s: int(at(s).replace(tzinfo=datetime.UTC).timestamp() * 1000)
    want = [(i, ms(100)) for i in files if i is None or not 10 < i < 21] + [(i, ms(300)) for i in range(1, 11)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    states = spark.read.format("statestore").load(f"{path}/out/state")
    assert states.count() <= streams.HELD_GROUPS

"""Joins of many rows with one row for each key, where a few keys may hold a large share of the many."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovelens.plans.lineage import cut

#: A key is hot with more than one in SHARE of all rows, so fewer than SHARE keys are; each is joined in SALTS places.
SHARE, SALTS, LEAST = 256, 64, 1000


def skewed_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", sizes: DataFrame | None = None, spread: list[str] | None = None) -> DataFrame:
    """``many`` joined with ``one`` on ``keys``; ``one`` has a row for each key, or few.

    The rows of hot keys are dealt to SALTS places and their row of ``one`` goes to each of these, so no
    task has all rows of a hot key. Which keys are hot is counted, exactly: on ``many``, or given in
    ``sizes`` (the keys and n). ``many`` is read twice and so should be a stored table; its rows are dealt by
    their place in it, or, if it is no stored table, by columns that differ within a key (``spread``). Only hashes of hot keys, fewer than SHARE, come to the driver.
    """
    if sizes is None:
        sizes = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    marked = sizes.select(F.xxhash64(*keys).alias("mark"), "n")
    total = marked.agg(F.sum("n")).first()[0] or 0
    hot = [r["mark"] for r in marked.filter(F.col("n") > max(LEAST, total // SHARE)).select("mark").collect()]
    if not hot:
        return many.join(one, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)
    none, all_ = F.array(F.lit(0).cast("long")), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    place = F.monotonically_increasing_id() if spread is None else F.xxhash64(*spread)
    dealt = many.withColumn("_salt", F.when(is_hot, F.pmod(place, F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    each = one.withColumn("_salt", F.explode(F.when(is_hot, all_).otherwise(none)))
    return dealt.join(each, [*keys, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with a dense number from 1 in the order of ``by``, which no two rows share; no task sees more than a range of it.

    Ranges are dealt and stored; only their sizes, one for each, come to the driver.
    """
    dealt = cut(df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()))
    starts, total = [], 0
    for r in dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect():
        starts.append((r["_range"], total))
        total += r["n"]
    first = df.sparkSession.createDataFrame(starts or [(0, 0)], "_range int, _first long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(by))
    return dealt.join(F.broadcast(first), "_range").withColumn(name, F.col("_first") + within).drop("_range", "_first")

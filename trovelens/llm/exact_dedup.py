"""Exact deduplication by content-defined chunk recipes; DataFrame functions only.

A text is normalised, cut where its own content says so, and each chunk gets a short identifier.
Chunks are deduplicated to a dictionary of (identifier, SHA-256): an identifier that stands for two
different chunks is found there and replaced, so identifiers are verified. A document is then its
ordered list of identifiers, and documents are compared by these lists: a text is read once and
never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelens.llm.columns import folded
from trovelens.plans.lineage import cut
from trovelens.plans.skew import skewed_join

SPACE = r"[\x20\x09-\x0D]+"
#: A chunk is at least MIN_CHARS long and ends after one of these letters and a space, or at MAX_CHARS.
MIN_CHARS, MAX_CHARS, CUT_AFTER = 512, 4096, "[dhklwxz]"


def normalised(text: Column) -> Column:
    """``text`` with every run of ASCII white space as one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunks(text: Column) -> Column:
    """Content-defined chunks of a normalised text, in order; they concatenate to the text."""
    pattern = f"(?s).{{{MIN_CHARS},{MAX_CHARS}}}?{CUT_AFTER} |.{{1,{MAX_CHARS}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, identifier: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, text_sha256 and recipe: an array of (id, digest) for each chunk in order."""
    texts = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("norm"))
    return texts.select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(
            chunks(F.col("norm")),
            lambda c: F.struct(identifier(c).cast("long").alias("id"), F.unhex(F.sha2(c, 256)).alias("digest")),
        ).alias("recipe"),
    )


def collisions(table: DataFrame) -> DataFrame:
    """The dictionary entries (id, digest, verified_id) of identifiers that stand for several chunks.

    The dictionary holds one row for each different chunk; two hash aggregations with map-side
    combine make it. As a rule no identifier is shared and the result is empty.
    """
    entries = table.select(F.explode("recipe").alias("c")).select("c.id", "c.digest").distinct()
    shared = entries.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    return entries.join(shared, "id").select("id", "digest", F.hex("digest").alias("verified"))


def identified(table: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and ids, the list of verified identifiers.

    An identifier is a string of the short number, or of the chunk's own digest where the short
    number is shared, so different chunks never have the same identifier.
    """
    bad = cut(collisions(table))
    if bad.isEmpty():
        return table.select("doc_id", "text_sha256", F.transform("recipe", lambda c: c["id"].cast("string")).alias("ids"))
    row = F.monotonically_increasing_id()
    table = cut(table.withColumn("row", row))
    parts = table.select("row", F.posexplode("recipe").alias("pos", "c")).select("row", "pos", "c.id", "c.digest")
    parts = parts.join(bad, ["id", "digest"], "left").select("row", "pos", F.coalesce("verified", F.col("id").cast("string")).alias("vid"))
    lists = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "vid"))).alias("l"))
    lists = lists.select("row", F.transform("l", lambda x: x["vid"]).alias("ids"))
    return cut(table.select("row", "doc_id", "text_sha256").join(lists, "row", "left").select(
        "doc_id", "text_sha256", F.coalesce("ids", F.array().cast("array<string>")).alias("ids")
    ))


def exact_groups(docs: DataFrame, identifier: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of documents with equal normalised texts the one with the smallest doc_id stays. Null texts
    count as empty, and empty texts are equal to each other. A null doc_id sorts after every other
    and stays only where its group has no id at all. Repeated rows of the doc_id that stays are all
    marked kept (they are the same row); ``deduplicated`` keeps one of them. Other columns are
    ignored, an empty table gives an empty result.
    """
    table = cut(recipes(docs, identifier))
    ids = identified(table)
    # Map-side combine makes one row of a hot group per task.
    groups = ids.groupBy("ids").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    several = cut(groups.filter("group_size > 1"))
    joined = skewed_join(ids, several, ["ids"], "left", sizes=several.withColumnRenamed("group_size", "n"))
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns as they are; one row of each group of equal texts.

    The row with the smallest doc_id stays (a null id counts as the largest). Rows are told apart by id
    and text, so of rows with one id and different texts each is judged by its own text; of rows with
    one id and equal texts one stays, whichever it is. Null and empty texts are equal. Other columns
    are carried whatever their names; an empty table gives an empty result. Texts move in one join.
    """
    groups = cut(exact_groups(docs).select(F.col("doc_id").alias("stays"), "kept", F.col("text_sha256").alias("digest")))
    own = cut(groups.groupBy("stays", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times")))
    # As a rule no id repeats; then the id alone says which rows stay, and texts need not be hashed again.
    repeated = cut(own.groupBy("stays").agg(F.sum("times").alias("n")).filter("n > 1").select("stays"))
    kept = own.filter("kept").select("stays", "digest")
    rows = docs.select(folded(docs).alias("whole"), F.col("doc_id").alias("id"), F.col("text").alias("said"))
    if repeated.isEmpty():
        return rows.join(kept, F.col("id").eqNullSafe(F.col("stays")), "left_semi").select("whole.*")
    # Null-safe anti and semi joins by another name of the id.
    again = repeated.withColumnRenamed("stays", "again")
    once = kept.join(again, F.col("stays").eqNullSafe(F.col("again")), "left_anti").select("stays")
    single = rows.join(once, F.col("id").eqNullSafe(F.col("stays")), "left_semi")
    many = rows.join(again, F.col("id").eqNullSafe(F.col("again")), "left_semi")
    many = many.select("whole", "id", F.sha2(normalised(F.col("said")), 256).alias("own"))
    many = many.join(kept, F.col("id").eqNullSafe(F.col("stays")) & (F.col("own") == F.col("digest")), "left_semi")
    return single.select("whole.*").unionByName(many.dropDuplicates(["id", "own"]).select("whole.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""

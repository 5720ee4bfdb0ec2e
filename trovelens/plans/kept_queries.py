"""Catalogue: an index that is kept through insertions, changes, moves and deletions, with the SQL of a fresh one."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelens.operators import fusion
from trovelens.plans import search_queries as sq
from trovelens.plans.index_store import stamp
from trovelens.plans.kept_index import KeptIndex
from trovelens.plans.lineage import shared_dir
from trovelens.sources import tables as t

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_kept: dict[tuple, KeptIndex] = {}
#: What is left of ``documents`` after all steps.
FINAL_SQL = "documents AS (SELECT * FROM main.documents WHERE doc_id % 11 <> 3)"


def register(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def before(docs: DataFrame) -> DataFrame:
    """``docs`` as they were at first: some with another text, some in another folder."""
    text = F.when(F.col("doc_id") % 7 == 0, F.reverse("text")).otherwise(F.col("text"))
    return docs.withColumn("text", text).withColumn("lang", F.when(F.col("doc_id") % 6 == 1, "xx").otherwise(F.col("lang")))


def put(index: KeptIndex, spark: SparkSession, sf_dir: str, docs: DataFrame, deleted: DataFrame | None = None, vectors: Column | None = None) -> None:
    """One change of the index: these documents' files, chunks and vectors (of the chunks where ``vectors`` holds)."""
    files = t.files_of(docs)
    chunks = t.chunks_of(files)
    text, image = t.vectors(spark, sf_dir, chunks), t.image_vectors(spark, sf_dir).join(docs.select(F.col("doc_id").alias("file_id")), "file_id", "left_semi")
    index.change(files.drop("text"), chunks, text if vectors is None else text.filter(vectors), image, deleted)


def steps(spark: SparkSession, sf_dir: str, index: KeptIndex):
    """All documents go in as they were, a tenth of them later; then some change, some move and some are deleted. Yields after each step."""
    docs = t.read(spark, sf_dir, "documents")
    late, i = F.col("doc_id") % 10 == 0, F.col("doc_id")
    put(index, spark, sf_dir, before(docs.filter(~late)))
    yield "first"
    put(index, spark, sf_dir, before(docs.filter(late)))
    yield "inserted"
    put(index, spark, sf_dir, before(docs).select("doc_id", "lang").join(docs.drop("lang").filter(i % 7 == 0), "doc_id").select(docs.columns))
    yield "changed"
    put(index, spark, sf_dir, docs.filter(i % 6 == 1), vectors=F.col("file_id") % 3 == 0)  # the others' texts are where they were
    yield "moved"
    put(index, spark, sf_dir, docs.limit(0), docs.filter(i % 11 == 3).select(i.alias("file_id")))
    yield "deleted"


def kept(spark: SparkSession, sf_dir: str) -> KeptIndex:
    """The index of an input after all steps, made once for each session and state of the input."""
    key = spark.sparkContext.applicationId, sf_dir, *(stamp(spark, f"{sf_dir}/{x}.parquet") for x in ("documents", "embeddings"))
    if key not in _kept:
        index = KeptIndex(spark, f"{shared_dir(spark)}/trovelens/{uuid.uuid4().hex}")
        for _ in steps(spark, sf_dir, index):
            pass
        _kept[key] = index
    return _kept[key]


def _store(spark: SparkSession, sf_dir: str) -> fusion.Store:
    return kept(spark, sf_dir).open(t.roots(spark, sf_dir))


BASE_SQL = f"{FINAL_SQL}, {sq.BASE_SQL}"
#: An image vector came with its file.
KNN_SQL = sq.KNN_SQL.replace("FROM embeddings WHERE label % 2 = 0", "FROM embeddings WHERE label % 2 = 0 AND vec_id IN (SELECT file_id FROM files)")


@register("kept_search", f"WITH {BASE_SQL}, {sq.BM25_SQL}, {KNN_SQL}, {sq.FUSE_SQL} SELECT {sq._SHOWN} FROM answer")
def kept_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq._shown(fusion.search(t.search_queries(spark, sf_dir), _store(spark, sf_dir), t.NOW_S))


@register("kept_vocabulary", f"WITH {BASE_SQL} SELECT term, count(DISTINCT chunk_id) AS n_chunks FROM occ0 GROUP BY 1")
def kept_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).keyword.vocabulary.select("term", "n_chunks")


@register("kept_files", f"WITH {BASE_SQL} SELECT file_id, path, content_hash, count(*) AS n_chunks FROM files JOIN chunks USING (file_id) GROUP BY ALL")
def kept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    return store.files.join(store.chunks, "file_id").groupBy("file_id", "path", "content_hash").agg(F.count(F.lit(1)).alias("n_chunks"))

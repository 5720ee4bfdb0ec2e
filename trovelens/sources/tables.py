"""The model's tables (files, roots, chunks, vectors, queries) over driver tables, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelens.functions.text import name_words, trim_all

#: Times are counted from here; nothing reads the clock.
BASE_NS = 1_700_000_000_000_000_000
NOW_S = 1_700_000_000 + 40 * 86_400
CHUNK_WORDS, CHUNK_STEP = 400, 350
#: Chunks begin and end at multiples of so many words.
PIECE_WORDS = math.gcd(CHUNK_WORDS, CHUNK_STEP)
#: Chunk ids leave room for this many chunks of a file: more than any text that Spark can hold has.
CHUNK_ID = 1 << 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(read(spark, sf_dir, "documents"))


def files_of(d: DataFrame) -> DataFrame:
    """One row per document as a file; the time of change, an hour for each id, is a decimal because nanoseconds of ids over 2,089,825 are no longs."""
    text = F.coalesce("text", F.lit(""))
    word = F.concat(F.regexp_extract(text, "[A-Za-z]+", 0), F.lit("_"), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    name = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("IMG_"), F.col("doc_id").cast("string"), F.lit(".txt"))).otherwise(word)
    rest = F.pmod("doc_id", F.lit(10))
    return d.select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("root"), name.alias("file_name"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), name).alias("path"),
        F.col("n_chars").alias("size"), F.sha2(text, 256).alias("content_hash"),
        (F.lit(BASE_NS) + F.col("doc_id").cast("decimal(19,0)") * F.lit(3_600_000_000_000)).cast("decimal(33,0)").alias("mtime_ns"), F.col("lang"),
        F.when(rest == 0, "pending").when(rest == 1, "error").when(rest == 2, "skipped").when(rest == 3, "indexing").otherwise("indexed").alias("state"),
        text.alias("text"),
    )


_NAME = "CASE WHEN doc_id % 9 = 0 THEN 'IMG_' || doc_id || '.txt' ELSE regexp_extract(coalesce(text, ''), '[A-Za-z]+') || '_' || lang || '_' || doc_id || '.txt' END"
FILES_SQL = f"""files AS (
  SELECT doc_id AS file_id, source AS root, {_NAME} AS file_name, source || '/' || lang || '/' || {_NAME} AS path,
    n_chars AS size, sha256(coalesce(text, '')) AS content_hash, {BASE_NS} + doc_id * 3600000000000 AS mtime_ns, lang,
    CASE doc_id % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' WHEN 2 THEN 'skipped' WHEN 3 THEN 'indexing' ELSE 'indexed' END AS state,
    coalesce(text, '') AS text FROM documents)"""


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source as a root folder; a few are off, missing or unreadable."""
    s = read(spark, sf_dir, "documents").select(F.col("source").alias("root")).distinct()
    status = F.when(F.col("root") == "src5", "missing").when(F.col("root") == "src7", "permission_denied").when(F.col("root") == "src9", "watch_failed").otherwise("ok")
    return s.select("root", (F.col("root") != "src3").alias("enabled"), status.alias("status"))


ROOTS_SQL = """roots AS (SELECT DISTINCT source AS root, source <> 'src3' AS enabled,
  CASE source WHEN 'src5' THEN 'missing' WHEN 'src7' THEN 'permission_denied' WHEN 'src9' THEN 'watch_failed' ELSE 'ok' END AS status FROM documents)"""


def word_pieces(text):
    """Runs of PIECE_WORDS words (the last one may be shorter), each word with the white space after it."""
    return F.regexp_extract_all(text, F.lit(rf"(?:\S+\s*){{1,{PIECE_WORDS}}}+"), F.lit(0))


def chunks(spark: SparkSession, sf_dir: str, *told: str) -> DataFrame:
    return chunks_of(files(spark, sf_dir), *told)


def chunks_of(files_: DataFrame, *told: str) -> DataFrame:
    """Chunks of CHUNK_WORDS words every CHUNK_STEP words, and the file's name as its last chunk. ``told``: columns of the file that come along.

    As if read from pictures and codes, the texts of some files are ocr and qr chunks; some files have pages.
    """
    size, step = CHUNK_WORDS // PIECE_WORDS, CHUNK_STEP // PIECE_WORDS
    f = files_.select("file_id", "path", *told, word_pieces(F.col("text")).alias("w"))
    n = F.size("w")
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step)).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    body = F.transform(starts, lambda i: trim_all(F.array_join(F.slice(F.col("w"), i * step + 1, size), "")))
    source = F.when(F.col("file_id") % 10 == 7, "ocr").when(F.col("file_id") % 10 == 9, "qr").otherwise("body")
    every = F.concat(F.transform(body, lambda t: F.struct(source.alias("source"), t.alias("text"))), F.array(F.struct(F.lit("filename").alias("source"), name_words(F.col("path")).alias("text"))))
    c = f.select("file_id", *told, F.posexplode(every).alias("ordinal", "c"))
    page = F.when((F.col("file_id") % 4 == 1) & (F.col("c.source") != "filename"), F.col("ordinal").cast("long") + 1)
    return c.select((F.col("file_id") * CHUNK_ID + F.col("ordinal")).alias("chunk_id"), "file_id", F.col("ordinal").cast("long").alias("ordinal"), "c.source", "c.text", page.alias("page"), *told)


_NAME_SQL = r"trim(regexp_replace(regexp_replace(path, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '[/_\-.\s]+', ' ', 'g'))"
CHUNKS_SQL = rf"""units AS (SELECT file_id, path, regexp_extract_all(text, '\S+\s*') AS w FROM files),
counted AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= {CHUNK_WORDS} THEN 1 ELSE 1 + CAST(ceil((len(w) - {CHUNK_WORDS}) / {CHUNK_STEP}.0) AS INT) END AS k FROM units),
chunks AS (
  SELECT file_id * {CHUNK_ID} + i AS chunk_id, file_id, i AS ordinal, CASE file_id % 10 WHEN 7 THEN 'ocr' WHEN 9 THEN 'qr' ELSE 'body' END AS source,
    regexp_replace(array_to_string(list_slice(w, i * {CHUNK_STEP} + 1, i * {CHUNK_STEP} + {CHUNK_WORDS}), ''), '^\s+|\s+$', '', 'g') AS text,
    CASE WHEN file_id % 4 = 1 THEN i + 1 END AS page
  FROM (SELECT *, unnest(range(k)) AS i FROM counted)
  UNION ALL SELECT file_id * {CHUNK_ID} + k, file_id, k, 'filename', {_NAME_SQL}, NULL FROM counted)"""


def vectors(spark: SparkSession, sf_dir: str, chunks_: DataFrame) -> DataFrame:
    """chunk_id, file_id, embedding, label: the text vectors, one for a file: of its first chunk, or of its name's for every third."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id"), "embedding", "label")
    last = chunks_.filter("source = 'filename'").select("file_id", F.col("ordinal").alias("last"))
    at = F.when(F.col("file_id") % 3 == 0, F.col("last")).otherwise(0)
    return e.join(last, "file_id").select((F.col("file_id") * CHUNK_ID + at).alias("chunk_id"), "file_id", "embedding", "label")


def image_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id (the file's id: an image has no chunk), file_id, embedding: those of even labels."""
    e = read(spark, sf_dir, "embeddings").filter(F.col("label") % 2 == 0)
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("file_id"), "embedding")


VECTORS_SQL = f"""vecs AS (SELECT vec_id * {CHUNK_ID} + CASE WHEN vec_id % 3 = 0 THEN ordinal ELSE 0 END AS chunk_id, vec_id AS file_id, embedding, label
  FROM embeddings JOIN chunks ON file_id = vec_id AND source = 'filename'),
imgs AS (SELECT vec_id AS chunk_id, vec_id AS file_id, embedding FROM embeddings WHERE label % 2 = 0)"""


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled queries, one for each benchmark passage: two of its words, some as a phrase, the last one cut to a prefix, and the vector of the same number."""
    b = read(spark, sf_dir, "benchmark")
    w = F.split("text", r"\s+")
    i = F.col("item_id")
    query = (
        F.when(i % 5 == 0, F.concat(w[1], F.lit("-"), w[2]))
        .when(i % 7 == 3, F.concat(w[1], F.lit("-"), w[2], F.lit(" "), F.substring(w[3], 1, 3)))
        .otherwise(F.concat(w[1], F.lit(" "), F.substring(w[2], 1, 4)))
    )
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return b.join(e, "item_id").select(F.col("item_id").alias("query_id"), query.alias("query"), "embedding", F.col("text").alias("passage"))


QUERIES_SQL = r"""queries AS (SELECT item_id AS query_id, CASE WHEN item_id % 5 = 0 THEN w[2] || '-' || w[3] WHEN item_id % 7 = 3 THEN w[2] || '-' || w[3] || ' ' || substr(w[4], 1, 3)
  ELSE w[2] || ' ' || substr(w[3], 1, 4) END AS query, embedding, text AS passage
  FROM (SELECT *, regexp_split_to_array(text, '\s+') AS w FROM benchmark) JOIN embeddings ON vec_id = item_id)"""

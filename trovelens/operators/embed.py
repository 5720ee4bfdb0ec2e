"""Embedders: a registry of models and a deterministic one by feature hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelens.plans.lineage import cut

BATCH, SPAN_LEAST = 16, 64
#: What text models are told of a text.
PASSAGE, QUERY = "passage: ", "query: "
#: name -> (dimension, maker of a function from texts to vectors); made once in each worker.
MODELS: dict[str, tuple[int, Callable[[], Callable[[list[str]], np.ndarray]]]] = {}


def register_model(name: str, dim: int, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> None:
    MODELS[name] = dim, make


def l2_normalised(v: Column) -> Column:
    """A vector of length 1; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def hash_embed(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """key and embedding: each lower-case word adds 1 or -1 at a place its hash chooses; normalised. Built-ins only."""
    words = df.select(key, F.explode_outer(F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")).alias("w"))
    h = F.xxhash64("w")
    cells = words.select(key, F.pmod(h, F.lit(dim)).alias("d"), F.when(F.col("w").isNull(), 0).when(F.shiftrightunsigned(h, 63) == 1, -1).otherwise(1).alias("s"))
    summed = cells.groupBy(key, "d").agg(F.sum("s").alias("s"))
    as_map = summed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("d", F.lit(0)), "s"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0)).cast("double"))
    return as_map.select(key, dense.alias("v")).select(key, l2_normalised(F.col("v")).alias("embedding"))


def length_batches(lengths: list[int]) -> list[int]:
    """The batch of each item of a list sorted by length: a new one at BATCH items or past twice the first item's length."""
    out, batch, first, n = [], -1, 0, BATCH
    for size in lengths:
        if n >= BATCH or size > 2 * max(first, SPAN_LEAST):
            batch, first, n = batch + 1, size, 0
        out.append(batch)
        n += 1
    return out


DOC_CHARS = 1500
#: name -> maker of a function from (query, documents) to scores; made once in each worker.
RERANKERS: dict[str, Callable[[], Callable[[str, list[str]], list[float]]]] = {}


def register_reranker(name: str, make: Callable[[], Callable[[str, list[str]], list[float]]]) -> None:
    RERANKERS[name] = make


def rerank_documents(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_id and document: what a reranker reads of a file, its name and then its text chunks in order, DOC_CHARS characters.

    A chunk adds a character at least, so those after the first DOC_CHARS can't be in it and don't move.
    """
    own = chunks.filter((F.col("source") != "filename") & (F.col("ordinal") < DOC_CHARS)).select("file_id", "ordinal", F.substring("text", 1, DOC_CHARS).alias("text"))
    texts = own.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("_t"))
    document = F.concat(F.col("file_name"), F.when(F.col("_t").isNotNull(), F.concat(F.lit("\n"), F.col("_t"))).otherwise(""))
    return files.select("file_id", "file_name").join(texts, "file_id", "left").select("file_id", F.substring(document, 1, DOC_CHARS).alias("document"))


def reranked(hits: DataFrame, documents: DataFrame, queries: DataFrame, name: str) -> DataFrame:
    """``hits`` (query_id, file_id, rank) with model: a registered reranker's score of the query and the file's document."""
    make = RERANKERS[name]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make()
        for f in frames:
            out = f.assign(model=0.0)
            for query, part in f.groupby("query"):
                out.loc[part.index, "model"] = score(query, part["document"].tolist())
            yield out[["query_id", "file_id", "rank", "model"]]

    rows = hits.select("query_id", "file_id", "rank").join(queries.select("query_id", "query"), "query_id").join(documents, "file_id")
    kinds = dict(hits.dtypes)
    return rows.mapInPandas(run, f"query_id {kinds['query_id']}, file_id {kinds['file_id']}, rank {kinds['rank']}, model double")


def query_vectors(queries: DataFrame, text: str | None, image: str | None = None) -> DataFrame:
    """query_id, text_vector, image_vector by registered models; null for blank queries and absent models. An image model that fails costs only its vector."""
    asked = queries.select("query_id", F.when(F.col("query").rlike(r"\S"), F.concat(F.lit(QUERY), F.col("query"))).alias("query"))
    out = queries.select("query_id")
    for name, column in ((text, "text_vector"), (image, "image_vector")):
        if name is None:
            out = out.withColumn(column, F.lit(None).cast("array<float>"))
            continue
        made = model_embed(asked.filter("query IS NOT NULL"), "query_id", "query", name)
        if column == "text_vector":  # without its meaning a query must not pass for one
            made = made.withColumn("embedding", F.when(F.col("error").isNotNull(), F.raise_error("error")).otherwise(F.col("embedding")))
        out = out.join(made.select("query_id", F.col("embedding").alias(column)), "query_id", "left")
    return out


def chunk_vectors(chunks: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, failed) of chunks (chunk_id, file_id, source, text) by a registered model, passages told as such.

    A file of which a chunk fails keeps the vector of its name alone and is in error; if that fails too, all stops.
    """
    told = chunks.withColumn("text", F.concat(F.lit(PASSAGE), F.coalesce("text", F.lit(""))))
    made = cut(model_embed(told, "chunk_id", "text", name).join(chunks.select("chunk_id", "file_id", "source"), "chunk_id"))
    bad = made.filter("error IS NOT NULL")
    if names := bad.filter("source = 'filename'").select("file_id", "error").limit(1).collect():
        raise RuntimeError(f"the name of file {names[0][0]} can't be embedded: {names[0][1]}")
    failed = bad.groupBy("file_id").agg(F.min("error").alias("error"))
    kept = made.join(failed.select("file_id", F.lit(True).alias("_bad")), "file_id", "left").filter(F.col("_bad").isNull() | (F.col("source") == "filename"))
    return kept.select("chunk_id", "file_id", "embedding"), failed


def model_embed(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """key, embedding, error by a registered model. Rows go in batches of like length; a batch that fails is tried row by row."""
    dim, make = MODELS[name]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            f = f.assign(n=f[text].fillna("").str.len()).sort_values("n", kind="stable")
            out = []
            for _, part in f.groupby(length_batches(f["n"].tolist())):
                texts = part[text].fillna("").tolist()
                try:
                    found = [(v.tolist(), None) for v in model(texts)]
                except Exception:  # noqa: BLE001 - find the row that fails
                    found = []
                    for t in texts:
                        try:
                            found.append((model([t])[0].tolist(), None))
                        except Exception as e:  # noqa: BLE001
                            found.append((None, str(e)[:200]))
                out += [(k, v, e) for k, (v, e) in zip(part[key], found, strict=True)]
            yield pd.DataFrame(out, columns=[key, "embedding", "error"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>, error string")

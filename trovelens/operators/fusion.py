"""Fusion of ranked lists, boosts, copies, weak results: from lists to the answer, for a batch of queries."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelens.functions.text import is_opaque_name, match_words
from trovelens.operators.keyword import HELD_HITS, LIST_LIMIT, KeywordIndex, fetch_rows, first_per_file, held, keyword_list, searchable
from trovelens.operators.vector import BATCH_QUERIES, IMAGE_FLOOR, knn

RRF_K = 60
WEIGHTS = {"keyword": 1.0, "text": 1.0, "image": 1.1}
IMAGE_FETCH = 50
FOLD_BELOW = 0.80
#: Which lists a mode reads.
MODES = {"hybrid": ("keyword", "text", "image"), "keyword": ("keyword",), "vector": ("text",), "visual": ("image",)}


class Store(NamedTuple):
    """What a search reads: the keyword index, chunks, files, roots, and vectors (chunk_id, file_id, embedding), either of which may be absent.

    Stored vectors also have their file's root, and mute: whether they are of a name chunk whose name has no word in it. What is found then
    says so itself, and neither files nor chunks are looked up for it.
    """

    keyword: KeywordIndex | None
    chunks: DataFrame
    files: DataFrame
    roots: DataFrame
    text_vectors: DataFrame | None = None
    image_vectors: DataFrame | None = None


def of_searchable(near: DataFrame, store: Store) -> DataFrame:
    """Rows whose file is in a searchable root."""
    if "root" not in near.columns:
        near = near.join(store.files.select("file_id", "root"), "file_id")
    return near.join(searchable(store.roots), "root", "left_semi").drop("root")


def mute(source: Column, file_name: Column) -> Column:
    """Whether a chunk is a name that has no word in it."""
    return F.coalesce((source == "filename") & is_opaque_name(file_name), F.lit(False))


def speaking(near: DataFrame, store: Store) -> DataFrame:
    """Rows (chunk_id, file_id, ..) without the name chunks of names that have no word in them."""
    if "mute" in near.columns:
        return near.filter(~F.col("mute")).drop("mute")
    known = near.join(store.chunks.select("chunk_id", "source"), "chunk_id").join(store.files.select("file_id", "file_name"), "file_id")
    return known.filter(~mute(F.col("source"), F.col("file_name"))).drop("source", "file_name")


def vectors_told(vectors: DataFrame, files: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """``vectors`` with root, and mute if they are of ``chunks``: what a stored vector table has. A vector of no file takes its place among the nearest and has no root."""
    known = vectors.join(files.select("file_id", "root", "file_name"), "file_id", "left")
    if chunks is None:
        return known.drop("file_name")
    known = known.join(chunks.select("chunk_id", "source"), "chunk_id", "left")
    return known.withColumn("mute", mute(F.col("source"), F.col("file_name"))).drop("source", "file_name")


def text_list(store: Store, queries: DataFrame, limit: int = LIST_LIMIT, fetch: int | None = None) -> DataFrame:
    """query_id, file_id, chunk_id, similarity, rank. k rows are taken first, then filtered by root and opaque names, so fewer may be left."""
    fetch = fetch_rows(limit) if fetch is None else fetch
    kept = speaking(of_searchable(knn(store.text_vectors, queries, fetch).drop("row"), store), store)
    return first_per_file(kept.select("query_id", "chunk_id", "file_id", "similarity"), [F.desc("similarity"), "chunk_id"], fetch, limit)


def image_list(store: Store, queries: DataFrame, limit: int = IMAGE_FETCH, floor: float = IMAGE_FLOOR) -> DataFrame:
    """query_id, file_id, similarity, rank: the nearest ``limit`` files, then searchable roots and the floor."""
    near = knn(store.image_vectors, queries, limit).drop("row").filter(F.col("similarity") >= floor)
    return first_per_file(of_searchable(near, store), [F.desc("similarity"), "chunk_id"], limit, limit)


def asked(queries: DataFrame) -> DataFrame:
    """The queries that are not blank, held if they are a batch: blank ones have no answer and nothing is read for them."""
    return held(queries.filter(F.col("query").rlike(r"\S")), BATCH_QUERIES)


def lists(store: Store, queries: DataFrame, mode: str = "hybrid", depth: int | None = None, words: DataFrame | None = None) -> dict[str, DataFrame]:
    """The ranked lists that a mode reads, by name; a list whose vectors are absent is left out. ``depth`` reads further down each; ``words`` is the keyword list, if it is there already."""
    out = {}
    for name in MODES[mode]:
        if name == "keyword":
            out[name] = keyword_list(store.keyword, queries, store.files, store.roots, depth or LIST_LIMIT) if words is None else words
        elif name == "text" and store.text_vectors is not None:
            out[name] = text_list(store, queries, depth or LIST_LIMIT)
        elif name == "image" and store.image_vectors is not None:
            out[name] = image_list(store, queries, depth or IMAGE_FETCH)
    return out


def fuse(lists: dict[str, DataFrame]) -> DataFrame:
    """query_id, file_id, rrf, each list's similarity and whether it has the file, and the best chunk of the first list that has one.

    rrf is the sum of weight / (RRF_K + rank), absent lists 0.
    """
    parts = []
    for name, df in lists.items():
        sim = F.col("similarity") if "similarity" in df.columns else F.lit(None).cast("double")
        chunk = F.col("chunk_id") if "chunk_id" in df.columns and name != "image" else F.lit(None).cast("long")
        parts.append(df.select("query_id", "file_id", F.lit(name).alias("list"), "rank", sim.alias("similarity"), chunk.alias("chunk_id")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    weight = F.lit(0.0)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("list") == name, F.lit(w)).otherwise(weight)
    of = {n: F.max(F.when(F.col("list") == n, F.col("similarity"))).alias(f"{n}_similarity") for n in ("text", "image")}
    flags = [F.max(F.col("list") == n).alias(f"in_{n}") for n in WEIGHTS]
    best = F.coalesce(*[F.max(F.when(F.col("list") == n, F.col("chunk_id"))) for n in ("keyword", "text")])
    return every.groupBy("query_id", "file_id").agg(F.sum(weight / (RRF_K + F.col("rank"))).alias("rrf"), *of.values(), *flags, best.alias("chunk_id"))


def filename_boost(query: Column, name: Column) -> Column:
    """1 to 1.2 by the share of the query's words that are words of the name; duplicates in the query count."""
    q, n = match_words(query), match_words(name)
    hit = F.size(F.filter(q, lambda t: F.array_contains(n, t)))
    return F.when(F.size(q) == 0, 1.0).otherwise(1 + 0.2 * hit / F.size(q))


def recency_boost(mtime_ns: Column, now_s: int) -> Column:
    """1.1 falling to 1.0 over 30 days; a time (a long or a decimal) ahead of now is now."""
    seconds = ((mtime_ns - F.pmod(mtime_ns, F.lit(1_000_000_000))) / 1_000_000_000).cast("double")
    age = F.greatest(F.lit(now_s) - seconds, F.lit(0)) / 86_400
    return 1 + 0.1 * F.greatest(F.lit(0.0), 1 - age / 30)


def boosted(fused: DataFrame, queries: DataFrame, files: DataFrame, now_s: int) -> DataFrame:
    """Scores times boosts, ranked from 1: ties keep the fused order, then the smaller file."""
    # What was found is held, so files are read where they are.
    rows = files.select("file_id", "file_name", "path", "mtime_ns", "content_hash").join(held(fused, HELD_HITS), "file_id").join(queries.select("query_id", "query"), "query_id")
    score = F.round(F.col("rrf") * filename_boost(F.col("query"), F.col("file_name")) * recency_boost(F.col("mtime_ns"), now_s), 9)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.round("rrf", 9)), "file_id")
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(order).cast("long"))


def match_sources() -> Column:
    """The lists a hit is in, in their fixed order, then what its best chunk is: ocr, qr, or the name if the keyword list has it."""
    named = [("keyword", F.col("in_keyword")), ("semantic", F.col("in_text")), ("visual", F.col("in_image"))]
    named += [("ocr", F.col("source") == "ocr"), ("qr", F.col("source") == "qr"), ("filename", (F.col("source") == "filename") & F.col("in_keyword"))]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named]), lambda x: x.isNotNull())


def collapse_copies(ranked: DataFrame, limit: int) -> DataFrame:
    """Of the first 2 * limit hits, those with an earlier hit's content fold into it (copies: their paths); null content never folds."""
    top = ranked.filter(F.col("rank") <= 2 * limit)
    key = F.coalesce("content_hash", F.concat(F.lit("#"), F.col("file_id").cast("string")))
    same = Window.partitionBy("query_id", key).orderBy("rank")
    every = Window.partitionBy("query_id", key).orderBy("rank").rowsBetween(1, Window.unboundedFollowing)
    folded = top.withColumn("nth", F.row_number().over(same)).withColumn("copies", F.collect_list("path").over(every)).filter("nth = 1").drop("nth")
    again = Window.partitionBy("query_id").orderBy("rank")
    return folded.withColumn("rank", F.row_number().over(again).cast("long")).filter(F.col("rank") <= limit)


def strength() -> Column:
    """weak: not by keyword, no image similarity, text similarity below the fold."""
    weak = ~F.col("in_keyword") & F.col("image_similarity").isNull() & (F.col("text_similarity") < FOLD_BELOW)
    return F.when(weak, "weak").otherwise("strong")


def strong_first(hits: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("strength") == "weak", "rank")
    return hits.withColumn("position", F.row_number().over(order).cast("long"))


def detailed(hits: DataFrame, store: Store) -> DataFrame:
    """Hits with source, page and text of their best chunk, and match_sources."""
    hits = held(hits, HELD_HITS)
    own = store.chunks.select("chunk_id", "source", "page", F.col("text").alias("chunk_text"))
    found = own.join(hits.filter("chunk_id IS NOT NULL"), "chunk_id")
    # A picture has no chunk.
    without = hits.filter("chunk_id IS NULL").select("*", *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in own.columns[1:]])
    return found.unionByName(without).withColumn("match_sources", match_sources())


def search(queries: DataFrame, store: Store, now_s: int, limit: int = 10, mode: str = "hybrid", words: DataFrame | None = None) -> DataFrame:
    """The answer of each query: the mode's lists, fused, boosted, copies folded, strong before weak.

    A mode with one list has the same boosts and so is comparable. Lists whose vectors are absent are left
    out; ``words`` is these queries' keyword list, if it is there already. Blank queries, a limit under 1 and a mode none of whose lists is there have no hits.
    """
    queries = asked(queries)
    found = lists(store, queries, mode, words=words)
    if limit < 1 or not found:
        queries, limit = queries.limit(0), max(limit, 1)
        found = {"keyword": keyword_list(store.keyword, queries, store.files, store.roots)}
    files = store.files.select("file_id", "root", "file_name", "path", "mtime_ns", "content_hash")
    hits = collapse_copies(boosted(fuse(found), queries, files, now_s), limit)
    return strong_first(detailed(hits, store).withColumn("strength", strength()))

"""Statistical rankers, labels, slot reranking and retrieval metrics."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelens.functions.text import is_lookup, query_terms
from trovelens.operators import fusion
from trovelens.operators.keyword import coverage, keyword_list
from trovelens.operators.vector import MOST_K, cosines, knn, sampled
from trovelens.plans.lineage import cut

LEAST_ROWS, SD_FLOOR, SAMPLE = 20, 0.02, 500
EPSILON = 0.0005


class ZParams(NamedTuple):
    """Which files are candidates, how meaning and words count, and what the scale is taken from."""

    z_gate: float = 2.0
    z_weight: float = 1.0
    word_weight: float = 2.0
    coverage_gate: float = 0.5
    image_floor: float | None = None
    words_gated: bool = False
    sample_scale: bool = False


def scale(similarities: DataFrame) -> DataFrame:
    """query_id, n, mean and population deviation (floored); null under LEAST_ROWS rows."""
    s = similarities.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("m"), F.stddev_pop("similarity").alias("d"))
    enough = F.col("n") >= LEAST_ROWS
    return s.select("query_id", "n", F.when(enough, F.col("m")).alias("mean"), F.when(enough, F.greatest("d", F.lit(SD_FLOOR))).alias("sd"))


def sample_cosines(store: fusion.Store, queries: DataFrame, n: int = SAMPLE) -> dict[str, DataFrame]:
    """query_id, file_id, similarity by modality, of a systematic sample of each vector table."""
    tables = {"text": store.text_vectors, "image": store.image_vectors}
    return {m: cosines(sampled(t, n), queries) for m, t in tables.items() if t is not None}


def fetched_cosines(store: fusion.Store, queries: DataFrame, text: int = 100, image: int = 50) -> dict[str, DataFrame]:
    """The same of the nearest rows that the lists fetch, in searchable roots."""
    out = {}
    if store.text_vectors is not None:
        out["text"] = fusion.speaking(fusion.of_searchable(knn(store.text_vectors, queries, text), store), store)
    if store.image_vectors is not None:
        out["image"] = fusion.of_searchable(knn(store.image_vectors, queries, image), store)
    return out


def scales(similarities: dict[str, DataFrame]) -> DataFrame:
    """query_id, modality, n, mean, sd of each modality."""
    parts = [scale(s).withColumn("modality", F.lit(m)) for m, s in similarities.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def threshold_label(hits: DataFrame, scales_: DataFrame, text_z: float, image_z: float) -> DataFrame:
    """``hits`` with label: strong by keyword, or if either similarity is far enough above its scale.

    A similarity without a scale is strong: nothing can judge it.
    """
    wide = scales_.groupBy("query_id").agg(*[F.max(F.when(F.col("modality") == m, F.col(c))).alias(f"_{m}_{c}") for m in ("text", "image") for c in ("mean", "sd")])
    rows = hits.join(wide, "query_id", "left")

    def clears(m: str, least: float) -> Column:
        c = F.col(f"{m}_similarity")
        z = (c - F.col(f"_{m}_mean")) / F.col(f"_{m}_sd")
        return F.when(F.col(f"_{m}_mean").isNull(), c.isNotNull()).otherwise(F.coalesce(z >= least, F.lit(False)))

    strong = F.col("in_keyword") | clears("text", text_z) | clears("image", image_z)
    return rows.withColumn("label", F.when(strong, "strong").otherwise("weak")).drop(*[f"_{m}_{c}" for m in ("text", "image") for c in ("mean", "sd")])


def meaning_z(rows: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """z of each (query_id, modality, similarity, ..): centred for each modality, or overall if that has few rows.

    Centres, the mean and the deviation of the centred similarities are those of ``reference`` (query_id,
    modality, similarity), by default of the rows themselves: three aggregates of it, from sums by modality.
    """
    ref = rows if reference is None else reference
    s = F.col("similarity")
    by = ref.groupBy("query_id", "modality").agg(F.count(F.lit(1)).alias("n"), F.sum(s).alias("t"), F.sum(s * s).alias("q"))
    overall = by.groupBy("query_id").agg((F.sum("t") / F.sum("n")).alias("every"))
    centres = by.join(overall, "query_id").withColumn("centre", F.when(F.col("n") >= LEAST_ROWS, F.col("t") / F.col("n")).otherwise(F.col("every")))
    # Sums of centred similarities follow from the sums: of (s - c) it is t - n c, of its square q - 2 c t + n c c.
    n, t, q, c = (F.col(x) for x in ("n", "t", "q", "centre"))
    moments = centres.groupBy("query_id").agg((F.sum(t - n * c) / F.sum(n)).alias("mean"), (F.sum(q - 2 * c * t + n * c * c) / F.sum(n)).alias("square"))
    sd = F.greatest(F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))), F.lit(SD_FLOOR))
    known = rows.join(overall, "query_id", "left").join(centres.select("query_id", "modality", "centre"), ["query_id", "modality"], "left")
    known = known.join(moments.select("query_id", "mean", sd.alias("sd")), "query_id", "left")
    z = (s - F.coalesce("centre", "every") - F.col("mean")) / F.col("sd")
    return known.withColumn("z", F.coalesce(z, F.lit(0.0))).drop("every", "centre", "mean", "sd")


def _joined(parts: dict[str, DataFrame]) -> DataFrame:
    rows = [p.select("query_id", "chunk_id", "file_id", "similarity").withColumn("modality", F.lit(m)) for m, p in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def meanings(store: fusion.Store, queries: DataFrame, params: ZParams = ZParams()) -> DataFrame:
    """query_id, chunk_id, file_id, modality, similarity, z of the nearest MOST_K rows of each vector table in searchable roots."""
    rows = cut(_joined(fetched_cosines(store, queries, MOST_K, MOST_K)))  # read for the centres and for the rows
    return meaning_z(rows, _joined(sample_cosines(store, queries)) if params.sample_scale else None)


def term_rows(queries: DataFrame) -> DataFrame:
    """query_id, n_terms, pos, term, prefix: the content words of each query, the last one a prefix."""
    w = queries.select("query_id", query_terms(F.col("query")).alias("t"))
    return w.select("query_id", F.size("t").alias("n_terms"), F.posexplode("t").alias("pos", "term")).withColumn("prefix", F.col("pos") == F.col("n_terms") - 1)


def zfuse(best: DataFrame, covered: DataFrame, queries: DataFrame, params: ZParams = ZParams()) -> DataFrame:
    """query_id, file_id, score of the candidates by z or by coverage; a lookup halves meaning and doubles words."""
    kind = queries.select("query_id", is_lookup(query_terms(F.col("query"))).alias("lookup"))
    rows = best.join(covered, ["query_id", "file_id"], "full").join(kind, "query_id")
    rows = rows.filter((F.col("z") >= params.z_gate) | (F.col("coverage") >= params.coverage_gate))
    share = F.coalesce("coverage", F.lit(0.0))
    if params.words_gated:
        share = F.when(share < params.coverage_gate, 0.0).otherwise(share)
    meaning = F.greatest(F.coalesce("z", F.lit(0.0)), F.lit(0.0)) * F.when(F.col("lookup"), params.z_weight * 0.5).otherwise(params.z_weight)
    words = F.pow(share, 1.5) * F.when(F.col("lookup"), params.word_weight * 2).otherwise(params.word_weight)
    return rows.withColumn("score", meaning + words)


def best_rows(rows: DataFrame) -> DataFrame:
    """Of each file and modality the row with the largest z, the nearest one of equal ones."""
    order = F.struct("z", "similarity", (-F.col("chunk_id")).alias("c"))
    return rows.groupBy("query_id", "file_id", "modality").agg(F.max(order).alias("b")).select("query_id", "file_id", "modality", "b.z", "b.similarity", (-F.col("b.c")).alias("chunk_id"))


def z_search(queries: DataFrame, store: fusion.Store, now_s: int, limit: int = 10, params: ZParams = ZParams(), words: DataFrame | None = None, covered: DataFrame | None = None) -> DataFrame:
    """The answer of each query by z and coverage, with the boosts, match sources and rows of ``fusion.search``; copies are not folded.

    ``words`` and ``covered`` are these queries' keyword list and coverage, if they are there already.

    Rows over the gate give the text and image match sources; others only name the file.
    """
    queries = fusion.asked(queries)
    best = best_rows(meanings(store, queries, params))
    if params.image_floor is not None:
        best = best.filter((F.col("modality") == "text") | (F.col("similarity") >= params.image_floor))
    by_file = best.groupBy("query_id", "file_id").agg(F.max("z").alias("z"))
    covered = coverage(store.keyword, term_rows(queries), store.files, store.roots) if covered is None else covered
    scored = zfuse(by_file, covered, queries, params)
    words = keyword_list(store.keyword, queries, store.files, store.roots) if words is None else words
    kw = words.select("query_id", "file_id", F.col("chunk_id").alias("kw_chunk"), F.lit(True).alias("in_keyword"))
    over = best.filter(F.col("z") >= params.z_gate).groupBy("query_id", "file_id")
    own = over.agg(*[F.max(F.when(F.col("modality") == m, F.col("similarity"))).alias(f"{m}_similarity") for m in ("text", "image")], F.max(F.when(F.col("modality") == "text", F.col("chunk_id"))).alias("tx_chunk"))
    rows = scored.select("query_id", "file_id", F.col("score").alias("rrf")).join(kw, ["query_id", "file_id"], "left").join(own, ["query_id", "file_id"], "left")
    rows = rows.withColumn("in_keyword", F.coalesce("in_keyword", F.lit(False))).withColumn("in_text", F.col("text_similarity").isNotNull()).withColumn("in_image", F.col("image_similarity").isNotNull())
    rows = rows.withColumn("chunk_id", F.coalesce("kw_chunk", "tx_chunk")).drop("kw_chunk", "tx_chunk")
    files = store.files.select("file_id", "root", "file_name", "path", "mtime_ns", "content_hash")
    hits = fusion.boosted(rows, queries, files, now_s).filter(F.col("rank") <= limit).withColumn("copies", F.array().cast("array<string>"))
    return fusion.strong_first(fusion.detailed(hits, store).withColumn("strength", fusion.strength()))


def strong_count(hits: DataFrame, ratio: float) -> DataFrame:
    """query_id, n_strong: leading hits whose score is at least ratio times the best; all, if that is not positive."""
    best = hits.withColumn("best", F.max("score").over(Window.partitionBy("query_id")))
    low = F.min(F.when((F.col("best") > 0) & (F.col("score") < ratio * F.col("best")), F.col("rank")))
    n = best.groupBy("query_id").agg(low.alias("first_low"), F.count(F.lit(1)).alias("n"))
    return n.select("query_id", F.coalesce(F.col("first_low") - 1, F.col("n")).alias("n_strong"))


def blend(hits: DataFrame) -> DataFrame:
    """Scored hits (model not null) re-sorted into the slots they held, by the sum of 1 / (60 + rank) of both orders, ranks from 0."""
    w = Window.partitionBy("query_id")
    scored = hits.filter("model IS NOT NULL")
    scored = scored.withColumn("r0", F.row_number().over(w.orderBy("rank")) - 1).withColumn("m0", F.row_number().over(w.orderBy(F.desc("model"), "rank")) - 1)
    fused = F.round(1 / (60.0 + F.col("r0")) + 1 / (60.0 + F.col("m0")), 12)
    slots = scored.select("query_id", F.col("r0").alias("slot"), F.col("rank").alias("position"))
    moved = scored.withColumn("slot", F.row_number().over(w.orderBy(F.desc(fused), "rank")) - 1).join(slots, ["query_id", "slot"])
    kept = hits.filter("model IS NULL").withColumn("position", F.col("rank"))
    return moved.select("query_id", "file_id", "position").unionByName(kept.select("query_id", "file_id", "position"))


def sweep(hits: DataFrame, grid: list[tuple[float, float]], scales_: DataFrame | None, judged: DataFrame) -> DataFrame:
    """text_z, image_z and tallies for each pair of thresholds: neg, neg_nothing, found, false_weak, pos_nothing.

    ``judged`` has a row for each query: query_id, negative. ``hits`` are labelled anew for each pair of the
    fixed grid (without ``scales_`` thresholds are raw similarities); expected says which hit is the answer.
    Negatives without a strong hit, answers that are called weak, and positives without any strong hit are counted.
    """
    rows = judged.join(hits, "query_id", "left").withColumn("g", F.explode(F.array(*[F.struct(F.lit(a).alias("text_z"), F.lit(b).alias("image_z")) for a, b in grid])))
    if scales_ is None:
        scales_ = judged.select("query_id", F.explode(F.array(F.lit("text"), F.lit("image"))).alias("modality"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("sd"))
    rows = threshold_label(rows, scales_, F.col("g.text_z"), F.col("g.image_z"))
    hit = F.col("file_id").isNotNull()
    first = F.min(F.when(F.col("expected"), F.struct("rank", "label")))
    by = rows.groupBy("g", "query_id", "negative").agg(F.coalesce(F.max(hit & (F.col("label") == "strong")), F.lit(False)).alias("any_strong"), first.alias("answer"))
    out = by.groupBy("g.text_z", "g.image_z").agg(
        F.count_if("negative").alias("neg"), F.count_if(F.col("negative") & ~F.col("any_strong")).alias("neg_nothing"),
        F.count_if(~F.col("negative") & F.col("answer").isNotNull()).alias("found"), F.count_if(~F.col("negative") & (F.col("answer.label") == "weak")).alias("false_weak"),
        F.count_if(~F.col("negative") & ~F.col("any_strong")).alias("pos_nothing"),
    )
    return out


def first_expected(ranked: DataFrame, expected: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """query_id, rank of the best expected file of each query that has one; ignored files take no rank."""
    if ignored is not None:
        ranked = ranked.join(ignored, ["query_id", "file_id"], "left_anti")
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long"))
    return ranked.join(expected, ["query_id", "file_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))


def first_expected_row(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, rank, source of the best expected row, ranks counted anew from 1."""
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long"))
    best = ranked.join(expected, ["query_id", "file_id"]).groupBy("query_id").agg(F.min(F.struct("rank", "source")).alias("b"))
    return best.select("query_id", "b.rank", "b.source")


def repointed(expected: DataFrame, files: DataFrame) -> DataFrame:
    """query_id, file_id: expected files (query_id, file_id) as all files (file_id, content_hash) with the same bytes."""
    hashes = expected.join(files, "file_id").select("query_id", "content_hash").distinct()
    return hashes.join(files, "content_hash").select("query_id", "file_id")


def metrics(ranked: DataFrame, relevant: DataFrame, bucket: Column, ignored: DataFrame | None = None) -> DataFrame:
    """bucket, n, recall_5, recall_10, mrr for each bucket and for all, in one pass; queries without a relevant file don't count."""
    found = first_expected(ranked, relevant, ignored)
    rows = relevant.select("query_id").distinct().join(found, "query_id", "left").withColumn("bucket", bucket)
    hit = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in (5, 10)]
    out = rows.rollup("bucket").agg(F.count(F.lit(1)).alias("n"), *hit, F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
    return out.withColumn("bucket", F.coalesce("bucket", F.lit("all")))


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """bucket, change and verdict between two reports (bucket, mrr)."""
    b = after.select(F.col("bucket").alias("bucket_2"), F.col("mrr").alias("mrr_2"))
    rows = before.join(b, before["bucket"] == b["bucket_2"], "full")
    verdict = F.when(F.col("bucket").isNull(), "new").when(F.col("bucket_2").isNull(), "gone").when(F.col("mrr_2") < F.col("mrr") - EPSILON, "regressed").otherwise("fine")
    return rows.select(F.coalesce("bucket", "bucket_2").alias("bucket"), F.round(F.coalesce("mrr_2", F.lit(0.0)) - F.coalesce("mrr", F.lit(0.0)), 6).alias("change"), verdict.alias("verdict"))


def nearest_ranks(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and for each name the value at place round(share * (n - 1)) of the values in order.

    Values are counted first, so what is put in one order for a group is its different values, not its rows.
    """
    counts = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(by).orderBy(value)
    counts = counts.withColumn("upto", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(Window.partitionBy(by)))
    at = {name: F.floor(F.lit(share) * (F.col("n") - 1) + 0.5) for name, share in shares.items()}
    picks = [F.min(F.when(F.col("upto") > place, F.col(value))).alias(name) for name, place in at.items()]
    return counts.groupBy(by).agg(*picks)

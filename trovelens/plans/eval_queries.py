"""Catalogue: evaluation of searches on labelled queries, with their SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelens.functions.text import tokens
from trovelens.operators import fusion, keyword, rank, substring
from trovelens.plans import search_queries as sq
from trovelens.plans.index_store import index
from trovelens.plans.lineage import cut
from trovelens.sources import tables as t

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Results that an evaluation reads beside the ignored ones; how deep lists are read to explain a miss; tokens that find a passage's candidates.
FETCH, IGNORED, DEPTH, CLUES = 10, 2, 500, 6
LIMIT = FETCH + IGNORED
TEXT_Z, IMAGE_Z = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5), (2.0, 2.5, 3.0, 3.5, 4.0, 5.0)
TEXT_COSINE, IMAGE_COSINE = (0.80, 0.82, 0.84, 0.86, 0.88, 0.90), (0.10, 0.12, 0.14, 0.16)


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def holding(store: fusion.Store, texts: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, file_id of the files whose text (file_id, text) holds a passage (query_id, passage) word for word.

    Candidates have all of a passage's longest inner words, by the keyword index; only their texts are
    read. Passages without an inner word are found by parts of words.
    """
    inner = tokens(F.col("passage"))
    inner = F.array_distinct(F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0))))
    longest = F.slice(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, CLUES)
    clues = passages.select("query_id", longest.alias("c")).select("query_id", F.size("c").alias("n"), F.explode("c.w").alias("term"))
    met = keyword.looked_up(store.keyword, keyword.held(clues)).select("query_id", "n", "term", "file_id").distinct()
    found = met.groupBy("query_id", "n", "file_id").agg(F.count(F.lit(1)).alias("k")).filter("k = n").select("query_id", "file_id")
    bare = passages.join(clues.select("query_id").distinct(), "query_id", "left_anti")
    if not bare.isEmpty():
        found = found.unionByName(substring.containing(store.keyword, substring.vocabulary_grams(store.keyword), texts, bare.select("query_id", F.col("passage").alias("needle"))))
    known = found.join(passages.select("query_id", "passage"), "query_id").join(texts, "file_id")
    return known.filter(F.col("text").contains(F.col("passage"))).select("query_id", "file_id")


class Labelled:
    """The labelled queries of an input: what each expects, what it ignores, and which have no answer."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.store, self.queries = index(spark, sf_dir), fusion.asked(t.search_queries(spark, sf_dir))
        self.expected = cut(holding(self.store, t.files(spark, sf_dir).select("file_id", "text"), self.queries.select("query_id", "passage")))
        own = self.queries.select("query_id", F.explode(F.array("query_id", F.col("query_id") + 1)).alias("file_id"))
        self.ignored = own.join(self.expected, ["query_id", "file_id"], "left_anti")
        positive = self.expected.select("query_id").distinct().withColumn("p", F.lit(True))
        self.judged = self.queries.select("query_id").join(positive, "query_id", "left").select("query_id", F.col("p").isNull().alias("negative"))

    def bucket(self):
        return F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd")

    @cached_property
    def words(self) -> DataFrame:
        """The keyword list, which most modes read."""
        return cut(fusion.lists(self.store, self.queries, "keyword")["keyword"])

    @cached_property
    def covered(self) -> DataFrame:
        return cut(keyword.coverage(self.store.keyword, rank.term_rows(self.queries), self.store.files, self.store.roots))

    def answer(self, mode: str) -> DataFrame:
        if mode in ("z", "z_sample"):
            return rank.z_search(self.queries, self.store, t.NOW_S, LIMIT, sq.Z_GATED if mode == "z" else sq.Z_SAMPLED, self.words, self.covered)
        return fusion.search(self.queries, self.store, t.NOW_S, LIMIT, mode, self.words if "keyword" in fusion.MODES[mode] else None)

    def report(self, mode: str) -> DataFrame:
        return rank.metrics(self.answer(mode).select("query_id", "file_id", "rank"), self.expected, self.bucket(), self.ignored)

    def marked(self, hits: DataFrame) -> DataFrame:
        """``hits`` with expected: whether a hit is what its query looks for."""
        return hits.join(self.expected.withColumn("e", F.lit(True)), ["query_id", "file_id"], "left").withColumn("expected", F.coalesce("e", F.lit(False))).drop("e")


MODES = ["keyword", "vector", "visual", "hybrid", "z", "z_sample"]
LABELS_SQL = """relevant AS MATERIALIZED (SELECT query_id, file_id FROM queries JOIN files ON contains(text, passage)),
ign AS (SELECT query_id, i AS file_id FROM (SELECT query_id, unnest([query_id, query_id + 1]) AS i FROM queries) WHERE NOT EXISTS (SELECT 1 FROM relevant r WHERE r.query_id = queries.query_id AND r.file_id = i))""".replace("queries.query_id AND r.file_id = i", "x.query_id AND r.file_id = x.i").replace("FROM queries) WHERE", "FROM queries) x WHERE").replace("SELECT query_id, i AS", "SELECT x.query_id, x.i AS")
RANKS_SQL = """rk AS (SELECT a.query_id, a.file_id, row_number() OVER (PARTITION BY a.query_id ORDER BY a.rank) AS rank FROM answer a ANTI JOIN ign USING (query_id, file_id)),
best AS (SELECT q.query_id, b.rank FROM (SELECT DISTINCT query_id FROM relevant) q LEFT JOIN (SELECT query_id, min(rank) AS rank FROM rk JOIN relevant USING (query_id, file_id) GROUP BY 1) b USING (query_id))"""
METRICS_SQL = f"""{RANKS_SQL},
metrics AS (SELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS bucket, CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END AS r5, CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END AS r10, coalesce(1.0::DOUBLE / rank, 0) AS rr FROM best),
report AS (SELECT coalesce(bucket, 'all') AS bucket, count(*) AS n, round(avg(r5), 6) AS recall_5, round(avg(r10), 6) AS recall_10, round(avg(rr), 6) AS mrr FROM metrics GROUP BY GROUPING SETS ((bucket), ()))"""
COMMON_SQL = f"WITH {sq.BASE_SQL}, {sq.BM25_SQL}, {LABELS_SQL}"


def mode_sql(mode: str) -> str:
    """The CTEs that give a mode's answer."""
    if mode in ("z", "z_sample"):
        return sq.z_answer_sql(sq.Z_GATED if mode == "z" else sq.Z_SAMPLED, LIMIT)
    return f"{sq.KNN_SQL}, {sq.fuse_sql(' '.join(fusion.MODES[mode]), LIMIT)}"


HYBRID_SQL = f"{COMMON_SQL}, {mode_sql('hybrid')}"


@register("eval_metrics", f"{HYBRID_SQL}, {METRICS_SQL} SELECT * FROM report")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Labelled(spark, sf_dir).report("hybrid")


@register("eval_modes", f"{COMMON_SQL} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, * FROM (WITH {mode_sql(m)}, {METRICS_SQL} SELECT * FROM report)" for m in MODES))
def eval_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = Labelled(spark, sf_dir)
    parts = [labelled.report(m).select(F.lit(m).alias("mode"), "*") for m in MODES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("eval_diff", f"""{HYBRID_SQL}, {METRICS_SQL}, other AS (SELECT bucket, mrr - CASE bucket WHEN 'odd' THEN 0.01 ELSE 0 END AS mrr FROM report WHERE bucket <> 'even')
SELECT coalesce(a.bucket, b.bucket) AS bucket, round(coalesce(b.mrr, 0) - coalesce(a.mrr, 0), 6) AS change, CASE WHEN a.bucket IS NULL THEN 'new' WHEN b.bucket IS NULL THEN 'gone' WHEN b.mrr < a.mrr - 0.0005 THEN 'regressed' ELSE 'fine' END AS verdict
FROM report a FULL JOIN other b ON a.bucket = b.bucket""")
def eval_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = cut(Labelled(spark, sf_dir).report("hybrid"))
    other = report.filter("bucket <> 'even'").select("bucket", (F.col("mrr") - F.when(F.col("bucket") == "odd", 0.01).otherwise(0.0)).alias("mrr"))
    return rank.regressions(report.select("bucket", "mrr"), other)


_DEEP = {
    "keyword": "SELECT query_id, file_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY r) AS nth FROM kw0 WHERE r <= 2500) WHERE nth = 1 QUALIFY rank <= 500",
    "text": "SELECT query_id, file_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY r) AS nth FROM txf) WHERE nth = 1 QUALIFY rank <= 500",
    "image": "SELECT query_id, file_id, NULL AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM imf WHERE similarity >= 0.10",
}


def _deep_sql(name: str) -> str:
    """CTEs that end in d_name: the best expected row of a list read deep, ignored ones taken out."""
    return f"""a_{name} AS ({_DEEP[name]}), b_{name} AS (SELECT d.query_id, d.file_id, c.source, row_number() OVER (PARTITION BY d.query_id ORDER BY d.rank) AS place
  FROM a_{name} d LEFT JOIN chunks c USING (chunk_id) ANTI JOIN ign ON ign.query_id = d.query_id AND ign.file_id = d.file_id),
d_{name} AS (SELECT query_id, min(place) AS place, min_by(source, place) AS source FROM b_{name} JOIN relevant USING (query_id, file_id) GROUP BY 1)"""


@register("miss_diagnosis", f"""{HYBRID_SQL}, {RANKS_SQL}, miss AS (SELECT * FROM best WHERE rank IS NULL OR rank > 5),
deep AS (SELECT * FROM (WITH {sq.knn_sql(2500, 500)}, {_deep_sql('keyword')}, {_deep_sql('text')}, {_deep_sql('image')}
  SELECT m.query_id, m.rank, k.place AS keyword_rank, k.source AS keyword_source, x.place AS text_rank, x.source AS text_source, i.place AS image_rank
  FROM miss m LEFT JOIN d_keyword k USING (query_id) LEFT JOIN d_text x USING (query_id) LEFT JOIN d_image i USING (query_id))) SELECT * FROM deep""")
def miss_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query whose expected file is not among the first five, where each list has it, read DEPTH deep."""
    labelled = Labelled(spark, sf_dir)
    found = rank.first_expected(labelled.answer("hybrid").select("query_id", "file_id", "rank"), labelled.expected, labelled.ignored)
    missed = cut(labelled.expected.select("query_id").distinct().join(found, "query_id", "left").filter("rank IS NULL OR rank > 5"))
    asked = labelled.queries.join(missed.select("query_id"), "query_id", "left_semi")
    out = missed
    for name, deep in fusion.lists(labelled.store, asked, depth=DEPTH).items():
        own = deep.select("query_id", "file_id", "rank", F.col("chunk_id") if name != "image" else F.lit(None).cast("long").alias("chunk_id"))
        own = own.join(labelled.ignored, ["query_id", "file_id"], "left_anti").join(labelled.store.chunks.select("chunk_id", "source"), "chunk_id", "left")
        own = rank.first_expected_row(own, labelled.expected)
        columns = [F.col("rank").alias(f"{name}_rank")] + ([F.col("source").alias(f"{name}_source")] if name != "image" else [])
        out = out.join(own.select("query_id", *columns), "query_id", "left")
    return out


_GRIDS = {"sample": (TEXT_Z, IMAGE_Z), "fetched": (TEXT_Z, IMAGE_Z), "cosine": (TEXT_COSINE, IMAGE_COSINE)}


def _sweep_sql(name: str) -> str:
    text, image = _GRIDS[name]
    scales = {"sample": f"WITH {sq.SAMPLE_SQL} {sq.SCALE_SQL}", "fetched": f"WITH {sq.FETCHED_SQL} {sq.SCALE_SQL}", "cosine": "SELECT query_id, unnest(['text', 'image']) AS modality, 1 AS n, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS sd FROM queries"}[name]
    one = lambda m: f"CASE WHEN {m}.mean IS NULL THEN {m}_similarity IS NOT NULL ELSE coalesce(({m}_similarity - {m}.mean) / {m}.sd >= {m}_z, false) END"
    return f"""SELECT '{name}' AS scale, * FROM (WITH sc AS ({scales}), g AS (SELECT * FROM (SELECT unnest({list(text)})::DOUBLE AS text_z), (SELECT unnest({list(image)})::DOUBLE AS image_z)),
l AS (SELECT q.query_id, g.text_z, g.image_z, a.rank, r.file_id IS NOT NULL AS expected, a.file_id IS NOT NULL AND (in_keyword OR {one("text")} OR {one("image")}) AS strong
  FROM queries q CROSS JOIN g LEFT JOIN answer a ON a.query_id = q.query_id LEFT JOIN relevant r ON r.query_id = a.query_id AND r.file_id = a.file_id
  LEFT JOIN sc text ON text.query_id = q.query_id AND text.modality = 'text' LEFT JOIN sc image ON image.query_id = q.query_id AND image.modality = 'image'),
b AS (SELECT query_id, text_z, image_z, query_id NOT IN (SELECT query_id FROM relevant) AS negative, bool_or(strong) AS any_strong, min_by(strong, rank) FILTER (WHERE expected) AS answer FROM l GROUP BY query_id, text_z, image_z)
SELECT text_z, image_z, count(*) FILTER (WHERE negative) AS neg, count(*) FILTER (WHERE negative AND NOT any_strong) AS neg_nothing, count(*) FILTER (WHERE NOT negative AND answer IS NOT NULL) AS found,
  count(*) FILTER (WHERE NOT negative AND answer = false) AS false_weak, count(*) FILTER (WHERE NOT negative AND NOT any_strong) AS pos_nothing FROM b GROUP BY ALL)"""


@register("strength_sweep", f"{HYBRID_SQL} " + " UNION ALL ".join(_sweep_sql(n) for n in _GRIDS))
def strength_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What thresholds on the scales of a sample and of the fetched rows, and on bare similarities, call weak."""
    labelled = Labelled(spark, sf_dir)
    hits = cut(labelled.marked(labelled.answer("hybrid")).select("query_id", "file_id", "rank", "in_keyword", "text_similarity", "image_similarity", "expected"))
    made = {"sample": rank.scales(rank.sample_cosines(labelled.store, labelled.queries)), "fetched": rank.scales(rank.fetched_cosines(labelled.store, labelled.queries)), "cosine": None}
    parts = [rank.sweep(hits, [(a, b) for a in text for b in image], made[n], labelled.judged).select(F.lit(n).alias("scale"), "*") for n, (text, image) in _GRIDS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_JUDGED_SQL = "jd AS (SELECT query_id, query_id NOT IN (SELECT query_id FROM relevant) AS negative FROM queries), ex AS (SELECT a.query_id, min_by(strength, rank) AS strength, min(rank) AS rank FROM answer a JOIN relevant USING (query_id, file_id) GROUP BY 1)"


@register("fold_tally", f"""{HYBRID_SQL}, {_JUDGED_SQL}, pq AS (SELECT j.query_id, negative, count(a.file_id) AS results, count(a.file_id) FILTER (WHERE a.strength = 'weak') AS weak FROM jd j LEFT JOIN answer a USING (query_id) GROUP BY ALL)
SELECT negative, count(*) AS queries, CAST(sum(results) AS BIGINT) AS results, CAST(sum(weak) AS BIGINT) AS weak, count(*) FILTER (WHERE weak = results) AS all_weak, count(e.query_id) AS found, count(*) FILTER (WHERE e.strength = 'weak') AS answer_folded
FROM pq LEFT JOIN ex e USING (query_id) GROUP BY 1""")
def fold_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fold does to queries with an answer and without one."""
    labelled = Labelled(spark, sf_dir)
    hits = labelled.marked(labelled.answer("hybrid"))
    by = labelled.judged.join(hits, "query_id", "left").groupBy("query_id", "negative").agg(
        F.count("file_id").alias("results"), F.count_if(F.col("strength") == "weak").alias("weak"), F.min(F.when(F.col("expected"), F.struct("rank", "strength"))).alias("e")
    )
    return by.groupBy("negative").agg(
        F.count(F.lit(1)).alias("queries"), F.sum("results").alias("results"), F.sum("weak").alias("weak"), F.count_if(F.col("weak") == F.col("results")).alias("all_weak"),
        F.count("e").alias("found"), F.count_if(F.col("e.strength") == "weak").alias("answer_folded"),
    )


@register("fold_stats", f"""{HYBRID_SQL}, {RANKS_SQL}, {_JUDGED_SQL}, m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM answer), lo AS (SELECT query_id, min(rank) FILTER (WHERE top > 0 AND score < 0.5 * top) AS first_low, count(*) AS n FROM m GROUP BY 1),
s AS (SELECT j.query_id, coalesce(n, 0) AS n, coalesce(first_low - 1, n, 0) AS strong, best.rank FROM jd j LEFT JOIN lo USING (query_id) LEFT JOIN best USING (query_id) WHERE NOT negative)
SELECT count(*) AS queries, CAST(sum(n) AS BIGINT) AS results, count(*) FILTER (WHERE n = 0) AS empty, CAST(sum(n - strong) AS BIGINT) AS folded, count(*) FILTER (WHERE rank > strong) AS answer_folded FROM s""")
def fold_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long lists are, and what folding all under half the best score would hide."""
    labelled = Labelled(spark, sf_dir)
    hits = cut(labelled.answer("hybrid").select("query_id", "file_id", "rank", "score"))
    strong = rank.strong_count(hits, 0.5).join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id")
    found = rank.first_expected(hits.select("query_id", "file_id", "rank"), labelled.expected, labelled.ignored)
    rows = labelled.judged.filter("NOT negative").join(strong, "query_id", "left").join(found, "query_id", "left").na.fill(0, ["n", "n_strong"])
    return rows.agg(
        F.count(F.lit(1)).alias("queries"), F.sum("n").alias("results"), F.count_if(F.col("n") == 0).alias("empty"), F.sum(F.col("n") - F.col("n_strong")).alias("folded"), F.count_if(F.col("rank") > F.col("n_strong")).alias("answer_folded")
    )


@register("negative_detail", f"""{HYBRID_SQL}, {sq.SAMPLE_SQL}, sc AS ({sq.SCALE_SQL}), neg AS (SELECT query_id FROM queries WHERE query_id NOT IN (SELECT query_id FROM relevant))
SELECT n.query_id, round(max((text_similarity - x.mean) / x.sd), 5) AS text_z, round(max((image_similarity - y.mean) / y.sd), 5) AS image_z, coalesce(bool_or(in_keyword), false) AS by_keyword
FROM neg n LEFT JOIN answer a USING (query_id) LEFT JOIN sc x ON x.query_id = n.query_id AND x.modality = 'text' LEFT JOIN sc y ON y.query_id = n.query_id AND y.modality = 'image' GROUP BY 1""")
def negative_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query without an answer, how far its best results stand out and whether keywords found any."""
    labelled = Labelled(spark, sf_dir)
    wide = rank.scales(rank.sample_cosines(labelled.store, labelled.queries)).groupBy("query_id").agg(*[F.max(F.when(F.col("modality") == m, F.col(c))).alias(f"{m}_{c}") for m in ("text", "image") for c in ("mean", "sd")])
    rows = labelled.judged.filter("negative").join(labelled.answer("hybrid"), "query_id", "left").join(wide, "query_id", "left")
    z = [F.round(F.max((F.col(f"{m}_similarity") - F.col(f"{m}_mean")) / F.col(f"{m}_sd")), 5).alias(f"{m}_z") for m in ("text", "image")]
    return rows.groupBy("query_id").agg(*z, F.coalesce(F.max("in_keyword"), F.lit(False)).alias("by_keyword"))


@register("eval_repointed", f"""WITH {t.FILES_SQL}, b AS (SELECT item_id AS query_id, text AS passage FROM benchmark WHERE item_id % 11 <> 10),
e AS (SELECT query_id, file_id, content_hash FROM b JOIN files ON contains(files.text, passage)), c AS (SELECT DISTINCT query_id, f.file_id FROM e JOIN files f USING (content_hash))
SELECT b.query_id, count(c.file_id) AS n_expected, min(c.file_id) AS first_id, CASE WHEN count(c.file_id) = 0 THEN 'negative' ELSE 'positive' END AS kind FROM b LEFT JOIN c USING (query_id) GROUP BY 1""")
def eval_repointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected files as all files with the same bytes; queries to be skipped (every eleventh) are left out."""
    store = index(spark, sf_dir)
    q = t.read(spark, sf_dir, "benchmark").filter("item_id % 11 <> 10").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    expected = holding(store, t.files(spark, sf_dir).select("file_id", "text"), q)
    copies = rank.repointed(expected, store.files.select("file_id", "content_hash"))
    by = q.select("query_id").join(copies, "query_id", "left").groupBy("query_id").agg(F.count("file_id").alias("n_expected"), F.min("file_id").alias("first_id"))
    return by.withColumn("kind", F.when(F.col("n_expected") == 0, "negative").otherwise("positive"))

"""Catalogue: retrieval, fusion and ranking queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelens.functions.text import STOP_WORDS, is_opaque_name, tokens
from trovelens.operators import fusion, keyword, presentation, rank, substring, vector
from trovelens.plans.index_store import index
from trovelens.sources import tables as t

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# SQL parts that several statements share.
TOKENS_SQL = rf"""toks AS (SELECT chunk_id, file_id, regexp_extract_all(lower(strip_accents(text)), '[\p{{L}}\p{{N}}]+') AS tk FROM chunks),
sizes AS (SELECT chunk_id, len(tk) AS n_tokens FROM toks),
occ0 AS (SELECT chunk_id, file_id, unnest(tk) AS term, generate_subscripts(tk, 1) - 1 AS pos FROM toks),
words AS (SELECT DISTINCT term FROM occ0)"""
BASE_SQL = f"{t.FILES_SQL}, {t.ROOTS_SQL}, {t.CHUNKS_SQL}, {TOKENS_SQL}, {t.QUERIES_SQL}"
BM25_SQL = r"""qw AS (SELECT query_id, list_filter(list_transform(list_filter(regexp_split_to_array(query, '\s+'), lambda w: w <> ''),
  lambda w, i: {'t': regexp_extract_all(lower(strip_accents(w)), '[\p{L}\p{N}]+'), 'i': i}), lambda x: len(x.t) > 0) AS p, len(list_filter(regexp_split_to_array(query, '\s+'), lambda w: w <> '')) AS n FROM queries),
qx AS (SELECT query_id, n, len(p) AS n_terms, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS pos FROM qw),
qt AS (SELECT query_id, n_terms, pos, len(x.t) AS m, unnest(x.t) AS term, generate_subscripts(x.t, 1) - 1 AS place, x.i = n AND generate_subscripts(x.t, 1) = len(x.t) AS prefix FROM qx),
qe AS (SELECT qt.* REPLACE (w.term AS term) FROM qt JOIN words w ON w.term = qt.term OR (prefix AND starts_with(w.term, qt.term))),
st0 AS (SELECT DISTINCT query_id, n_terms, qe.pos, m, place, chunk_id, file_id, o.pos - place AS start FROM qe JOIN occ0 o ON o.term = qe.term),
ph AS (SELECT query_id, n_terms, pos, chunk_id, file_id, start FROM st0 GROUP BY query_id, n_terms, pos, m, chunk_id, file_id, start HAVING count(*) = m),
hit AS (SELECT query_id, n_terms, pos, chunk_id, file_id, count(*) AS tf FROM ph GROUP BY ALL),
df AS (SELECT query_id, pos, count(*) AS df FROM hit GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(n_tokens) AS average FROM sizes),
bm AS (SELECT query_id, n_terms, chunk_id, file_id, count(*) AS k,
  sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / average))) AS score
  FROM hit JOIN df USING (query_id, pos) JOIN sizes USING (chunk_id), st GROUP BY query_id, n_terms, chunk_id, file_id),
bm25 AS (SELECT query_id, chunk_id, file_id, round(score, 9) AS score FROM bm WHERE k = n_terms),
kw0 AS (SELECT b.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM bm25 b JOIN files USING (file_id) JOIN roots USING (root) WHERE enabled AND status <> 'missing'),
kw1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY r) AS nth FROM kw0 WHERE r <= 500),
kw AS (SELECT query_id, file_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM kw1 WHERE nth = 1 QUALIFY rank <= 100)"""
_SIM = "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9)"
_IS_OPAQUE = r"""NOT list_bool_or(list_concat([false], list_transform(regexp_extract_all(lower(regexp_replace(file_name, '^(.+)\.[^.]*$', '\1')), '\p{L}+'),
  lambda w: (length(w) >= 3 OR NOT regexp_full_match(w, '[\x00-\x7f]*')) AND NOT (regexp_matches(lower(regexp_replace(file_name, '^(.+)\.[^.]*$', '\1')), '[0-9]') AND regexp_full_match(w, '[0-9a-f]+'))
  AND NOT list_contains(['img', 'dsc', 'dscn', 'dscf', 'pxl', 'pict', 'mvimg', 'vid'], w))))"""
_LIVE = "enabled AND status <> 'missing'"


def knn_sql(text: int = 500, image: int = 50) -> str:
    """Similarities of the nearest text chunks and images in searchable roots (txf, imf), and the two lists (tx, im)."""
    return f"""{t.VECTORS_SQL},
tx0 AS (SELECT query_id, chunk_id, file_id, {_SIM} AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY {_SIM} DESC, chunk_id) AS r FROM vecs e, queries q),
txf AS (SELECT x.query_id, x.file_id, x.chunk_id, similarity, r FROM tx0 x JOIN files f ON f.file_id = x.file_id JOIN roots USING (root) JOIN chunks c ON c.chunk_id = x.chunk_id
  WHERE r <= {text} AND {_LIVE} AND NOT (c.source = 'filename' AND {_IS_OPAQUE})),
tx1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY r) AS nth FROM txf),
tx AS (SELECT query_id, file_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM tx1 WHERE nth = 1 QUALIFY rank <= 100),
im0 AS (SELECT query_id, chunk_id, file_id, {_SIM} AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY {_SIM} DESC, file_id) AS r FROM imgs e, queries q),
imf AS (SELECT query_id, file_id, i.chunk_id, similarity, r FROM im0 i JOIN files USING (file_id) JOIN roots USING (root) WHERE r <= {image} AND {_LIVE}),
im AS (SELECT query_id, file_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM imf WHERE similarity >= 0.10)"""


KNN_SQL = knn_sql()
_WORDS = r"regexp_extract_all(lower(regexp_replace(strip_accents({0}), '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g')), '[\p{{L}}\p{{N}}]+')"
_NAME_BOOST = f"""CASE WHEN len({_WORDS.format('query')}) = 0 THEN 1.0 ELSE 1 + 0.2 * len(list_filter({_WORDS.format('query')}, lambda w: list_contains({_WORDS.format('file_name')}, w))) / len({_WORDS.format('query')}) END"""
_RECENCY = f"(1 + 0.1 * greatest(0.0, 1 - greatest({t.NOW_S} - mtime_ns // 1000000000, 0) / 86400.0 / 30))"


def fuse_sql(modes: str = "keyword text image", limit: int = 10) -> str:
    """The answer (answer) of the lists that are named: fused, boosted, copies folded, with sources of matches and strength."""
    rows = {
        "keyword": "SELECT query_id, file_id, 'keyword' AS list, rank, 1.0 AS w, NULL::DOUBLE AS similarity, chunk_id FROM kw",
        "text": "SELECT query_id, file_id, 'text' AS list, rank, 1.0 AS w, similarity, chunk_id FROM tx",
        "image": "SELECT query_id, file_id, 'image' AS list, rank, 1.1 AS w, similarity, NULL AS chunk_id FROM im",
    }
    return f"""every AS ({" UNION ALL ".join(rows[m] for m in modes.split())}),
fused AS (SELECT query_id, file_id, sum(w / (60 + rank)) AS rrf, max(similarity) FILTER (WHERE list = 'text') AS text_similarity,
  max(similarity) FILTER (WHERE list = 'image') AS image_similarity, bool_or(list = 'keyword') AS in_keyword, bool_or(list = 'text') AS in_text, bool_or(list = 'image') AS in_image,
  coalesce(max(chunk_id) FILTER (WHERE list = 'keyword'), max(chunk_id) FILTER (WHERE list = 'text')) AS chunk_id FROM every GROUP BY ALL),
{answer_sql(limit)}"""


def answer_sql(limit: int = 10, fold: bool = True) -> str:
    folded = f"""cp AS (SELECT *, row_number() OVER w AS nth, coalesce(list(path) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), []) AS copies FROM ranked WHERE rank <= {2 * limit}
  WINDOW w AS (PARTITION BY query_id, content_hash ORDER BY rank)),
top AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank) FROM cp WHERE nth = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {limit}),"""
    plain = f"top AS (SELECT *, []::VARCHAR[] AS copies FROM ranked WHERE rank <= {limit}),"
    return f"""boosted AS (SELECT f.*, path, file_name, mtime_ns, content_hash, round(rrf * {_NAME_BOOST} * {_RECENCY}, 9) AS score FROM fused f JOIN queries USING (query_id) JOIN files USING (file_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, round(rrf, 9) DESC, file_id) AS rank FROM boosted),
{folded if fold else plain}
answer AS (SELECT top.*, c.source, c.page, c.text AS chunk_text, CASE WHEN NOT in_keyword AND image_similarity IS NULL AND text_similarity < 0.80 THEN 'weak' ELSE 'strong' END AS strength,
  list_filter([CASE WHEN in_keyword THEN 'keyword' END, CASE WHEN in_text THEN 'semantic' END, CASE WHEN in_image THEN 'visual' END,
    CASE WHEN c.source IN ('ocr', 'qr') THEN c.source END, CASE WHEN c.source = 'filename' AND in_keyword THEN 'filename' END], lambda x: x IS NOT NULL) AS match_sources
  FROM top LEFT JOIN chunks c ON c.chunk_id = top.chunk_id)"""


FUSE_SQL = fuse_sql()
ALL_SQL = f"WITH {BASE_SQL}, {BM25_SQL}, {KNN_SQL}, {FUSE_SQL}"


def _ask(spark: SparkSession, sf_dir: str, words: bool = True) -> tuple:
    return index(spark, sf_dir, words), fusion.asked(t.search_queries(spark, sf_dir))


def _keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, q = _ask(spark, sf_dir)
    return fusion.lists(store, q, "keyword")["keyword"]


@register("kw_bm25_topk", f"WITH {BASE_SQL}, {BM25_SQL} SELECT query_id, file_id, chunk_id, score, rank FROM kw")
def kw_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir).select("query_id", "file_id", "chunk_id", "score", "rank")


@register("kw_prefix", f"WITH {BASE_SQL}, {BM25_SQL} SELECT query_id, pos AS word, count(*) AS n_chunks, CAST(sum(tf) AS BIGINT) AS n_occurrences FROM hit GROUP BY ALL")
def kw_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, q = _ask(spark, sf_dir)
    return keyword.occurrences(store.keyword, q).groupBy("query_id", F.col("word").cast("long").alias("word")).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("tf").alias("n_occurrences"))


@register("kw_phrase", f"WITH {BASE_SQL} SELECT a.chunk_id, count(*) AS n FROM occ0 a JOIN occ0 b ON a.chunk_id = b.chunk_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1")
def kw_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.phrase_chunks(index(spark, sf_dir).keyword, "of the")


@register("substring_lookup", f"WITH {t.FILES_SQL} SELECT item_id AS query_id, file_id FROM benchmark b JOIN files f ON contains(f.text, substr(b.text, 4, 16))")
def substring_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a piece of each benchmark passage, cut without regard to words, stands letter by letter."""
    ix = index(spark, sf_dir).keyword
    needles = t.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 4, 16).alias("needle"))
    return substring.containing(ix, substring.vocabulary_grams(ix), t.files(spark, sf_dir).select("file_id", "text"), needles)


@register("kw_files_dedup", f"WITH {BASE_SQL}, {BM25_SQL} SELECT query_id, count(*) AS n_files, max(rank) AS last_rank FROM kw GROUP BY 1")
def kw_files_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_files"), F.max("rank").alias("last_rank"))


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
TERMS_SQL = rf"""z0 AS (SELECT query_id, list_filter(regexp_extract_all(lower(strip_accents(query)), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 2 AND NOT list_contains([{_STOPS}], w)) AS a FROM queries),
z1 AS (SELECT query_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS tk FROM z0),
zt AS (SELECT query_id, len(tk) AS n_terms, unnest(tk) AS term, generate_subscripts(tk, 1) - 1 AS pos FROM z1),
ze AS (SELECT query_id, n_terms, pos, w.term FROM zt JOIN words w ON w.term = zt.term OR (pos = n_terms - 1 AND starts_with(w.term, zt.term))),
zf AS (SELECT DISTINCT query_id, n_terms, ze.pos, file_id FROM ze JOIN occ0 USING (term) JOIN files USING (file_id) JOIN roots USING (root) WHERE {_LIVE}),
cov AS (SELECT query_id, file_id, sum(1.0::DOUBLE / n_terms) AS coverage FROM zf GROUP BY ALL)"""


@register("term_coverage", f"WITH {BASE_SQL}, {TERMS_SQL} SELECT query_id, file_id, round(coverage, 6) AS coverage FROM cov")
def term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, q = _ask(spark, sf_dir)
    return keyword.coverage(store.keyword, rank.term_rows(q), store.files, store.roots).select("query_id", "file_id", F.round("coverage", 6).alias("coverage"))


@register("knn_text", f"WITH {BASE_SQL}, {KNN_SQL} SELECT query_id, chunk_id, file_id, similarity FROM tx0 WHERE r <= 50")
def knn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, q = _ask(spark, sf_dir)
    return vector.knn(store.text_vectors, q, 50).select("query_id", "chunk_id", "file_id", "similarity")


@register("knn_text_post_filter", f"WITH {BASE_SQL}, {KNN_SQL} SELECT query_id, file_id, similarity, rank FROM tx")
def knn_text_post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, q = _ask(spark, sf_dir)
    return fusion.text_list(store, q).select("query_id", "file_id", "similarity", "rank")


@register("knn_image_floor", f"WITH {BASE_SQL}, {KNN_SQL} SELECT query_id, file_id, similarity, rank FROM im")
def knn_image_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, q = _ask(spark, sf_dir)
    return fusion.image_list(store, q).select("query_id", "file_id", "similarity", "rank")


def _sampled_sql(table: str) -> str:
    step = f"(SELECT greatest(1, max(file_id) // {rank.SAMPLE}) FROM {table})"
    return f"SELECT query_id, file_id, {_SIM} AS similarity FROM {table} e, queries q WHERE file_id % {step} = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY file_id) <= {2 * rank.SAMPLE}"


SAMPLE_SQL = f"sm AS (SELECT *, 'text' AS modality FROM ({_sampled_sql('vecs')}) UNION ALL SELECT *, 'image' FROM ({_sampled_sql('imgs')}))"
FETCHED_SQL = f"{knn_sql(100, 50)}, sm AS (SELECT query_id, file_id, similarity, 'text' AS modality FROM txf UNION ALL SELECT query_id, file_id, similarity, 'image' FROM imf)"
SCALE_SQL = "SELECT query_id, modality, count(*) AS n, CASE WHEN count(*) >= 20 THEN avg(similarity) END AS mean, CASE WHEN count(*) >= 20 THEN greatest(stddev_pop(similarity), 0.02) END AS sd FROM sm GROUP BY ALL"
_ROUNDED = "query_id, modality, n, round(mean, 6) AS mean, round(sd, 6) AS sd"


@register("cosine_sample", f"WITH {BASE_SQL}, {t.VECTORS_SQL}, {SAMPLE_SQL} SELECT query_id, modality, file_id, similarity FROM sm")
def cosine_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, q = _ask(spark, sf_dir)
    found = rank.sample_cosines(store, q)
    return found["text"].withColumn("modality", F.lit("text")).unionByName(found["image"].withColumn("modality", F.lit("image"))).select("query_id", "modality", "file_id", "similarity")


def _rounded(s: DataFrame) -> DataFrame:
    return s.select("query_id", "modality", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@register("scale_stats", f"WITH {BASE_SQL}, {t.VECTORS_SQL}, {SAMPLE_SQL} SELECT {_ROUNDED} FROM ({SCALE_SQL})")
def scale_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, q = _ask(spark, sf_dir)
    return _rounded(rank.scales(rank.sample_cosines(store, q)))


@register("scale_fetched", f"WITH {BASE_SQL}, {FETCHED_SQL} SELECT {_ROUNDED} FROM ({SCALE_SQL})")
def scale_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, q = _ask(spark, sf_dir)
    return _rounded(rank.scales(rank.fetched_cosines(store, q)))


@register("rrf_fuse", f"{ALL_SQL} SELECT query_id, file_id, round(rrf, 6) AS rrf FROM fused")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, q = _ask(spark, sf_dir)
    return fusion.fuse(fusion.lists(store, q)).select("query_id", "file_id", F.round("rrf", 6).alias("rrf"))


def _answer(spark: SparkSession, sf_dir: str, mode: str = "hybrid") -> DataFrame:
    store, q = _ask(spark, sf_dir, "keyword" in fusion.MODES[mode])
    return fusion.search(q, store, t.NOW_S, mode=mode)


_SHOWN = "query_id, file_id, path, score, rank, strength, array_to_string(match_sources, ',') AS match_sources, page, len(copies) AS n_copies"


def _shown(a: DataFrame) -> DataFrame:
    return a.select("query_id", "file_id", "path", "score", "rank", "strength", F.array_join("match_sources", ",").alias("match_sources"), "page", F.size("copies").cast("long").alias("n_copies"))


@register("hybrid_search", f"{ALL_SQL} SELECT {_SHOWN} FROM answer")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_answer(spark, sf_dir))


def _mode(name: str, lists: str) -> None:
    @register(f"search_{name}", f"WITH {BASE_SQL}, {BM25_SQL}, {KNN_SQL}, {fuse_sql(lists)} SELECT {_SHOWN} FROM answer")
    def search(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(_answer(spark, sf_dir, name))


for _name in ("keyword", "vector", "visual"):
    _mode(_name, " ".join(fusion.MODES[_name]))


@register("blank_queries", "SELECT 0::BIGINT AS n")
def blank_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, q = _ask(spark, sf_dir)
    blank = fusion.search(q.withColumn("query", F.lit(" \t")), store, t.NOW_S).select("file_id")
    return blank.unionByName(fusion.search(q, store, t.NOW_S, limit=0).select("file_id")).agg(F.count(F.lit(1)).alias("n"))


@register("hit_rows", f"""{ALL_SQL} SELECT query_id, file_id, file_name, mtime_ns // 1000000 AS mtime_ms, page, text_similarity, image_similarity,
  CASE WHEN NOT in_keyword THEN replace(replace(coalesce(substr(chunk_text, 1, 200), file_name), chr(10), ' '), chr(13), ' ') END AS plain_snippet,
  CASE WHEN list_contains(match_sources, 'ocr') THEN 'ocr' WHEN list_contains(match_sources, 'qr') THEN 'qr' WHEN list_contains(match_sources, 'visual') THEN 'visual' WHEN match_sources = ['semantic'] THEN 'semantic' END AS hidden_reason FROM answer""")
def hit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = presentation.rows(_answer(spark, sf_dir), t.search_queries(spark, sf_dir))
    return rows.select("query_id", "file_id", "file_name", "mtime_ms", "page", "text_similarity", "image_similarity", F.when(~F.col("in_keyword"), F.col("snippet")).alias("plain_snippet"), "hidden_reason")


@register("marked_snippets")
def marked_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snippets of keyword hits: the text and the byte ranges of the words found. SQL has no such windows; the rule is tested case by case."""
    rows = presentation.rows(_answer(spark, sf_dir), t.search_queries(spark, sf_dir)).filter("in_keyword")
    return rows.select("query_id", "file_id", "snippet", "highlights")


@register("copies_collapse", f"{ALL_SQL} SELECT query_id, file_id, rank, array_to_string(copies, ',') AS copies FROM answer")
def copies_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir).select("query_id", "file_id", "rank", F.array_join("copies", ",").alias("copies"))


@register("fold_strong_first", f"{ALL_SQL} SELECT query_id, file_id, strength, row_number() OVER (PARTITION BY query_id ORDER BY strength = 'weak', rank) AS position FROM answer")
def fold_strong_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir).select("query_id", "file_id", "strength", "position")


@register("match_sources", f"{ALL_SQL} SELECT match_sources, count(*) AS n FROM (SELECT array_to_string(match_sources, ',') AS match_sources FROM answer) GROUP BY 1")
def match_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir).groupBy(F.array_join("match_sources", ",").alias("match_sources")).agg(F.count(F.lit(1)).alias("n"))


@register("filename_boost", f"{ALL_SQL} SELECT query_id, file_id, round({_NAME_BOOST}, 6) AS boost FROM fused JOIN queries USING (query_id) JOIN files USING (file_id)")
def filename_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, q = _ask(spark, sf_dir)
    found = keyword.held(fusion.fuse(fusion.lists(store, q)), keyword.HELD_HITS)  # so that files are read where they are
    rows = store.files.select("file_id", "file_name").join(found, "file_id").join(q.select("query_id", "query"), "query_id")
    return rows.select("query_id", "file_id", F.round(fusion.filename_boost(F.col("query"), F.col("file_name")), 6).alias("boost"))


@register("recency_boost", f"WITH {t.FILES_SQL} SELECT file_id, round({_RECENCY}, 6) AS boost FROM files")
def recency_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.files(spark, sf_dir).select("file_id", F.round(fusion.recency_boost(F.col("mtime_ns"), t.NOW_S), 6).alias("boost"))


@register("opaque_names", f"WITH names AS (SELECT file_id, unnest([file_name, 'IMG_' || file_id || '.jpg', substr(content_hash, 1, 12) || '.pdf', file_id || '.png', 'Scan' || file_id || '.pdf']) AS file_name FROM (WITH {t.FILES_SQL} SELECT * FROM files)) SELECT file_id, file_name, {_IS_OPAQUE} AS opaque FROM names")
def opaque_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = t.files(spark, sf_dir)
    i = F.col("file_id").cast("string")
    names = F.array("file_name", F.concat(F.lit("IMG_"), i, F.lit(".jpg")), F.concat(F.substring("content_hash", 1, 12), F.lit(".pdf")), F.concat(i, F.lit(".png")), F.concat(F.lit("Scan"), i, F.lit(".pdf")))
    return f.select("file_id", F.explode(names).alias("file_name")).withColumn("opaque", is_opaque_name(F.col("file_name")))


_NEAR_SQL = f"{knn_sql(4096, 4096)}, near AS (SELECT query_id, file_id, chunk_id, 'text' AS modality, similarity AS c FROM txf UNION ALL SELECT query_id, file_id, chunk_id, 'image', similarity FROM imf)"


def z_sql(reference: str) -> str:
    """z of the rows of near: centred and scaled by the reference rows (query_id, modality, c)."""
    return f"""ref AS ({reference}),
al AS (SELECT query_id, avg(c) AS every FROM ref GROUP BY 1),
mo AS (SELECT query_id, modality, CASE WHEN count(*) >= 20 THEN avg(c) END AS own FROM ref GROUP BY ALL),
rc AS (SELECT ref.query_id, c - coalesce(own, every) AS d FROM ref JOIN al USING (query_id) JOIN mo USING (query_id, modality)),
mv AS (SELECT query_id, avg(d) AS mean, greatest(sqrt(greatest(avg(d * d) - avg(d) * avg(d), 0)), 0.02) AS sd FROM rc GROUP BY 1),
z AS (SELECT near.*, coalesce((c - coalesce(own, every) - mean) / sd, 0) AS z FROM near LEFT JOIN al USING (query_id) LEFT JOIN mo USING (query_id, modality) LEFT JOIN mv USING (query_id)),
zn AS (SELECT query_id, file_id, modality, max(struct_pack(z := z, c := c, m := -chunk_id)) AS b FROM z GROUP BY ALL),
zm AS (SELECT query_id, file_id, modality, b.z AS z, b.c AS c, b.m AS m FROM zn)"""


Z_SQL = f"{_NEAR_SQL}, {z_sql('SELECT query_id, modality, c FROM near')}"
Z_SAMPLE_SQL = f"{_NEAR_SQL}, {SAMPLE_SQL}, {z_sql('SELECT query_id, modality, similarity AS c FROM sm')}"


@register("zscore_meaning", f"WITH {BASE_SQL}, {Z_SQL} SELECT query_id, file_id, modality, round(z, 5) AS z FROM z")
def zscore_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, q = _ask(spark, sf_dir)
    return rank.meanings(store, q).select("query_id", "file_id", "modality", F.round("z", 5).alias("z"))


def _zfuse_sql(p: rank.ZParams) -> str:
    floor = f"WHERE modality = 'text' OR c >= {p.image_floor}" if p.image_floor is not None else ""
    share = f"CASE WHEN coalesce(coverage, 0) < {p.coverage_gate} THEN 0 ELSE coverage END" if p.words_gated else "coalesce(coverage, 0)"
    return f"""zg AS (SELECT * FROM zm {floor}), zb AS (SELECT query_id, file_id, max(z) AS z FROM zg GROUP BY ALL),
lk AS (SELECT query_id, len(tk) > 0 AND len(list_filter(tk, lambda x: NOT regexp_matches(x, '[0-9]'))) = 0 AS lookup FROM z1),
zs AS (SELECT query_id, file_id, CASE WHEN lookup THEN 0.5 ELSE 1 END * {p.z_weight} * greatest(coalesce(z, 0), 0) + CASE WHEN lookup THEN 2 ELSE 1 END * {p.word_weight} * pow({share}, 1.5) AS score
  FROM zb FULL JOIN cov USING (query_id, file_id) JOIN lk USING (query_id) WHERE z >= {p.z_gate} OR coverage >= {p.coverage_gate})"""


@register("zfusion", f"WITH {BASE_SQL}, {TERMS_SQL}, {Z_SQL}, {_zfuse_sql(rank.ZParams())} SELECT query_id, file_id, round(score, 5) AS score FROM zs")
def zfusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, q = _ask(spark, sf_dir)
    best = rank.best_rows(rank.meanings(store, q)).groupBy("query_id", "file_id").agg(F.max("z").alias("z"))
    covered = keyword.coverage(store.keyword, rank.term_rows(q), store.files, store.roots)
    return rank.zfuse(best, covered, q).select("query_id", "file_id", F.round("score", 5).alias("score"))


#: The two variants that an evaluation runs: scaled from the nearest rows and from a sample.
Z_GATED = rank.ZParams(z_gate=1.0, image_floor=vector.IMAGE_FLOOR, words_gated=True)
Z_SAMPLED = Z_GATED._replace(sample_scale=True)


def z_answer_sql(p: rank.ZParams, limit: int = 10) -> str:
    return f"""{TERMS_SQL}, {Z_SAMPLE_SQL if p.sample_scale else Z_SQL}, {_zfuse_sql(p)},
ov AS (SELECT query_id, file_id, max(c) FILTER (WHERE modality = 'text') AS text_similarity, max(c) FILTER (WHERE modality = 'image') AS image_similarity,
  max(-m) FILTER (WHERE modality = 'text') AS tx_chunk FROM zg WHERE z >= {p.z_gate} GROUP BY ALL),
fused AS (SELECT query_id, file_id, s.score AS rrf, text_similarity, image_similarity, kw.file_id IS NOT NULL AS in_keyword, text_similarity IS NOT NULL AS in_text,
  image_similarity IS NOT NULL AS in_image, coalesce(kw.chunk_id, tx_chunk) AS chunk_id FROM zs s LEFT JOIN kw USING (query_id, file_id) LEFT JOIN ov USING (query_id, file_id)),
{answer_sql(limit, fold=False)}"""


_Z_SHOWN = "query_id, file_id, round(score, 6) AS score, strength, array_to_string(match_sources, ',') AS match_sources, page"


@register("z_search", f"WITH {BASE_SQL}, {BM25_SQL}, {z_answer_sql(Z_GATED)} SELECT {_Z_SHOWN} FROM answer")
def z_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, q = _ask(spark, sf_dir)
    a = rank.z_search(q, store, t.NOW_S, params=Z_GATED)
    return a.select("query_id", "file_id", F.round("score", 6).alias("score"), "strength", F.array_join("match_sources", ",").alias("match_sources"), "page")


@register("threshold_label", f"{ALL_SQL}, {SAMPLE_SQL}, sc AS ({SCALE_SQL}), l AS (SELECT a.query_id, a.file_id, in_keyword OR CASE WHEN x.mean IS NULL THEN text_similarity IS NOT NULL ELSE coalesce((text_similarity - x.mean) / x.sd >= 1.5, false) END"
  " OR CASE WHEN y.mean IS NULL THEN image_similarity IS NOT NULL ELSE coalesce((image_similarity - y.mean) / y.sd >= 2.5, false) END AS strong"
  " FROM answer a LEFT JOIN sc x ON x.query_id = a.query_id AND x.modality = 'text' LEFT JOIN sc y ON y.query_id = a.query_id AND y.modality = 'image') SELECT query_id, file_id, CASE WHEN strong THEN 'strong' ELSE 'weak' END AS label FROM l")
def threshold_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, q = _ask(spark, sf_dir)
    scales = rank.scales(rank.sample_cosines(store, q))
    return rank.threshold_label(_answer(spark, sf_dir), scales, 1.5, 2.5).select("query_id", "file_id", "label")


@register("blend_rerank", f"""{ALL_SQL}, s AS (SELECT query_id, file_id, rank, CASE WHEN file_id % 5 <> 0 THEN (file_id * 37) % 101 END AS model FROM answer),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS r0, row_number() OVER (PARTITION BY query_id ORDER BY model DESC, rank) - 1 AS m0 FROM s WHERE model IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (60.0 + r0) + 1 / (60.0 + m0), 12) DESC, rank) - 1 AS slot FROM o),
p AS (SELECT b.query_id, b.file_id, o.rank AS position FROM b JOIN o ON o.query_id = b.query_id AND o.r0 = b.slot)
SELECT query_id, file_id, position FROM p UNION ALL SELECT query_id, file_id, rank FROM s WHERE model IS NULL""")
def blend_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _answer(spark, sf_dir).select("query_id", "file_id", "rank")
    model = F.when(F.col("file_id") % 5 != 0, (F.col("file_id") * 37) % 101)
    return rank.blend(hits.withColumn("model", model)).select("query_id", "file_id", "position")


@register("strong_prefix", f"""{ALL_SQL}, m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM answer),
f AS (SELECT query_id, min(rank) AS first_low FROM m WHERE best > 0 AND score < 0.8 * best GROUP BY 1)
SELECT m.query_id, count(*) AS n_strong FROM m LEFT JOIN f USING (query_id) WHERE first_low IS NULL OR rank < first_low GROUP BY 1""")
def strong_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.strong_count(_answer(spark, sf_dir), 0.8)


@register("snippets", f"WITH {BASE_SQL}, {BM25_SQL} SELECT query_id, kw.file_id, kw.chunk_id, substr(text, 1, 200) AS snippet FROM kw JOIN chunks c ON c.chunk_id = kw.chunk_id")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _keyword(spark, sf_dir).select("query_id", "file_id", "chunk_id")
    own = index(spark, sf_dir).chunks.select("chunk_id", F.substring("text", 1, 200).alias("snippet"))
    return hits.join(own, "chunk_id").select("query_id", "file_id", "chunk_id", "snippet")


@register("token_counts", f"WITH {BASE_SQL} SELECT source, count(*) AS n_chunks, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM chunks JOIN sizes USING (chunk_id) GROUP BY 1")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = index(spark, sf_dir)
    return ix.chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.size(tokens(F.col("text")))).cast("long").alias("n_tokens"))

"""Catalogue: extraction, index state, events, passages and sizing queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelens.functions.text import question_terms, sanitised
from trovelens.operators import embed, extract, language, lifecycle, passages, rank
from trovelens.plans.index_store import index
from trovelens.sources import tables as t

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_F, _R = t.FILES_SQL, t.ROOTS_SQL


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of many kinds, from part names and numbers."""
    p = t.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    exts = F.array(*[F.lit(e) for e in ("txt", "PDF", "rs", "docx", "png", "cr2", "bin", "csv", "Py", "heic")])
    folder = F.array(*[F.lit(e) for e in ("docs", "node_modules/x", ".git", "My.app/Contents", "src/target/out", "photos")])
    rel = F.concat(F.element_at(folder, (F.pmod(k, F.lit(6)) + 1).cast("int")), F.lit("/item"), k.cast("string"), F.lit("."), F.element_at(exts, (F.pmod(k, F.lit(10)) + 1).cast("int")))
    return p.select(k.alias("id"), rel.alias("path"), (k * 400_003 % 90_000_000).cast("long").alias("size"), (k % 17 == 0).alias("cloud_only"), (k % 23 == 0).alias("is_dir"))


_WALK = """w AS (SELECT p_partkey AS id, ['docs', 'node_modules/x', '.git', 'My.app/Contents', 'src/target/out', 'photos'][p_partkey % 6 + 1] || '/item' || p_partkey || '.' ||
  ['txt', 'PDF', 'rs', 'docx', 'png', 'cr2', 'bin', 'csv', 'Py', 'heic'][p_partkey % 10 + 1] AS path, p_partkey * 400003 % 90000000 AS size, p_partkey % 17 = 0 AS cloud_only, p_partkey % 23 = 0 AS is_dir FROM part),
k AS (SELECT *, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'txt' THEN 'text' WHEN 'csv' THEN 'text' WHEN 'pdf' THEN 'pdf' WHEN 'rs' THEN 'code' WHEN 'py' THEN 'code' WHEN 'docx' THEN 'office'
  WHEN 'png' THEN 'image' WHEN 'heic' THEN 'image' ELSE 'other' END AS kind FROM w)""".replace("\\\\", "\\")


@register("classify_kind", f"WITH {_WALK} SELECT kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM k GROUP BY 1")
def classify_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir).groupBy(extract.kind_of(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@register("admission", f"WITH {_WALK} SELECT id, NOT (path LIKE 'node_modules/%' OR path LIKE '.git/%' OR path LIKE 'src/target/%' OR path LIKE 'My.app/%') AS wanted FROM k")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir).select("id", extract.is_wanted(F.col("path")).alias("wanted"))


_HEADERS = {"25504446": "pdf", "89504E470D0A": "image", "FFD8FFE0": "image", "4D5A9000": "other"}


@register("plan_entry", f"""WITH {_WALK}, h AS (SELECT * REPLACE (CASE WHEN is_dir AND NOT cloud_only THEN 'other' WHEN kind = 'other' AND NOT cloud_only AND size <= 52428800 AND NOT regexp_matches(path, '[.]cr2$') THEN ['pdf', 'image', 'image', 'other'][id // 6 % 4 + 1] ELSE kind END AS kind) FROM k)
SELECT id, kind, CASE WHEN cloud_only OR is_dir OR size > 52428800 THEN 'skip' WHEN kind = 'other' OR kind = 'office' THEN 'name_only' ELSE 'extract' END AS plan,
  CASE WHEN cloud_only THEN 'cloud_only' WHEN is_dir THEN 'bundle' WHEN size > 52428800 THEN 'too_large' END AS skip_reason FROM h""")
def plan_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose extension says nothing are told by their first bytes, unless they may not be read."""
    w = _walked(spark, sf_dir)
    header = F.unhex(F.element_at(F.array(*[F.lit(h) for h in _HEADERS]), (F.floor(F.col("id") / 6) % 4 + 1).cast("int")))
    p = extract.plan(F.col("path"), F.col("size"), F.col("cloud_only"), F.col("is_dir"), ["text", "code", "pdf", "image"], header=header)
    return w.select("id", p.alias("p")).select("id", "p.kind", "p.plan", "p.skip_reason")


@register("data_prefix", f"""WITH {_F}, r AS (SELECT file_id, text || chr(10) || repeat('é,1;' || CASE WHEN file_id % 3 = 0 THEN chr(10) ELSE '' END, CASE WHEN file_id % 2 = 0 THEN 20000 ELSE 10 END) AS text FROM files),
h AS (SELECT file_id, strlen(text) AS n, encode(text)[1:{extract.PREFIX_BYTES}] AS head FROM r), p AS (SELECT *, instr(reverse(hex(head)), 'A0') AS k FROM h)
SELECT file_id, n AS n_bytes, CASE WHEN n <= {extract.PREFIX_BYTES} THEN n ELSE (SELECT max(i) FROM (SELECT unnest(range(1, {extract.PREFIX_BYTES} + 1)) AS i) WHERE hex(head[i:i]) = '0A') END AS n_kept FROM p""")
def data_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.expr("repeat(concat('é,1;', CASE WHEN file_id % 3 = 0 THEN '\\n' ELSE '' END), CASE WHEN file_id % 2 = 0 THEN 20000 ELSE 10 END)")
    f = t.files(spark, sf_dir).select("file_id", F.encode(F.concat("text", F.lit("\n"), more), "UTF-8").alias("content"))
    return f.select("file_id", F.length("content").cast("long").alias("n_bytes"), F.length(extract.data_prefix(F.col("content"))).cast("long").alias("n_kept"))


@register("filename_chunks", f"WITH {_F}, {t.CHUNKS_SQL} SELECT file_id, ordinal, text FROM chunks WHERE source = 'filename'")
def filename_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).chunks.filter("source = 'filename'").select("file_id", "ordinal", "text")


@register("word_chunks", f"WITH {_F}, {t.CHUNKS_SQL} SELECT chunk_id, md5(text) AS digest, length(text) AS n FROM chunks WHERE source = 'body'")
def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.chunks(spark, sf_dir).filter("source = 'body'").select("chunk_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


@register("line_windows", f"""WITH {_F}, l AS (SELECT file_id, string_split(replace(text, '. ', chr(10)), chr(10)) AS ls FROM files),
i AS (SELECT file_id, ls, unnest(range(CASE WHEN len(ls) <= 100 THEN 1 ELSE 1 + CAST(ceil((len(ls) - 100) / 90.0) AS INT) END)) AS i FROM l),
w AS (SELECT file_id, i * 90 + 1 AS line_start, least(i * 90 + 100, len(ls)) AS line_end, array_to_string(list_slice(ls, i * 90 + 1, i * 90 + 100), chr(10)) AS lines_ FROM i)
SELECT file_id, line_start, line_end, md5(lines_) AS digest FROM w WHERE regexp_matches(lines_, '\\S')""")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = t.files(spark, sf_dir).select("file_id", F.replace("text", F.lit(". "), F.lit("\n")).alias("text"))
    return extract.line_windows(f).select("file_id", "line_start", "line_end", F.md5("window").alias("digest"))


_GRAMS_SQL = r"list_distinct(flatten(list_transform(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')), lambda w: list_transform(range(1, length(w) + 1), lambda i: substr('_' || w || '_', i, 3)))))"


@register("language_detect", f"""WITH g AS (SELECT doc_id, lang, unnest({_GRAMS_SQL}) AS gram FROM documents),
k AS (SELECT lang, count(*) AS k FROM documents WHERE doc_id % 2 = 0 AND lang IS NOT NULL GROUP BY 1),
c AS (SELECT gram, lang, count(*) AS c FROM g WHERE doc_id % 2 = 0 AND lang IS NOT NULL GROUP BY ALL),
m AS (SELECT gram FROM c GROUP BY 1 HAVING sum(c) >= {language.LEAST_TEXTS}),
w AS (SELECT m.gram, k.lang, floor(1000 * ln((coalesce(c, 0)::DOUBLE + 1) / (k + 2)))::BIGINT AS w FROM m CROSS JOIN k LEFT JOIN c ON c.gram = m.gram AND c.lang = k.lang),
s AS (SELECT doc_id, w.lang, sum(w) AS score, count(*) AS n FROM g JOIN w USING (gram) GROUP BY doc_id, w.lang),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang DESC) AS r, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, lang DESC) AS second FROM s)
SELECT d.doc_id, CASE WHEN n >= {language.LEAST_GRAMS} AND score - second >= {language.AHEAD} * n THEN r.lang END AS detected FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND r = 1""")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model counted on those with an even id."""
    d = t.read(spark, sf_dir, "documents")
    return language.detected(d, language.model(d.filter("doc_id % 2 = 0")), "doc_id")


@register("hash_embed")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.hash_embed(t.files(spark, sf_dir), "file_id", "text")


@register("l2_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS l1 FROM embeddings")
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t.read(spark, sf_dir, "embeddings").select("vec_id", embed.l2_normalised(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)), 5).alias("l1"))


@register("content_hash", f"WITH {_F} SELECT content_hash, count(*) AS n, min(file_id) AS first_id FROM files GROUP BY 1 HAVING count(*) > 1")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t.files(spark, sf_dir).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("first_id"))
    return g.filter("n > 1")


@register("ctc_collapse", """WITH s AS (SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN '_' ELSE substr(event_type, 1, 1) END AS c FROM events),
l AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM s) SELECT user_id, count(*) AS n, string_agg(c, '' ORDER BY event_id) AS text FROM l WHERE c IS DISTINCT FROM p AND c <> '_' GROUP BY 1""")
def ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read(spark, sf_dir, "events")
    s = e.select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, "_").otherwise(F.substring("event_type", 1, 1)).alias("c"))
    kept = extract.ctc_collapse(s, ["user_id"], "event_id", "c", "_")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "c"))), lambda x: x["c"]), "")
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), text.alias("text"))


@register("sanitised_queries", r"""SELECT item_id, CASE WHEN trim(text) = '' THEN '' ELSE array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: '"' || replace(w, '"', '""') || '"'), ' ') || '*' END AS match FROM benchmark""")
def sanitised_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "benchmark").select("item_id", sanitised(F.col("text")).alias("match"))


_AGAIN = "path || CASE WHEN file_id % 11 = 0 THEN '.moved' ELSE '' END AS path, size + CASE WHEN file_id % 13 = 0 THEN 1 ELSE 0 END AS size, mtime_ns FROM files WHERE file_id % 7 <> 0"


def _walk_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later walk: some files gone, some elsewhere, some of another size."""
    f = t.files(spark, sf_dir).filter(F.col("file_id") % 7 != 0)
    moved = F.concat("path", F.when(F.col("file_id") % 11 == 0, ".moved").otherwise(""))
    return f.select(moved.alias("path"), (F.col("size") + (F.col("file_id") % 13 == 0).cast("int")).alias("size"), "mtime_ns", "content_hash")


@register("scan_diff", f"""WITH {_F}, w AS (SELECT {_AGAIN})
SELECT coalesce(w.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'inserted' WHEN w.path IS NULL THEN 'unseen' WHEN w.size = s.size AND w.mtime_ns = s.mtime_ns THEN 'unchanged' ELSE 'changed' END AS outcome
FROM w FULL JOIN files s ON w.path = s.path""")
def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.scan_diff(_walk_again(spark, sf_dir), t.files(spark, sf_dir))


@register("scan_summary", f"""WITH {_F}, w AS (SELECT {_AGAIN}), d AS (SELECT CASE WHEN s.path IS NULL THEN 'inserted' WHEN w.path IS NULL THEN 'unseen' WHEN w.size = s.size AND w.mtime_ns = s.mtime_ns THEN 'unchanged' ELSE 'changed' END AS outcome
FROM w FULL JOIN files s ON w.path = s.path) SELECT outcome, count(*) AS n FROM d GROUP BY 1""")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_diff(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@register("move_detect", f"""WITH {_F}, v AS (SELECT size, content_hash, file_id, row_number() OVER (PARTITION BY size, content_hash ORDER BY file_id) AS nth FROM files WHERE file_id % 7 = 0 OR file_id % 11 = 0),
n AS (SELECT size, content_hash, path || '.moved' AS path, row_number() OVER (PARTITION BY size, content_hash ORDER BY path || '.moved') AS nth FROM files WHERE file_id % 11 = 0 AND file_id % 7 <> 0 AND file_id % 13 <> 0)
SELECT path, file_id FROM n JOIN v USING (size, content_hash, nth)""")
def move_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = t.files(spark, sf_dir).withColumn("kind", extract.kind_of(F.col("path")))
    new = _walk_again(spark, sf_dir).filter(F.col("path").endswith(".moved")).withColumn("kind", F.lit("text"))
    seen = _walk_again(spark, sf_dir).select("path")
    vanished = f.join(seen, "path", "left_anti")
    sizes = vanished.select("size", "kind").distinct()
    known = f.select(F.concat("path", F.lit(".moved")).alias("path"), F.col("size").alias("true_size"))
    new = new.join(sizes, ["size", "kind"], "left_semi").join(known, "path").filter("size = true_size")
    return lifecycle.moves(new.select("path", "size", "kind", "content_hash"), vanished.select("file_id", "size", "kind", "content_hash"))


_NOW = t.NOW_S


@register("next_pending", f"""WITH {_F}, {_R} SELECT file_id, root, mtime_ns FROM files JOIN roots USING (root)
WHERE state = 'pending' AND enabled AND status IN ('ok', 'watch_failed') AND file_id % 4 <> 0 OR (state = 'pending' AND enabled AND status IN ('ok', 'watch_failed') AND {_NOW} - 1800 + file_id <= {_NOW}) ORDER BY mtime_ns DESC, file_id LIMIT 256""")
def next_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = t.files(spark, sf_dir).withColumn("next_attempt_at", F.when(F.col("file_id") % 4 == 0, F.lit(_NOW - 1800) + F.col("file_id")))
    return lifecycle.next_pending(f, t.roots(spark, sf_dir), _NOW, 256).select("file_id", "root", F.col("mtime_ns").cast("long").alias("mtime_ns"))


@register("retry_backoff", f"""WITH {_F}, a AS (SELECT file_id, CASE WHEN file_id % 5 = 0 THEN least(file_id % 3 + 1, 2) ELSE file_id % 3 + 1 END AS attempts FROM files)
SELECT file_id, attempts, CASE WHEN attempts >= 3 THEN 'error' ELSE 'pending' END AS state, CASE WHEN attempts < 3 THEN {_NOW} + CASE attempts WHEN 1 THEN 30 WHEN 2 THEN 120 ELSE 600 END END AS next_attempt_at FROM a""")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = t.files(spark, sf_dir).select("file_id", (F.col("file_id") % 3).alias("attempts"), (F.col("file_id") % 5 == 0).alias("locked"))
    return lifecycle.after_failure(f, _NOW).select("file_id", "attempts", "state", F.col("next_attempt_at").cast("long").alias("next_attempt_at"))


@register("state_counts", f"WITH {_F}, {_R} SELECT state, count(*) AS n FROM files JOIN roots USING (root) WHERE state <> 'pending' OR (enabled AND status IN ('ok', 'watch_failed')) GROUP BY 1")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.state_counts(t.files(spark, sf_dir).select("root", "state"), t.roots(spark, sf_dir))


@register("root_counts", f"WITH {_F}, {_R} SELECT root, enabled, status, count(*) FILTER (WHERE state = 'indexed') AS n_indexed FROM roots LEFT JOIN files USING (root) GROUP BY ALL")
def root_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t.files(spark, sf_dir).select("root", "state").filter("state = 'indexed'").groupBy("root").agg(F.count(F.lit(1)).alias("n_indexed"))
    return t.roots(spark, sf_dir).join(n, "root", "left").select("root", "enabled", "status", F.coalesce("n_indexed", F.lit(0)).cast("long").alias("n_indexed"))


@register("errors_newest", f"WITH {_F} SELECT file_id, path, coalesce(CASE WHEN file_id % 3 = 0 THEN 'locked' END, 'other') AS code, coalesce(CASE WHEN file_id % 2 = 0 THEN 'busy' END, '') AS detail FROM files WHERE state = 'error' ORDER BY file_id DESC LIMIT 50")
def errors_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = t.files(spark, sf_dir).select("file_id", "path", "state", F.when(F.col("file_id") % 3 == 0, "locked").alias("error_code"), F.when(F.col("file_id") % 2 == 0, "busy").alias("error"))
    return lifecycle.errors(f, 50)


@register("requeue_model", f"WITH {_F} SELECT file_id, lang IN ('de', 'fr') AS requeue, CASE WHEN lang IN ('de', 'fr') THEN 0 ELSE 4 END AS pipeline_version FROM files")
def requeue_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = t.files(spark, sf_dir).select("file_id", F.when(F.col("lang").isin("de", "fr"), "image").otherwise("text").alias("kind"), F.lit(4).alias("pipeline_version"))
    return lifecycle.requeued(f, {"text": "a", "image": "b"}, {"text": "a", "image": "c", "ocr": "d"}).select("file_id", "requeue", "pipeline_version")


@register("feature_backfill", f"WITH {_F} SELECT count(*) AS total, count(*) FILTER (WHERE (file_id % 8) & 2 <> 0) AS left_over, count(*) FILTER (WHERE (file_id % 8) & 2 = 0) AS done FROM files")
def feature_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.backfill(t.files(spark, sf_dir).select((F.col("file_id") % 8).alias("features_missing")), 2)


@register("keep_rule", f"""WITH {_F}, p AS (SELECT file_id, content_hash AS s, CASE WHEN file_id % 3 = 0 THEN content_hash WHEN file_id % 3 = 1 THEN 'other' END AS f, CASE WHEN file_id % 5 = 0 THEN 'bad' END AS error, CASE WHEN file_id % 9 = 0 THEN 3 ELSE 4 END AS v FROM files)
SELECT file_id, v = 4 AND error IS NULL AND coalesce(s = f, false) AS keep FROM p""")
def keep_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("file_id")
    f = t.files(spark, sf_dir).select(
        "file_id", F.col("content_hash").alias("s_content_hash"), F.when(i % 3 == 0, F.col("content_hash")).when(i % 3 == 1, "other").alias("f_content_hash"),
        F.when(i % 5 == 0, "bad").alias("s_error"), F.when(i % 9 == 0, 3).otherwise(4).alias("s_pipeline_version"),
        *[F.lit(None).cast("string").alias(c) for c in ("s_skip_reason", "f_skip_reason")], F.lit("text").alias("s_kind"), F.lit("text").alias("f_kind"),
    )
    return f.select("file_id", lifecycle.keeps("s", "f", 4).alias("keep"))


@register("stability_decision", """WITH e AS (SELECT event_id, (event_id * 7919 % 9000) * 1000000 - 3500000000 AS past, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS prev FROM events),
a AS (SELECT *, CASE WHEN past >= 0 THEN past WHEN -past < 2000000000 THEN 0 ELSE 3000000000 END AS age FROM e)
SELECT event_id, CASE WHEN age < 3000000000 THEN 'defer' WHEN prev IS NOT NULL AND prev <> 1 THEN 'defer' WHEN prev IS NULL THEN 'watch' ELSE 'extract' END AS decision,
  CASE WHEN age < 3000000000 THEN greatest(3000000000 - age, 1000000000) WHEN prev IS NOT NULL AND prev <> 1 THEN 5000000000 WHEN prev IS NULL THEN 1000000000 ELSE 0 END AS wait_ns FROM a""")
def stability_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read(spark, sf_dir, "events").select("event_id")
    past = (F.col("event_id") * 7919 % 9000) * 1_000_000 - F.lit(3_500_000_000)
    now = F.lit(t.BASE_NS)
    prev = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3)
    d = lifecycle.stability(now - past, now, F.lit(1), prev)
    return e.select("event_id", d.alias("d")).select("event_id", "d.decision", "d.wait_ns")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("root"), F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string")).alias("path"))


@register("debounce_sessions", """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id AS root, min(ts) AS started, count(*) AS n_events, count(DISTINCT event_id % 5) AS n_paths FROM b GROUP BY user_id, burst""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.debounced(_events(spark, sf_dir), 3600)


@register("held_deletions", """WITH e AS (SELECT event_id, user_id AS file_id, ts, CASE WHEN event_id % 3 = 0 THEN 'vanished' ELSE 'seen' END AS kind FROM events),
l AS (SELECT *, lead(ts) OVER (PARTITION BY file_id ORDER BY ts, event_id) AS nxt FROM e)
SELECT file_id, ts AS vanished_at FROM l WHERE kind = 'vanished' AND (nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) > 7200000000)""")
def held_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("file_id"), "ts", F.when(F.col("event_id") % 3 == 0, "vanished").otherwise("seen").alias("kind"))
    return lifecycle.held_deletions(e, 7200)


@register("poll_timers", """SELECT event_id, CASE WHEN event_id * 31 % 400 > 300 THEN 'clock_jump' WHEN event_id * 97 % 30000 >= 21600 THEN 'interval' WHEN event_id % 2 = 0 AND event_id * 97 % 30000 >= 900 THEN 'poll' END AS reason FROM events""")
def poll_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return t.read(spark, sf_dir, "events").select("event_id", lifecycle.poll_reason(i * 31 % 400, i * 97 % 30_000, 6, i % 2 == 0).alias("reason"))


@register("quota_reserve", """WITH RECURSIVE r AS (SELECT event_id AS request_id, user_id AS account, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS k FROM events),
s AS (SELECT day, 0::BIGINT AS k, NULL::BIGINT AS request_id, NULL::BOOLEAN AS ok, NULL::VARCHAR AS scope, MAP {}::MAP(BIGINT, INTEGER) AS used, 0 AS total FROM (SELECT DISTINCT day FROM r)
  UNION ALL SELECT s.day, r.k, r.request_id, coalesce(used[account], 0) < 2 AND total < 40, CASE WHEN coalesce(used[account], 0) >= 2 THEN 'account' WHEN total >= 40 THEN 'global' END,
    CASE WHEN coalesce(used[account], 0) < 2 AND total < 40 THEN map_concat(used, MAP {account: coalesce(used[account], 0) + 1}) ELSE used END, total + CASE WHEN coalesce(used[account], 0) < 2 AND total < 40 THEN 1 ELSE 0 END
  FROM s JOIN r ON r.day = s.day AND r.k = s.k + 1)
SELECT request_id, ok, scope FROM s WHERE k > 0""")
def quota_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL goes through the requests one after the other, as a counter does."""
    e = t.read(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("account"), F.to_date("ts").alias("day"))
    return lifecycle.quota(e, 2, 40)


@register("pause_reason", """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'user' WHEN event_id * 1000003 % 2000000000 > 0 AND (event_id * 1000003 % 2000000000 < 1073741824 OR (event_id % 2 = 0 AND event_id * 1000003 % 2000000000 < 1342177280)) THEN 'low_memory'
 WHEN event_id % 3 = 0 THEN 'battery' END AS reason FROM events""")
def pause_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return t.read(spark, sf_dir, "events").select("event_id", lifecycle.pause_reason(i % 10 == 0, i * 1_000_003 % 2_000_000_000, i % 2 == 0, i % 3 == 0).alias("reason"))


@register("nearest_rank_pct", "WITH s AS (SELECT user_id, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1) SELECT user_id, v[CAST(floor(0.5 * (n - 1) + 0.5) AS INT) + 1] AS p50, v[CAST(floor(0.95 * (n - 1) + 0.5) AS INT) + 1] AS p95 FROM s")
def nearest_rank_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.nearest_ranks(t.read(spark, sf_dir, "events").select("user_id", "value"), "user_id", "value", {"p50": 0.5, "p95": 0.95})


_QT = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 3)"


@register("question_terms", f"WITH x AS (SELECT conv_id, turn, {_QT} AS ws FROM conversations WHERE role = 'user') SELECT conv_id, turn, array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i), ' ') AS terms FROM x")
def question_terms_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.read(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", F.array_join(question_terms(F.col("text")), " ").alias("terms"))


_QUESTION = "what about the edition of the thing"
_PR = rf"""{_F}, {_R}, {t.CHUNKS_SQL}, p0 AS (SELECT chunks.file_id, ordinal, chunks.text, len(list_filter(['what', 'about', 'the', 'edition', 'thing'], lambda w: contains(lower(chunks.text), w))) AS hits,
  CASE WHEN file_id % 3 > 0 THEN (file_id * 13 + ordinal * 7) % 100 / 100.0::DOUBLE END AS sim FROM chunks JOIN files USING (file_id) JOIN roots USING (root) WHERE source IN ('body', 'ocr', 'code_symbol') AND enabled AND status <> 'missing'),
p1 AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY hits DESC, ordinal) - 1 AS k, row_number() OVER (PARTITION BY file_id ORDER BY sim DESC NULLS LAST, ordinal) - 1 AS m FROM p0),
p2 AS (SELECT *, round(CASE WHEN hits > 0 THEN 1 / (60.0::DOUBLE + k) ELSE 0 END + CASE WHEN sim IS NOT NULL THEN 1 / (60.0::DOUBLE + m) ELSE 0 END, 9) AS score FROM p1)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = index(spark, sf_dir)
    return passages.candidates(store.chunks, store.files, store.roots)


def _ranked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    rows = c.withColumn("terms", question_terms(F.lit(_QUESTION))).withColumn("sim", F.when(F.col("file_id") % 3 > 0, (F.col("file_id") * 13 + F.col("ordinal") * 7) % 100 / 100.0))
    return passages.ranked(rows, "terms", "sim")


@register("passage_rank", f"WITH {_PR} SELECT file_id, ordinal, score, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, ordinal) AS place FROM p2")
def passage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_passages(spark, sf_dir).select("file_id", "ordinal", "score", "place")


@register("passage_budget")
def passage_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.picked(_ranked_passages(spark, sf_dir), passages.PASSAGE_MOST)


@register("whole_file")
def whole_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.whole_texts(_candidates(spark, sf_dir))


@register("first_text", f"WITH {_F}, {_R}, {t.CHUNKS_SQL} SELECT chunks.file_id, min_by(substr(chunks.text, 1, 80), ordinal) AS text FROM chunks JOIN files USING (file_id) JOIN roots USING (root) WHERE source IN ('body', 'ocr', 'code_symbol') AND trim(chunks.text) <> '' AND enabled AND status <> 'missing' GROUP BY 1")
def first_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a preview of a file shows: the beginning of its first text."""
    c = _candidates(spark, sf_dir).filter(F.col("text").rlike(r"\S"))
    return c.groupBy("file_id").agg(F.min_by(F.substring("text", 1, 80), "ordinal").alias("text"))


@register("budget_split", "SELECT p_partkey AS id, least(greatest(8000 // greatest(p_partkey % 30, 1), 1200), 4000) AS units FROM part")
def budget_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), passages.budget(F.col("p_partkey") % 30).alias("units"))


@register("folder_members", f"WITH {_F} SELECT file_id, path FROM files WHERE starts_with(path, 'src1/')")
def folder_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.files(spark, sf_dir).filter(F.col("path").startswith("src1/")).select("file_id", "path")

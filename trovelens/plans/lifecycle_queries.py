"""Catalogue: reconciliation, the life of rows, roots, scheduling and presentation rules with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelens.operators import embed, lifecycle, presentation, reconcile
from trovelens.plans import search_queries as sq
from trovelens.plans.index_store import index
from trovelens.sources import tables as t

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_NOW, SCAN = t.NOW_S, 7


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rows of the files: some of an older pipeline, some with failures."""
    f, i = t.files(spark, sf_dir), F.col("file_id")
    return f.select(
        "file_id", "root", "path", F.expr("substring(path, length(root) + 2)").alias("rel_path"), "file_name", F.lit("text").alias("kind"), "size", "mtime_ns", "state", "content_hash",
        F.when(i % 19 == 0, 3).otherwise(reconcile.PIPELINE).alias("pipeline_version"), F.lit(SCAN - 1).cast("long").alias("seen_scan_id"), (i % 3).alias("attempts"),
        F.when(i % 3 > 0, F.lit(_NOW) + i % 100).alias("next_attempt_at"), F.when(F.col("state") == "error", "unreadable").alias("error"),
    )


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roots and what a look at them finds: one came back, one is gone, one is still closed."""
    probe = F.when(F.col("root") == "src2", "missing").when(F.col("root") == "src7", "permission_denied").otherwise("ok")
    return t.roots(spark, sf_dir).withColumn("probe", probe)


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later walk: some files gone, some in another root, some of another size, some only in the cloud."""
    f, i = t.files(spark, sf_dir).filter(F.col("file_id") % 7 != 0), F.col("file_id")
    moved = i % 11 == 0
    return f.select(
        F.when(moved, "src1").otherwise(F.col("root")).alias("root"), F.when(moved, F.concat(F.lit("src1/moved/"), F.col("file_name"))).otherwise(F.col("path")).alias("path"),
        (F.col("size") + (i % 13 == 0).cast("int")).alias("size"), "mtime_ns", (i % 29 == 0).alias("cloud_only"), "content_hash",
    )


ROWS_SQL = f"""{t.FILES_SQL}, {t.ROOTS_SQL},
rows0 AS (SELECT file_id, root, path, substr(path, length(root) + 2) AS rel_path, file_name, size, mtime_ns, state, content_hash, CASE WHEN file_id % 19 = 0 THEN 3 ELSE 4 END AS pipeline_version, 6 AS seen_scan_id,
  file_id % 3 AS attempts, CASE WHEN file_id % 3 > 0 THEN {_NOW} + file_id % 100 END AS next_attempt_at, CASE WHEN state = 'error' THEN 'unreadable' END AS error FROM files),
rp0 AS (SELECT *, CASE root WHEN 'src2' THEN 'missing' WHEN 'src7' THEN 'permission_denied' ELSE 'ok' END AS probe FROM roots),
rp AS (SELECT root, enabled, probe, CASE WHEN probe = 'ok' AND status IN ('ok', 'watch_failed') THEN status ELSE probe END AS status FROM rp0),
w0 AS (SELECT CASE WHEN file_id % 11 = 0 THEN 'src1' ELSE root END AS root, CASE WHEN file_id % 11 = 0 THEN 'src1/moved/' || file_name ELSE path END AS path,
  size + CASE WHEN file_id % 13 = 0 THEN 1 ELSE 0 END AS size, mtime_ns, file_id % 29 = 0 AS cloud_only, content_hash FROM files WHERE file_id % 7 <> 0)"""


def scan_sql(below: str | None = None) -> str:
    """The reconciliation as CTEs: done (each row with its outcome); of what is at or below a path, if one is given."""
    here = lambda c: f"AND ({c} = '{below}' OR starts_with({c}, '{below}/'))" if below else ""
    return f"""sc AS (SELECT root FROM rp WHERE enabled AND probe = 'ok'),
w AS (SELECT * FROM w0 WHERE root IN (SELECT root FROM sc) {here("path")}),
homeless AS (SELECT file_id, size, content_hash FROM rows0 f WHERE root IN (SELECT root FROM rp WHERE enabled AND status IN ('ok', 'watch_failed')) AND path NOT IN (SELECT path FROM w) {here("path")}),
fresh AS (SELECT * FROM w WHERE path NOT IN (SELECT path FROM rows0) AND NOT cloud_only),
mv AS (SELECT a.path AS "to", b.file_id FROM (SELECT path, size, content_hash, row_number() OVER (PARTITION BY size, content_hash ORDER BY path) AS nth FROM fresh) a
  JOIN (SELECT file_id, size, content_hash, row_number() OVER (PARTITION BY size, content_hash ORDER BY file_id) AS nth FROM homeless) b USING (size, content_hash, nth)),
jn AS (SELECT f.*, "to", w.root AS w_root, w.path AS w_path, w.size AS w_size, w.mtime_ns AS w_mtime FROM (SELECT rows0.*, "to" FROM rows0 LEFT JOIN mv USING (file_id)) f FULL JOIN w ON coalesce("to", f.path) = w.path),
done AS (SELECT *, CASE WHEN file_id IS NULL THEN 'inserted' WHEN "to" IS NOT NULL THEN 'moved' WHEN w_path IS NULL THEN 'unseen'
  WHEN pipeline_version = 4 AND root = w_root AND size = w_size AND mtime_ns = w_mtime THEN 'unchanged' ELSE 'changed' END AS outcome FROM jn)"""


def _scan(spark: SparkSession, sf_dir: str, below: str | None = None) -> reconcile.Reconciled:
    paths = None if below is None else spark.createDataFrame([(below,)], "path string")
    return reconcile.reconcile(rows(spark, sf_dir), walk(spark, sf_dir), reconcile.probed(roots(spark, sf_dir)), SCAN, paths=paths)


@register("reconcile", f"""WITH {ROWS_SQL}, {scan_sql()}, mx AS (SELECT max(file_id) AS m FROM rows0), ids AS (SELECT w_path, m + row_number() OVER (ORDER BY w_path) AS new_id FROM done, mx WHERE outcome = 'inserted')
SELECT coalesce(file_id, new_id) AS file_id, CASE WHEN outcome = 'unseen' THEN root ELSE w_root END AS root, CASE WHEN outcome IN ('inserted', 'moved') THEN w_path ELSE path END AS path,
  CASE WHEN outcome IN ('inserted', 'moved') THEN substr(w_path, length(w_root) + 2) ELSE rel_path END AS rel_path, coalesce(w_size, size) AS size, coalesce(w_mtime, mtime_ns) AS mtime_ns,
  CASE WHEN outcome IN ('inserted', 'changed') OR (outcome = 'moved' AND state = 'indexing') THEN 'pending' ELSE state END AS state, CASE WHEN outcome = 'unseen' THEN 6 ELSE 7 END AS seen_scan_id,
  CASE WHEN outcome IN ('inserted', 'changed') THEN 0 ELSE attempts END AS attempts, CASE WHEN outcome <> 'changed' THEN next_attempt_at END AS next_attempt_at FROM done LEFT JOIN ids USING (w_path)""")
def reconcile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).files.select("file_id", "root", "path", "rel_path", "size", F.col("mtime_ns").cast("long").alias("mtime_ns"), "state", "seen_scan_id", "attempts", "next_attempt_at")


_LEFT = "done JOIN sc USING (root) WHERE outcome = 'unseen'"


@register("reconcile_summary", f"WITH {ROWS_SQL}, {scan_sql()} SELECT outcome, count(*) AS n FROM done WHERE outcome <> 'unseen' GROUP BY 1 UNION ALL SELECT 'removed', count(*) FROM {_LEFT}")
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All roots first, deletions last: a row that no root claimed goes."""
    done = _scan(spark, sf_dir)
    removed = done.unseen.agg(F.count(F.lit(1)).alias("n")).select(F.lit("removed").alias("outcome"), "n")
    return done.outcomes.filter("outcome <> 'unseen'").groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).unionByName(removed)


@register("path_scan", f"""WITH {ROWS_SQL}, {scan_sql("src1")}, below AS (SELECT * FROM done WHERE outcome <> 'unseen' OR root IN (SELECT root FROM sc)), pd AS (SELECT coalesce(w_path, path) AS path, outcome FROM below WHERE outcome <> 'unseen' OR starts_with(path, 'src1/de/'))
SELECT path, outcome FROM (WITH {scan_sql("src1/de")} SELECT coalesce(w_path, path) AS path, outcome FROM done WHERE outcome <> 'unseen' OR (root IN (SELECT root FROM sc) AND starts_with(path, 'src1/de/')))""")
def path_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what is at or below one reported folder."""
    return _scan(spark, sf_dir, "src1/de").outcomes


@register("settle_held", f"""WITH {ROWS_SQL}, {scan_sql()}, h AS (SELECT file_id, 7 AS scan_id, {_NOW} + file_id % 10 - 5 AS until_s FROM rows0 WHERE file_id % 2 = 0), now_seen AS (SELECT file_id, CASE WHEN outcome = 'unseen' THEN 6 ELSE 7 END AS seen FROM done WHERE file_id IS NOT NULL)
SELECT h.file_id, until_s <= {_NOW} AS removed FROM h JOIN now_seen USING (file_id) WHERE seen < scan_id""")
def settle_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _scan(spark, sf_dir).files
    held = rows(spark, sf_dir).filter("file_id % 2 = 0").select("file_id", F.lit(SCAN).alias("scan_id"), (F.lit(_NOW) + F.col("file_id") % 10 - 5).alias("until_s"))
    waiting, gone = reconcile.settled(files, held, _NOW)
    return waiting.select("file_id", F.lit(False).alias("removed")).unionByName(gone.select("file_id", F.lit(True).alias("removed")))


@register("move_name_chunks", f"""WITH {ROWS_SQL}, {t.CHUNKS_SQL}, {scan_sql()} SELECT chunk_id, trim(regexp_replace(regexp_replace(substr(w_path, length(w_root) + 2), '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '[/_\\-.\\s]+', ' ', 'g')) AS text
FROM chunks JOIN done USING (file_id) WHERE source = 'filename' AND outcome = 'moved'""".replace("\\\\", "\\"))
def move_name_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _scan(spark, sf_dir)
    moved = done.outcomes.filter("outcome = 'moved'").join(done.files.select("path", "file_id"), "path").select("file_id")
    chunks = reconcile.renamed_chunks(index(spark, sf_dir).chunks, done.files, moved)
    return chunks.filter("source = 'filename'").join(moved, "file_id", "left_semi").select("chunk_id", "text")


@register("delete_cascade", f"""WITH {ROWS_SQL}, {t.CHUNKS_SQL}, {t.VECTORS_SQL}, g AS (SELECT file_id FROM files WHERE state = 'skipped') SELECT 'chunks' AS name, count(*) AS n FROM chunks WHERE file_id NOT IN (SELECT * FROM g)
UNION ALL SELECT 'text vectors', count(*) FROM vecs WHERE file_id NOT IN (SELECT * FROM g) UNION ALL SELECT 'image vectors', count(*) FROM imgs WHERE file_id NOT IN (SELECT * FROM g) UNION ALL SELECT 'files', count(*) FROM files WHERE state <> 'skipped'
UNION ALL SELECT 'keys', count(DISTINCT content_hash) FROM files WHERE state = 'skipped' AND content_hash NOT IN (SELECT content_hash FROM files WHERE state <> 'skipped')""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each table after a deletion, and how many thumbnails' keys nothing refers to any more."""
    store = index(spark, sf_dir)
    left = reconcile.without(store.files, store.files.filter("state = 'skipped'"), store.chunks, store.text_vectors, store.image_vectors)
    named = dict(zip(("files", "chunks", "text vectors", "image vectors"), left, strict=True)) | {"keys": reconcile.unreferenced(store.files, left[0])}
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, df in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


_STEPS = ["start", "store", "keep", "retry", "delete"]


@register("apply_steps", f"""WITH {ROWS_SQL}, s AS (SELECT *, [{", ".join(f"'{x}'" for x in _STEPS)}][file_id % 5 + 1] AS step, file_id % 4 = 0 AS locked FROM rows0),
l AS (SELECT * REPLACE (CASE WHEN step IN ('store', 'keep') AND state <> 'indexing' THEN NULL ELSE step END AS step) FROM s),
a AS (SELECT *, CASE WHEN step = 'retry' THEN CASE WHEN locked THEN least(attempts + 1, 2) ELSE attempts + 1 END ELSE attempts END AS n FROM l WHERE step IS DISTINCT FROM 'delete')
SELECT file_id, CASE step WHEN 'start' THEN 'indexing' WHEN 'store' THEN 'indexed' WHEN 'keep' THEN 'indexed' WHEN 'retry' THEN CASE WHEN n >= 3 THEN 'error' ELSE 'pending' END ELSE state END AS state,
  CASE WHEN step IN ('store', 'keep') THEN size + 5 ELSE size END AS size, CASE WHEN step = 'store' THEN 'new' ELSE content_hash END AS content_hash, CASE WHEN step = 'store' THEN NULL WHEN step = 'retry' THEN 'busy' ELSE error END AS error,
  CASE WHEN step = 'store' THEN 4 ELSE pipeline_version END AS pipeline_version, CASE WHEN step IN ('store', 'keep') THEN 0 ELSE n END AS attempts,
  CASE WHEN step IN ('store', 'keep') THEN NULL WHEN step = 'retry' THEN CASE WHEN n >= 3 THEN NULL WHEN n <= 1 THEN {_NOW} + 30 ELSE {_NOW} + 120 END ELSE next_attempt_at END AS next_attempt_at,
  CASE step WHEN 'store' THEN 'indexed' WHEN 'keep' THEN 'unchanged' WHEN 'retry' THEN CASE WHEN n >= 3 THEN 'error' ELSE 'retried' END END AS done FROM a""")
def apply_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, i = rows(spark, sf_dir), F.col("file_id")
    steps = f.select(
        "file_id", F.element_at(F.array(*[F.lit(x) for x in _STEPS]), (i % 5 + 1).cast("int")).alias("step"), F.lit("indexed").alias("state"), (F.col("size") + 5).alias("size"), "mtime_ns",
        F.lit("new").alias("content_hash"), F.when(i % 5 == 3, "busy").alias("error"), (i % 4 == 0).alias("locked"),
    )
    return reconcile.applied(f, steps, _NOW).select("file_id", "state", "size", "content_hash", "error", "pipeline_version", "attempts", "next_attempt_at", "done")


@register("touch_unchanged", f"WITH {ROWS_SQL} SELECT file_id, CASE WHEN file_id % 6 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN file_id % 6 = 0 THEN 'indexed' ELSE state END AS state, CASE WHEN file_id % 6 = 0 THEN 0 ELSE attempts END AS attempts, CASE WHEN file_id % 6 <> 0 THEN next_attempt_at END AS next_attempt_at, content_hash FROM rows0")
def touch_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = rows(spark, sf_dir)
    looks = f.filter("file_id % 6 = 0").select("file_id", (F.col("size") + 1).alias("size"), "mtime_ns", F.lit("indexed").alias("state"))
    return reconcile.touched(f, looks).select("file_id", "size", "state", "attempts", "next_attempt_at", "content_hash")


_QUEUE = "file_id, state, attempts, next_attempt_at, error, pipeline_version"


def _queue(df: DataFrame) -> DataFrame:
    return df.select(*_QUEUE.split(", "))


@register("reset_indexing", f"WITH {ROWS_SQL} SELECT {_QUEUE} FROM (SELECT * REPLACE (CASE state WHEN 'indexing' THEN 'pending' ELSE state END AS state) FROM rows0)")
def reset_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(reconcile.reset_after_crash(rows(spark, sf_dir)))


@register("retry_errors", f"WITH {ROWS_SQL} SELECT {_QUEUE} FROM (SELECT * REPLACE (CASE state WHEN 'error' THEN 'pending' ELSE state END AS state, CASE state WHEN 'error' THEN 0 ELSE attempts END AS attempts, CASE state WHEN 'error' THEN NULL ELSE next_attempt_at END AS next_attempt_at) FROM rows0)")
def retry_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(reconcile.retry_errors(rows(spark, sf_dir)))


@register("invalidate_kind", f"WITH {ROWS_SQL}, k AS (SELECT *, file_id % 4 = 0 AS hit FROM rows0) SELECT file_id, CASE WHEN hit THEN 'pending' ELSE state END AS state, CASE WHEN hit THEN 0 ELSE attempts END AS attempts, CASE WHEN NOT hit THEN next_attempt_at END AS next_attempt_at, error, CASE WHEN hit THEN 0 ELSE pipeline_version END AS pipeline_version FROM k")
def invalidate_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = rows(spark, sf_dir).withColumn("kind", F.when(F.col("file_id") % 4 == 0, "image").otherwise(F.col("kind")))
    return _queue(reconcile.invalidate(f, "image"))


_HOLDS = ["in_flight", "ready", "watching", "deferred"]


@register("schedule_poll", f"""WITH {ROWS_SQL}, h AS (SELECT file_id, [{", ".join(f"'{x}'" for x in _HOLDS)}][file_id % 4 + 1] AS hold, {_NOW} + file_id % 7 - 3 AS at_s FROM rows0 WHERE file_id % 25 < 4),
ok AS (SELECT root FROM roots WHERE enabled AND status IN ('ok', 'watch_failed')), o AS (SELECT h.*, mtime_ns, hold = 'in_flight' OR root IN (SELECT root FROM ok) AS kept FROM h JOIN rows0 USING (file_id)),
n AS (SELECT count(*) FILTER (WHERE kept) AS held, count(*) FILTER (WHERE hold = 'in_flight') AS flying FROM o),
np AS (SELECT file_id, mtime_ns, row_number() OVER (ORDER BY mtime_ns DESC, file_id) AS r FROM rows0 WHERE state = 'pending' AND (next_attempt_at IS NULL OR next_attempt_at <= {_NOW}) AND root IN (SELECT root FROM ok)),
a AS (SELECT file_id, 'release' AS action, 0 AS ord, mtime_ns FROM o WHERE NOT kept
  UNION ALL SELECT file_id, 'extract', 1, mtime_ns FROM (SELECT *, row_number() OVER (ORDER BY mtime_ns DESC, file_id) AS r FROM o WHERE kept AND hold = 'ready'), n WHERE r <= greatest(0, 100000 - flying)
  UNION ALL SELECT file_id, 'look', 2, mtime_ns FROM o WHERE kept AND hold IN ('watching', 'deferred') AND at_s <= {_NOW}
  UNION ALL SELECT file_id, 'look', 3, mtime_ns FROM (SELECT np.*, row_number() OVER (ORDER BY r) AS q FROM np, n WHERE held - flying < 1024 AND r <= held + least(256, 1024 - (held - flying)) AND file_id NOT IN (SELECT file_id FROM o WHERE kept)), n WHERE q <= greatest(0, 1024 - (held - flying)))
SELECT file_id, action, row_number() OVER (ORDER BY ord, mtime_ns DESC, file_id) AS place FROM a""")
def schedule_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, i = rows(spark, sf_dir), F.col("file_id")
    held = f.filter("file_id % 25 < 4").select("file_id", F.element_at(F.array(*[F.lit(x) for x in _HOLDS]), (i % 4 + 1).cast("int")).alias("hold"), (F.lit(_NOW) + i % 7 - 3).alias("at_s"))
    return reconcile.scheduled(f, held, t.roots(spark, sf_dir), _NOW, 100_000)


@register("recover_roots", f"WITH {ROWS_SQL} SELECT p.root, r.status AS was, p.status, p.enabled AND r.status NOT IN ('ok', 'watch_failed') AND p.probe = 'ok' AS scan FROM rp p JOIN roots r USING (root)")
def recover_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = roots(spark, sf_dir)
    back = reconcile.recovered(r).withColumn("scan", F.lit(True))
    now = reconcile.probed(r).select("root", "status")
    return r.select("root", F.col("status").alias("was")).join(now, "root").join(back, "root", "left").select("root", "was", "status", F.coalesce("scan", F.lit(False)).alias("scan"))


@register("root_of_path", f"WITH {ROWS_SQL}, p AS (SELECT CASE WHEN file_id % 5 = 0 THEN 'else/' || path ELSE path END AS path FROM files) SELECT p.path, max(r.root) AS root FROM p LEFT JOIN roots r ON p.path = r.root OR starts_with(p.path, r.root || '/') GROUP BY 1")
def root_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.files(spark, sf_dir).select(F.when(F.col("file_id") % 5 == 0, F.concat(F.lit("else/"), F.col("path"))).otherwise(F.col("path")).alias("path"))
    return reconcile.root_of(p, t.roots(spark, sf_dir)).select("path", "root")


@register("file_details", f"WITH {ROWS_SQL}, {t.CHUNKS_SQL} SELECT f.file_id, f.path, f.size, (SELECT max(page) FROM chunks c WHERE c.file_id = f.file_id) AS pages FROM files f")
def file_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = index(spark, sf_dir)
    return presentation.details(store.files, store.chunks, store.files).select("file_id", "path", "size", "pages")


@register("permissions_report", f"WITH {t.ROOTS_SQL} SELECT root, status FROM roots WHERE enabled AND status <> 'ok'")
def permissions_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presentation.permissions(t.roots(spark, sf_dir))


@register("root_remove", f"WITH {ROWS_SQL}, {t.CHUNKS_SQL} SELECT (SELECT count(*) FROM roots WHERE root <> 'src1') AS roots, (SELECT count(*) FROM files WHERE root <> 'src1') AS files, (SELECT count(*) FROM chunks JOIN files USING (file_id) WHERE root <> 'src1') AS chunks, (SELECT count(*) FROM roots WHERE enabled AND root <> 'src2') AS enabled")
def root_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One root removed with all under it; another switched off."""
    store = index(spark, sf_dir, words=False)
    left = presentation.root_removed(store.roots, "src1", store.files, store.chunks)
    counts = [df.agg(F.count(F.lit(1)).alias(n)) for n, df in zip(("roots", "files", "chunks"), left, strict=True)]
    enabled = presentation.root_enabled(store.roots, "src2", False).agg(F.count_if("enabled").alias("enabled"))
    parts = [c.select(F.lit(n).alias("name"), F.col(n).alias("n")) for n, c in zip(("roots", "files", "chunks", "enabled"), [*counts, enabled], strict=True)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in ("roots", "files", "chunks", "enabled")])


@register("clear_index", f"WITH {t.ROOTS_SQL} SELECT 0 AS files, 0 AS chunks, count(*) AS roots FROM roots")
def clear_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty index: no files and nothing derived from them; roots stay."""
    store = index(spark, sf_dir)
    files, chunks = reconcile.without(store.files, store.files, store.chunks)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    every = n(files, "files").unionByName(n(chunks, "chunks")).unionByName(n(store.roots, "roots"))
    return every.agg(*[F.max(F.when(F.col("name") == x, F.col("n"))).alias(x) for x in ("files", "chunks", "roots")])


@register("ui_fold", f"""{sq.ALL_SQL}, p AS (SELECT query_id, strength, row_number() OVER (PARTITION BY query_id ORDER BY strength = 'weak', rank) AS pos FROM answer),
s AS (SELECT query_id, count(*) AS n, coalesce(min(pos) FILTER (WHERE strength = 'weak') - 1, count(*)) AS strong FROM p GROUP BY 1) SELECT query_id, strong, n - strong AS weak, strong = 0 AS weak_open, CASE WHEN strong = 0 THEN n ELSE strong END AS shown FROM s""")
def ui_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presentation.shown_state(sq.QUERIES["fold_strong_first"](spark, sf_dir))


@register("hints", """WITH f AS (SELECT p_partkey AS id, p_partkey % 5 AS results, p_partkey AS k FROM part)
SELECT id, CASE WHEN results >= 3 THEN NULL WHEN k % 2 = 0 AND k % 7 <> 0 THEN 'downloading' WHEN k % 3 = 0 AND k % 11 <> 0 AND k % 4 > 0 THEN 'updating' WHEN k % 7 <> 0 THEN 'offer' END AS kind,
 CASE WHEN results >= 3 THEN NULL WHEN k % 2 = 0 AND k % 7 <> 0 THEN 'text' WHEN k % 3 = 0 AND k % 11 <> 0 AND k % 4 > 0 THEN 'image' WHEN k % 7 <> 0 THEN 'text' END AS feature FROM f""")
def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    feature = lambda name, installed, enabled, downloading, left, dismissed: F.struct(F.lit(name).alias("name"), installed.alias("installed"), enabled.alias("enabled"), downloading.alias("downloading"), left.alias("left"), dismissed.alias("dismissed"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0).cast("long")
    features = F.array(feature("text", no, no, k % 2 == 0, zero, k % 7 == 0), feature("image", yes, yes, no, F.when(k % 3 == 0, k % 4).otherwise(0).cast("long"), k % 11 == 0))
    p = t.read(spark, sf_dir, "part").select(k.alias("id"), presentation.hint(k % 5, features).alias("h"))
    return p.select("id", "h.kind", "h.feature")


@register("payload_limits", r"""WITH s AS (SELECT conv_id, list({'id': CASE WHEN conv_id % 9 = 0 THEN 'x' ELSE turn::VARCHAR END, 'text': repeat(coalesce(text, ''), CASE WHEN conv_id % 4 = 0 THEN 400 ELSE 1 END)} ORDER BY turn) AS src FROM conversations GROUP BY 1),
q AS (SELECT conv_id, src, CASE WHEN conv_id % 10 = 3 THEN ' ' WHEN conv_id % 10 = 4 THEN repeat('q', 501) ELSE 'why' END AS question FROM s)
SELECT conv_id, CASE WHEN trim(question) = '' THEN 'bad_request' WHEN length(question) > 500 THEN 'question_too_long' WHEN len(src) > 5 THEN 'too_many_sources'
 WHEN len(list_filter(src, lambda x: length(x.text) > 60000)) > 0 THEN 'source_too_long' WHEN list_sum(list_transform(src, lambda x: length(x.text))) > 120000 THEN 'sources_too_long'
 WHEN len(list_distinct(list_transform(src, lambda x: x.id))) < len(src) THEN 'bad_request' END AS fault FROM q""")
def payload_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.read(spark, sf_dir, "conversations")
    own = F.struct("turn", F.when(F.col("conv_id") % 9 == 0, "x").otherwise(F.col("turn").cast("string")).alias("id"), F.lit("f").alias("file_name"), F.expr("repeat(coalesce(text, ''), CASE WHEN conv_id % 4 = 0 THEN 400 ELSE 1 END)").alias("text"))
    q = F.when(F.col("conv_id") % 10 == 3, " ").when(F.col("conv_id") % 10 == 4, F.expr("repeat('q', 501)")).otherwise("why")
    p = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("sources")).withColumn("question", q)
    return presentation.payload_fault(p).select("conv_id", "fault")


@register("rerank_documents", f"WITH {t.FILES_SQL}, {t.CHUNKS_SQL}, d AS (SELECT file_id, string_agg(text, chr(10) ORDER BY ordinal) AS text FROM chunks WHERE source <> 'filename' GROUP BY 1) SELECT f.file_id, md5(substr(f.file_name || CASE WHEN d.text IS NULL THEN '' ELSE chr(10) || d.text END, 1, 1500)) AS digest FROM files f LEFT JOIN d USING (file_id)")
def rerank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = index(spark, sf_dir)
    return embed.rerank_documents(store.files, store.chunks).select("file_id", F.md5("document").alias("digest"))


@register("quota_refund", """WITH u AS (SELECT user_id AS account, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_id % 2 = 0) AS back FROM events GROUP BY ALL), m AS (SELECT max(day) - 7 AS d FROM u)
SELECT account, CAST(day AS VARCHAR) AS day, greatest(n - 2 * back, 0) AS count FROM u, m WHERE day >= d""")
def quota_refund(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the last days, less what was given back (here twice for every second question)."""
    e = t.read(spark, sf_dir, "events").select(F.col("user_id").alias("account"), F.to_date("ts").cast("string").alias("day"), "event_id")
    usage = e.groupBy("account", "day").agg(F.count(F.lit(1)).alias("count"))
    back = e.filter("event_id % 2 = 0").select("account", "day")
    today = e.agg(F.date_sub(F.max(F.to_date("day")), 7).cast("string")).first()[0]
    return lifecycle.purged(lifecycle.refunded(usage, back.unionByName(back)), today).select("account", "day", "count")


_H = "('0x' || substr(md5(file_id::VARCHAR), 1, 7))::INT"


@register("renamed_corpus", f"""WITH {t.FILES_SQL}, h AS (SELECT file_id, {_H} AS h, md5(file_id::VARCHAR) AS m FROM files)
SELECT file_id, CASE h % 4 WHEN 0 THEN 'IMG_' || lpad((h % 10000)::VARCHAR, 4, '0') || '.txt' WHEN 1 THEN substr(m, 1, 12) || '.txt'
  WHEN 2 THEN substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) || '.txt' ELSE ['document', 'scan', 'untitled', 'file'][h // 4 % 4 + 1] || ' (' || (h % 90 + 1)::VARCHAR || ').txt' END AS name FROM h""")
def renamed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files under names that say nothing of them: of cameras, hashes, UUIDs and generic ones, always the same."""
    return t.files(spark, sf_dir).select("file_id", lifecycle.uninformative_name(F.col("file_id")).alias("name"))


@register("meta_values", "WITH e AS (SELECT event_type AS key, event_id, value FROM events), l AS (SELECT key, max_by(value, event_id) AS value FROM e GROUP BY 1) SELECT key, CAST(CASE WHEN key = (SELECT min(key) FROM l) THEN 'set' ELSE round(value, 4)::VARCHAR END AS VARCHAR) = 'set' AS was_set FROM l")
def meta_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and their last values as a map, one of them set anew."""
    e = t.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.max_by(F.round("value", 4).cast("string"), "event_id").alias("value"))
    meta = lifecycle.meta_set(lifecycle.meta_of(e), F.array_min(F.map_keys("meta")), F.lit("set"))
    return meta.select(F.explode("meta").alias("key", "value")).select("key", (F.col("value") == "set").alias("was_set"))


@register("index_status", f"WITH {ROWS_SQL}, c AS (SELECT count(*) FILTER (WHERE state = 'pending' AND enabled AND status IN ('ok', 'watch_failed')) AS pending, count(*) FILTER (WHERE state = 'error') AS errors, count(*) AS files FROM files JOIN roots USING (root)) SELECT pending, errors, files, CASE WHEN pending > 0 THEN 'indexing' ELSE 'idle' END AS state FROM c")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status that is shown: counts, and paused before scanning before indexing before idle."""
    f = t.files(spark, sf_dir).select("root", "state").join(t.roots(spark, sf_dir), "root")
    waiting = (F.col("state") == "pending") & lifecycle.indexable(F.col("enabled"), F.col("status"))
    counts = f.agg(F.count_if(waiting).alias("pending"), F.count_if(F.col("state") == "error").alias("errors"), F.count(F.lit(1)).alias("files"))
    return counts.withColumn("state", presentation.index_state(F.lit(False), F.lit(False), F.col("pending")))

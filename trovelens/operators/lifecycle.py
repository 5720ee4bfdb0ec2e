"""Index state: scans, moves, queue, retries, re-queues, status. Pure functions of tables and of a given time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelens.plans.lineage import cut

BACKOFF_S, MOST_ATTEMPTS, LOCKED_CAP = (30, 120, 600), 3, 2
SETTLE_NS, RECHECK_NS, DEFER_NS, SLOP_NS = 3_000_000_000, 1_000_000_000, 5_000_000_000, 2_000_000_000
HOLD_S = 5
TICK_S, JUMP_S, POLL_S = 30, 300, 900
LOW_BYTES, HIGH_BYTES = 1 << 30, (1 << 30) + (1 << 28)


def micros(ts: Column) -> Column:
    """Microseconds of a time with or without zone, for differences."""
    return F.unix_micros(ts.cast("timestamp"))


def readable(status: Column) -> Column:
    return status.isin("ok", "watch_failed")


def indexable(enabled: Column, status: Column) -> Column:
    return enabled & readable(status)


def unchanged_on_disk(a: str, b: str, columns: tuple[str, ...] = ("pipeline_version", "root", "size", "mtime_ns")) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def keeps(stored: str, fresh: str, version: int) -> Column:
    """Whether a stored row stays as it is: current, no error, and either the same bytes (not skipped) or unread alike."""
    s, f = (lambda c: F.col(f"{stored}_{c}")), (lambda c: F.col(f"{fresh}_{c}"))
    same_bytes = s("content_hash").isNotNull() & (s("content_hash") == f("content_hash")) & s("skip_reason").isNull() & f("skip_reason").isNull()
    unread = f("content_hash").isNull() & s("content_hash").isNull() & (s("kind") == f("kind")) & s("skip_reason").eqNullSafe(f("skip_reason"))
    return (s("pipeline_version") == version) & s("error").isNull() & F.coalesce(same_bytes | unread, F.lit(False))


def scan_diff(walk: DataFrame, stored: DataFrame) -> DataFrame:
    """path and outcome (inserted, changed, unchanged, unseen) of a walk (path, size, mtime_ns) against stored rows."""
    w, s = walk.select("path", "size", "mtime_ns").alias("w"), stored.select("path", "size", "mtime_ns").alias("s")
    rows = w.join(s, F.col("w.path") == F.col("s.path"), "full")
    outcome = F.when(F.col("s.path").isNull(), "inserted").when(F.col("w.path").isNull(), "unseen").when(unchanged_on_disk("w", "s", ("size", "mtime_ns")), "unchanged").otherwise("changed")
    return rows.select(F.coalesce("w.path", "s.path").alias("path"), outcome.alias("outcome"))


def moves(new: DataFrame, vanished: DataFrame) -> DataFrame:
    """(path, file_id): new paths that are vanished rows elsewhere, by size, kind and content, one to one in path and id order.

    Contents are only compared where a size and kind meet; new has a hash for these alone.
    """
    key = ["size", "kind", "content_hash"]
    n = new.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("path")))
    v = vanished.filter(F.col("content_hash").isNotNull()).withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("file_id")))
    return n.join(v.select(*key, "nth", "file_id"), [*key, "nth"]).select("path", "file_id")


def next_pending(files: DataFrame, roots: DataFrame, now_s: int, limit: int) -> DataFrame:
    """The newest pending files of indexable roots whose retry time has come."""
    usable = roots.filter(indexable(F.col("enabled"), F.col("status"))).select("root")
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now_s)
    return files.filter((F.col("state") == "pending") & due).join(usable, "root", "left_semi").orderBy(F.desc("mtime_ns"), "file_id").limit(limit)


def after_failure(files: DataFrame, now_s: int, when: Column | None = None) -> DataFrame:
    """attempts, state and next_attempt_at after one more failure (of the rows where ``when`` holds); locked files never give up."""
    when = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    attempts = F.when(F.col("locked"), F.least(F.col("attempts") + 1, F.lit(LOCKED_CAP))).otherwise(F.col("attempts") + 1)
    rows = files.withColumn("_failed", when).withColumn("attempts", F.when(when, attempts).otherwise(F.col("attempts")).cast("long"))
    over = F.col("attempts") >= MOST_ATTEMPTS
    wait = F.when(F.col("attempts") <= 1, BACKOFF_S[0]).when(F.col("attempts") == 2, BACKOFF_S[1]).otherwise(BACKOFF_S[2])
    before = {c: F.col(c) if c in files.columns else F.lit(None) for c in ("state", "next_attempt_at")}
    rows = rows.withColumn("state", F.when(F.col("_failed"), F.when(over, "error").otherwise("pending")).otherwise(before["state"]))
    return rows.withColumn("next_attempt_at", F.when(F.col("_failed"), F.when(~over, F.lit(now_s).cast("long") + wait)).otherwise(before["next_attempt_at"])).drop("_failed")


def state_counts(files: DataFrame, roots: DataFrame) -> DataFrame:
    """state, n; pending counts only files of indexable roots."""
    rows = files.join(roots, "root")
    counted = (F.col("state") != "pending") | indexable(F.col("enabled"), F.col("status"))
    return rows.filter(counted).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def errors(files: DataFrame, limit: int) -> DataFrame:
    """file_id, path, code and detail of the newest files in error, by id; what is not known is other and empty."""
    newest = files.filter("state = 'error'").orderBy(F.desc("file_id")).limit(limit)
    return newest.select("file_id", "path", F.coalesce("error_code", F.lit("other")).alias("code"), F.coalesce("error", F.lit("")).alias("detail"))


def requeued(files: DataFrame, stored: dict[str, str], now: dict[str, str]) -> DataFrame:
    """Files to index again after a change of models: another text model takes all, another image or OCR model the images; a model without stored id takes none."""
    changed = {m for m, v in now.items() if m in stored and stored[m] != v}
    take = F.lit("text" in changed) | (F.lit(bool(changed & {"image", "ocr"})) & (F.col("kind") == "image"))
    return files.withColumn("requeue", take).withColumn("pipeline_version", F.when(take, 0).otherwise(F.col("pipeline_version")))


def backfill(files: DataFrame, bit: int, total: int | None = None) -> DataFrame:
    """total, left_over, done for files that lack a feature's bit."""
    left = files.agg(F.count_if(F.col("features_missing").bitwiseAND(bit) != 0).alias("left_over"), F.count(F.lit(1)).alias("n"))
    whole = F.col("n") if total is None else F.lit(total).cast("long")
    return left.select(whole.alias("total"), "left_over", (whole - F.col("left_over")).alias("done"))


def stability(mtime_ns: Column, now_ns: Column, size: Column, previous_size: Column) -> Column:
    """struct(decision, wait_ns): defer a file that is still young or changing, look twice, then extract."""
    past = now_ns - mtime_ns
    age = F.when(past >= 0, past).when(-past < SLOP_NS, F.lit(0).cast("long")).otherwise(F.lit(SETTLE_NS))
    row = lambda d, w: F.struct(F.lit(d).alias("decision"), w.cast("long").alias("wait_ns"))
    return (
        F.when(age < SETTLE_NS, row("defer", F.greatest(SETTLE_NS - age, F.lit(RECHECK_NS))))
        .when(previous_size.isNotNull() & (previous_size != size), row("defer", F.lit(DEFER_NS)))
        .when(previous_size.isNull(), row("watch", F.lit(RECHECK_NS)))
        .otherwise(row("extract", F.lit(0)))
    )


def debounced(events: DataFrame, gap_s: int = 2, span_s: int = 3600) -> DataFrame:
    """One row for each burst of a root's events: root, started, n_events, n_paths; bursts are gap_s seconds apart.

    Bursts are found within spans of a root's time first, so a root with many events is many tasks' work; what is then
    put in one order for a root is a row for each burst of a span.
    """
    at = micros(F.col("ts"))
    spans = cut(events.select("root", "path", "ts", "event_id", at.alias("at"), F.floor(at / (span_s * 1_000_000)).alias("span")))
    order = Window.partitionBy("root", "span").orderBy("at", "event_id")
    new = (F.col("at") - F.lag("at").over(order) >= gap_s * 1_000_000).cast("int")
    rows = cut(spans.withColumn("part", F.sum(F.coalesce(new, F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    parts = rows.groupBy("root", "span", "part").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    by_root = Window.partitionBy("root").orderBy("first")
    apart = (F.col("first") - F.lag("last").over(by_root) >= gap_s * 1_000_000).cast("int")
    bursts = parts.withColumn("burst", F.sum(F.coalesce(apart, F.lit(1))).over(by_root.rowsBetween(Window.unboundedPreceding, 0)))
    known = rows.join(bursts.select("root", "span", "part", "burst"), ["root", "span", "part"])
    return known.groupBy("root", "burst").agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n_events"), F.countDistinct("path").alias("n_paths")).drop("burst")


def held_deletions(events: DataFrame, hold_s: int = HOLD_S) -> DataFrame:
    """file_id, vanished_at of rows to delete: not seen again within hold_s seconds of vanishing."""
    nxt = F.lead("ts").over(Window.partitionBy("file_id").orderBy("ts", "event_id"))
    seen_soon = nxt.isNotNull() & (micros(nxt) - micros(F.col("ts")) <= hold_s * 1_000_000)
    return events.withColumn("_soon", seen_soon).filter((F.col("kind") == "vanished") & ~F.col("_soon")).select("file_id", F.col("ts").alias("vanished_at"))


def poll_reason(gap_s: Column, since_scan_s: Column, interval_hours: int, unwatched: Column) -> Column:
    """clock_jump, interval, poll or null for one tick."""
    interval = interval_hours * 3600
    due = (F.lit(interval) > 0) & (since_scan_s >= interval)
    return F.when(F.abs(gap_s) > JUMP_S, "clock_jump").when(due, "interval").when(unwatched & (since_scan_s >= POLL_S), "poll")


def quota(requests: DataFrame, per_account: int, overall: int) -> DataFrame:
    """request_id, ok, scope for requests of a day in order: first the account's cap, then the day's.

    Only granted requests count, for the account and for the day.
    """
    mine = F.row_number().over(Window.partitionBy("day", "account").orderBy("request_id"))
    rows = cut(requests.select("request_id", "day", "account").withColumn("mine", mine))
    # Granted requests are the day's first ``overall`` among the accounts' first per_account ones; only so many are put in one order.
    fits = rows.filter(F.col("mine") <= per_account)
    first = fits.withColumn("taken", F.row_number().over(Window.partitionBy("day").orderBy("request_id"))).filter(F.col("taken") <= overall)
    granted = first.select("request_id", "day", "account", F.lit(True).alias("ok"))
    last = granted.groupBy("day", "account").agg(F.count(F.lit(1)).alias("used"), F.max("request_id").alias("own_last"))
    out = rows.join(granted.select("request_id", "ok"), "request_id", "left").join(last, ["day", "account"], "left")
    # A refused request finds its account full, or else the day.
    mine_full = (F.coalesce("used", F.lit(0)) >= per_account) & (F.col("request_id") > F.col("own_last")) | (F.lit(per_account) <= 0)
    return out.select("request_id", F.coalesce("ok", F.lit(False)).alias("ok"), F.when(F.col("ok").isNull(), F.when(F.coalesce(mine_full, F.lit(False)), "account").otherwise("global")).alias("scope"))


def refunded(usage: DataFrame, refunds: DataFrame) -> DataFrame:
    """``usage`` (account, day, count) less the refunds (account, day), never below 0."""
    back = refunds.groupBy("account", "day").agg(F.count(F.lit(1)).alias("_back"))
    return usage.join(back, ["account", "day"], "left").withColumn("count", F.greatest(F.col("count") - F.coalesce("_back", F.lit(0)), F.lit(0))).drop("_back")


def purged(usage: DataFrame, today: str) -> DataFrame:
    """``usage`` without earlier days."""
    return usage.filter(F.col("day") >= today)


def pause_reason(user: Column, available: Column, was_low: Column, battery: Column) -> Column:
    """user before low_memory before battery; memory is low under LOW_BYTES, and stays so up to HIGH_BYTES; 0 is unknown."""
    low = (available > 0) & ((available < LOW_BYTES) | (was_low & (available < HIGH_BYTES)))
    return F.when(user, "user").when(low, "low_memory").when(battery, "battery")


GENERIC = ["document", "scan", "untitled", "file"]


def uninformative_name(file_id: Column) -> Column:
    """A name that says nothing of a file: as a camera's, a hash, a UUID or a generic one, by the id's MD5."""
    m = F.md5(file_id.cast("string"))
    h = F.conv(F.substring(m, 1, 7), 16, 10).cast("long")
    uuid = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    generic = F.concat(F.element_at(F.array(*[F.lit(g) for g in GENERIC]), (F.floor(h / 4) % 4 + 1).cast("int")), F.lit(" ("), (h % 90 + 1).cast("string"), F.lit(")"))
    stem = F.when(h % 4 == 0, F.concat(F.lit("IMG_"), F.lpad((h % 10_000).cast("string"), 4, "0"))).when(h % 4 == 1, F.substring(m, 1, 12)).when(h % 4 == 2, uuid).otherwise(generic)
    return F.concat(stem, F.lit(".txt"))


def meta_of(rows: DataFrame) -> DataFrame:
    """One row with ``meta``, the map of (key, value) rows; a few settings of an index."""
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("meta"))


def meta_set(meta: DataFrame, key: Column, value: Column) -> DataFrame:
    """``meta`` with one key set."""
    own = key if isinstance(key, Column) else F.lit(key)
    return meta.withColumn("meta", F.map_concat(F.map_filter("meta", lambda k, v: k != own), F.map_from_arrays(F.array(own), F.array(value))))


@contextmanager
def pool(spark, name: str) -> Iterator[None]:
    """Jobs of this thread in a named scheduler pool, so that searches need not wait for indexing (with spark.scheduler.mode FAIR)."""
    before = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", before)

"""Reconciliation as one batch job: a walk of roots against the stored rows, moves between all of them, deletions last.

``files`` has file_id, root, path, rel_path, file_name, kind, size, mtime_ns, state, content_hash,
pipeline_version, seen_scan_id, attempts, next_attempt_at, error. ``walk`` has root, path, size, mtime_ns,
cloud_only, and content_hash where a move is plausible (``move_candidates`` says where). ``roots`` has
root (its path or name), enabled, status, and probe: what a look at it found now.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelens.operators import lifecycle
from trovelens.operators.extract import kind_of
from trovelens.plans.lineage import cut
from trovelens.plans.skew import numbered

#: The pipeline whose results are current.
PIPELINE = 4


class Reconciled(NamedTuple):
    """files: the rows after the scan; outcomes: path and outcome; unseen: file_id and scan_id of rows that were not found."""

    files: DataFrame
    outcomes: DataFrame
    unseen: DataFrame


def next_scan_id(meta: dict[str, str]) -> int:
    """One more than the last scan's id; ``meta`` is updated."""
    found = meta.get("last_scan_id", "")
    scan = (int(found) if found.isdigit() else 0) + 1
    meta["last_scan_id"] = str(scan)
    return scan


def probed(roots: DataFrame) -> DataFrame:
    """``roots`` after a look at them: status is what ``probe`` says, but ok only replaces a status that can't be read."""
    keep = (F.col("probe") == "ok") & lifecycle.readable(F.col("status"))
    return roots.withColumn("status", F.when(F.col("probe").isNull() | keep, F.col("status")).otherwise(F.col("probe")))


def recovered(roots: DataFrame) -> DataFrame:
    """The enabled roots that could not be read and now can: they are scanned again."""
    return roots.filter(F.col("enabled") & ~lifecycle.readable(F.col("status")) & (F.col("probe") == "ok")).select("root")


def root_of(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``paths`` (path, ..) with root: the one that a path is or is below, null if none; nested roots don't exist.

    Roots are few; a path is joined by its beginnings, so nothing is compared with every root.
    """
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    own = paths.select("path").distinct().select("path", F.explode(heads).alias("root")).join(roots.select("root"), "root")
    return paths.join(own.groupBy("path").agg(F.max("root").alias("root")), "path", "left")


def move_candidates(walk: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries of ``walk`` that may be moved files and so are worth reading: unknown, not in the cloud, of a vanished row's size and kind."""
    new = walk.join(files.select("path"), "path", "left_anti").filter(~F.coalesce("cloud_only", F.lit(False)))
    return new.withColumn("kind", kind_of(F.col("path"))).join(_homeless(walk, files, roots).select("size", "kind").distinct(), ["size", "kind"], "left_semi")


def _homeless(walk: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """Hashed rows of indexable roots whose path the walk did not find."""
    usable = roots.filter(lifecycle.indexable(F.col("enabled"), F.col("status"))).select("root")
    return files.filter("content_hash IS NOT NULL").join(usable, "root", "left_semi").join(walk.select("path"), "path", "left_anti")


def reconcile(files: DataFrame, walk: DataFrame, roots: DataFrame, scan_id: int, stopped: list[str] | None = None, paths: DataFrame | None = None) -> Reconciled:
    """Bring the rows of all scanned roots in line with a walk of them.

    Unknown files are moved rows (same size, kind and bytes, one to one in path and id order, between any
    roots) or new pending rows; rows whose size, time, root or pipeline differ are queued again; all others
    are marked seen. Rows that were not found are returned, not deleted. Roots that are off, can't be
    read now, or whose walk was ``stopped`` keep their rows as they are. With ``paths`` (path) only what is at
    or below these is scanned, unless one of them is a root: then all is.
    """
    scanned = roots.filter(F.col("enabled") & (F.coalesce("probe", F.lit("ok")) == "ok") & (~F.col("root").isin(stopped) if stopped else F.lit(True))).select("root")
    walk = walk.join(scanned, "root", "left_semi")
    if paths is not None and paths.join(scanned, paths["path"] == scanned["root"], "left_semi").isEmpty():
        walk = under(walk, paths)
    else:
        paths = None
    walk = cut(walk.withColumn("kind", kind_of(F.col("path"))))
    new = walk.join(files.select("path"), "path", "left_anti").filter(~F.coalesce("cloud_only", F.lit(False)) & F.col("content_hash").isNotNull())
    found = cut(lifecycle.moves(new.select("path", "size", "kind", "content_hash"), _gone(files, walk, roots, paths)).select(F.col("path").alias("to"), "file_id"))
    entries = walk.join(found, walk["path"] == found["to"], "left").select(*[F.col(c).alias(f"w_{c}") for c in ("root", "path", "size", "mtime_ns", "kind")], F.col("file_id").alias("moved_id"))
    rows = files.join(found.select("file_id", "to"), "file_id", "left")
    rows = rows.join(entries, F.coalesce("to", "path") == F.col("w_path"), "full")
    same = (F.col("pipeline_version") == PIPELINE) & (F.col("root") == F.col("w_root")) & (F.col("size") == F.col("w_size")) & (F.col("mtime_ns") == F.col("w_mtime_ns"))
    outcome = (
        F.when(F.col("file_id").isNull(), "inserted").when(F.col("to").isNotNull(), "moved").when(F.col("w_path").isNull(), "unseen")
        .when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    )
    rows = cut(rows.withColumn("outcome", outcome))
    is_ = lambda *names: F.col("outcome").isin(*names)
    name = F.element_at(F.split("w_path", "/"), -1)
    last = files.agg(F.max("file_id")).first()[0] or 0
    fresh = numbered(rows.filter("outcome = 'inserted'").select("w_path"), "w_path", "n").select("w_path", (F.lit(last).cast("long") + F.col("n")).alias("new_id"))
    rows = rows.join(fresh, "w_path", "left")
    queued = F.when(is_("inserted", "changed"), "pending").when(is_("moved") & (F.col("state") == "indexing"), "pending").otherwise(F.col("state"))
    took = is_("inserted", "moved")
    out = rows.select(
        F.coalesce("new_id", "file_id").alias("file_id"), F.when(is_("unseen"), F.col("root")).otherwise(F.col("w_root")).alias("root"),
        F.when(took, F.col("w_path")).otherwise(F.col("path")).alias("path"),
        F.when(took, relative(F.col("w_path"), F.col("w_root"))).otherwise(F.col("rel_path")).alias("rel_path"),
        F.when(took, name).otherwise(F.col("file_name")).alias("file_name"), F.coalesce("kind", "w_kind").alias("kind"),
        F.when(is_("unseen"), F.col("size")).otherwise(F.col("w_size")).alias("size"), F.when(is_("unseen"), F.col("mtime_ns")).otherwise(F.col("w_mtime_ns")).alias("mtime_ns"),
        queued.alias("state"), "content_hash", F.coalesce("pipeline_version", F.lit(0)).alias("pipeline_version"),
        F.when(is_("unseen"), F.col("seen_scan_id")).otherwise(F.lit(scan_id)).cast("long").alias("seen_scan_id"),
        F.when(is_("changed", "inserted"), 0).otherwise(F.col("attempts")).cast("long").alias("attempts"), F.when(is_("changed"), None).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"), "error",
    )
    left = rows.filter("outcome = 'unseen'").join(scanned, "root", "left_semi")
    if paths is not None:
        left = under(left, paths)
    outcomes = rows.filter("outcome <> 'unseen'").select(F.col("w_path").alias("path"), "outcome").unionByName(left.select("path", "outcome"))
    return Reconciled(out, outcomes, left.select("file_id", F.lit(scan_id).cast("long").alias("scan_id")))


def _gone(files: DataFrame, walk: DataFrame, roots: DataFrame, paths: DataFrame | None) -> DataFrame:
    """Rows that a new path may be: of indexable roots, and not where they were. A scan of paths only knows of what is below these."""
    gone = _homeless(walk, files, roots)
    return (gone if paths is None else under(gone, paths)).select("file_id", "size", "kind", "content_hash")


def relative(path: Column, root: Column) -> Column:
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.expr("substring(w_path, length(w_root) + 2)")).otherwise(path)


def under(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows whose path is one of ``paths`` or below one, by equality on its beginnings."""
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    own = rows.select("path").distinct().select("path", F.explode(heads).alias("head"))
    return rows.join(own.join(paths.select(F.col("path").alias("head")).distinct(), "head", "left_semi").select("path").distinct(), "path", "left_semi")


def settled(files: DataFrame, held: DataFrame, now_s: int) -> tuple[DataFrame, DataFrame]:
    """(held, delete): candidates (file_id, scan_id, until_s) that a later scan has not seen, still waiting or due.

    A row that was seen again since (claimed by a move, or there once more), or that is gone, is no candidate.
    """
    still = held.join(files.select("file_id", "seen_scan_id"), "file_id").filter(F.col("seen_scan_id") < F.col("scan_id")).drop("seen_scan_id")
    return still.filter(F.col("until_s") > now_s), still.filter(F.col("until_s") <= now_s).select("file_id")


def without(files: DataFrame, gone: DataFrame, *derived: DataFrame) -> tuple[DataFrame, ...]:
    """``files`` and each table derived from them (file_id, ..) without the rows of the files in ``gone`` (file_id)."""
    return tuple(t.join(gone.select("file_id").distinct(), "file_id", "left_anti") for t in (files, *derived))


def unreferenced(before: DataFrame, after: DataFrame, key: str = "content_hash") -> DataFrame:
    """Keys (of thumbnails, which go by content) that no row has any more."""
    return before.filter(F.col(key).isNotNull()).select(key).distinct().join(after.select(key), key, "left_anti")


def renamed_chunks(chunks: DataFrame, files: DataFrame, moved: DataFrame) -> DataFrame:
    """``chunks`` whose file moved (file_id) with the text of their name chunk after the new name; all others, and vectors, stay."""
    from trovelens.functions.text import name_words

    new = files.join(moved.select("file_id").distinct(), "file_id", "left_semi").select("file_id", name_words(F.col("rel_path")).alias("_name"))
    rows = chunks.join(new, "file_id", "left")
    return rows.withColumn("text", F.when((F.col("source") == "filename") & F.col("_name").isNotNull(), F.col("_name")).otherwise(F.col("text"))).drop("_name")


# The life of a row: steps that writers apply. A result counts only if the row is still being worked on.


def applied(files: DataFrame, steps: DataFrame, now_s: int, alone: bool = False) -> DataFrame:
    """``files`` after one step for each (file_id, step, and what it brings), with done: what is counted, or null.

    start: pending becomes indexing. store: the row's new state, hash, error and pipeline. keep: only size, time and
    state. retry: one more failure, see ``lifecycle.after_failure``. delete: the row goes. A store or keep for a row
    that is no longer indexing is dropped (with ``alone`` there is only one writer and nothing is).
    """
    s = steps.select("file_id", "step", *[F.col(c).alias(f"n_{c}") for c in ("state", "size", "mtime_ns", "content_hash", "error", "locked")])
    rows = files.join(s, "file_id", "left")
    late = F.col("step").isin("store", "keep") & (F.col("state") != "indexing") & F.lit(not alone)
    step = F.when(late, None).otherwise(F.col("step"))
    failed = lifecycle.after_failure(rows.withColumn("locked", F.coalesce("n_locked", F.lit(False))).withColumn("step", step), now_s, when=F.col("step") == "retry")
    is_ = lambda *names: F.coalesce(F.col("step").isin(*names), F.lit(False))
    out = failed.filter(~is_("delete"))
    settled_ = is_("store", "keep")
    return out.select(
        *[c for c in files.columns if c not in ("state", "size", "mtime_ns", "content_hash", "error", "pipeline_version", "attempts", "next_attempt_at")],
        F.when(is_("start"), "indexing").when(settled_, F.col("n_state")).otherwise(F.col("state")).alias("state"),
        *[F.when(settled_, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("size", "mtime_ns")],
        F.when(is_("store"), F.col("n_content_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(is_("store", "retry"), F.col("n_error")).otherwise(F.col("error")).alias("error"),
        F.when(is_("store"), PIPELINE).otherwise(F.col("pipeline_version")).alias("pipeline_version"),
        F.when(settled_, 0).otherwise(F.col("attempts")).cast("long").alias("attempts"), F.when(settled_, None).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"),
        F.when(is_("store"), F.col("n_state")).when(is_("keep"), "unchanged").when(is_("retry"), F.when(F.col("state") == "error", "error").otherwise("retried")).alias("done"),
    )


def touched(files: DataFrame, looks: DataFrame) -> DataFrame:
    """Rows that were looked at (file_id, size, mtime_ns, state) and are still right: nothing else changes, failures are forgotten."""
    n = looks.select("file_id", *[F.col(c).alias(f"n_{c}") for c in ("size", "mtime_ns", "state")], F.lit(True).alias("_seen"))
    rows = files.join(n, "file_id", "left")
    for c in ("size", "mtime_ns", "state"):
        rows = rows.withColumn(c, F.coalesce(f"n_{c}", c))
    rows = rows.withColumn("attempts", F.when(F.col("_seen"), 0).otherwise(F.col("attempts"))).withColumn("next_attempt_at", F.when(F.col("_seen"), None).otherwise(F.col("next_attempt_at")))
    return rows.select(*files.columns)


def _queued(files: DataFrame, which: Column, failures: bool = True) -> DataFrame:
    out = files.withColumn("_q", which).withColumn("state", F.when(F.col("_q"), "pending").otherwise(F.col("state")))
    if failures:
        out = out.withColumn("attempts", F.when(F.col("_q"), 0).otherwise(F.col("attempts"))).withColumn("next_attempt_at", F.when(F.col("_q"), None).otherwise(F.col("next_attempt_at")))
    return out.drop("_q")


def reset_after_crash(files: DataFrame) -> DataFrame:
    """Nothing works on what a crash left indexing: it is pending again, its failures as they were."""
    return _queued(files, F.col("state") == "indexing", failures=False)


def retry_errors(files: DataFrame) -> DataFrame:
    """Every file in error is pending again without failures; the error stays until a result replaces it."""
    return _queued(files, F.col("state") == "error")


def invalidate(files: DataFrame, kind: str | None = None) -> DataFrame:
    """All files, or those of one kind, are to be read anew: pending, of no pipeline."""
    which = F.lit(True) if kind is None else F.col("kind") == kind
    return _queued(files.withColumn("pipeline_version", F.when(which, 0).otherwise(F.col("pipeline_version"))), which)


MOST_WAITING, FETCH_SLACK = 1024, 256


def scheduled(files: DataFrame, held: DataFrame, roots: DataFrame, now_s: int, most_in_flight: int) -> DataFrame:
    """file_id, action (extract, look, release) and place of one poll of the scheduler.

    ``held`` has file_id, hold (in_flight, ready, watching, deferred) and at_s: when it is looked at again. Waiting
    files of roots that are not indexable are released. Ready ones come first, newest first, as far as there is
    room in flight; then those that are due, newest first; then new pending ones, newest first, as long as few wait.
    """
    usable = roots.filter(lifecycle.indexable(F.col("enabled"), F.col("status"))).select("root", F.lit(True).alias("_usable"))
    own = held.join(files.select("file_id", "root", "mtime_ns"), "file_id", "left").join(usable, "root", "left")
    own = cut(own.withColumn("kept", (F.col("hold") == "in_flight") | F.coalesce("_usable", F.lit(False))))
    n = own.agg(F.count_if("kept").alias("held"), F.count_if(F.col("hold") == "in_flight").alias("flying")).first()
    room, waiting = max(0, most_in_flight - n["flying"]), n["held"] - n["flying"]
    ready = own.filter("kept AND hold = 'ready'").orderBy(F.desc("mtime_ns"), "file_id").limit(room)
    due = own.filter(F.col("kept") & F.col("hold").isin("watching", "deferred") & (F.col("at_s") <= now_s))
    fetch = n["held"] + min(FETCH_SLACK, MOST_WAITING - waiting) if waiting < MOST_WAITING else 0
    new = lifecycle.next_pending(files, roots, now_s, fetch).join(own.filter("kept").select("file_id"), "file_id", "left_anti")
    new = new.orderBy(F.desc("mtime_ns"), "file_id").limit(max(0, MOST_WAITING - waiting))
    act = lambda df, action, order: df.select("file_id", F.lit(action).alias("action"), F.lit(order).alias("o"), "mtime_ns")
    every = act(own.filter("NOT kept"), "release", 0).unionByName(act(ready, "extract", 1)).unionByName(act(due, "look", 2)).unionByName(act(new, "look", 3))
    # A poll hands out a bounded number of rows; numbering them is one task's work.
    return every.select("file_id", "action", F.row_number().over(Window.orderBy("o", F.desc("mtime_ns"), "file_id")).cast("long").alias("place"))

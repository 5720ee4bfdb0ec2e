"""Folders as tables of entries, labelled queries as tables."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from trovelens.operators.extract import BUNDLES, EXCLUDED, glob_pattern

ENTRY = "root string, path string, rel_path string, size long, mtime_ns long, is_dir boolean, cloud_only boolean"
#: Entries that are handed on at once.
WALKED = 10_000
QUERY = "query string, lang string, expected array<string>, ignore array<string>, fresh boolean, notes string"


def _entered(root: str, e: os.DirEntry, hidden: bool, globs: list[str] | None) -> bool:
    """Whether a walk of ``root`` goes into an entry right below it."""
    out = any(re.match(glob_pattern(g), e.name + end, re.S) for g in (EXCLUDED if globs is None else globs) for end in ("", "/"))
    bundle = any(e.name.lower().endswith(b) for b in BUNDLES)
    return not (not hidden and e.name.startswith(".") or e.is_symlink() or out or bundle) and e.is_dir(follow_symlinks=False)


def walk_folder(root: str, hidden: bool = False, globs: list[str] | None = None, start: str | None = None) -> Iterator[tuple]:
    """Entries below a folder: files, and bundles as one item each; links are not followed, excluded folders not entered.

    With ``start`` only those below that folder of ``root``; empty: only what is right in ``root`` and no folder.
    """
    patterns = [re.compile(glob_pattern(g), re.S) for g in (EXCLUDED if globs is None else globs)]
    out = lambda rel: any(p.match(rel) or p.match(rel + "/") for p in patterns)
    pending = [os.path.join(root, start) if start else root]
    while pending:
        folder = pending.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            rel = os.path.relpath(e.path, root)
            if not hidden and e.name.startswith(".") or e.is_symlink() or out(rel):
                continue
            is_dir = e.is_dir(follow_symlinks=False)
            bundle = is_dir and any(e.name.lower().endswith(b) for b in BUNDLES)
            if is_dir and not bundle:
                if start != "":
                    pending.append(e.path)
                continue
            s = e.stat(follow_symlinks=False)
            cloud = bool(not is_dir and s.st_size > 0 and getattr(s, "st_flags", 0) & 0x40000000)
            yield root, e.path, rel, 0 if is_dir else s.st_size, s.st_mtime_ns, is_dir, cloud


def walk(spark: SparkSession, roots: list[str], hidden: bool = False, globs: list[str] | None = None) -> DataFrame:
    """Entries of folders that the driver and every executor can see; a task for each folder right below a root."""
    columns = [c.split(" ")[0] for c in ENTRY.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for root, start in zip(f["root"], f["start"], strict=True):
                entries = walk_folder(root, hidden, globs, start)
                while some := list(islice(entries, WALKED)):
                    yield pd.DataFrame(some, columns=columns)

    # Folders right below a root are tasks of their own; the root itself yields its files.
    starts = []
    for root in roots:
        starts.append((root, ""))
        try:
            starts += [(root, e.name) for e in sorted(os.scandir(root), key=lambda e: e.name) if _entered(root, e, hidden, globs)]
        except OSError:
            continue
    table = spark.createDataFrame(starts, "root string, start string").repartition(max(1, len(starts)))
    return table.mapInPandas(run, ENTRY)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """path, size, content of the files below a folder in any store Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.selectExpr("path", "length AS size", "modificationTime AS modified", "content")


def labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries from lines of JSON; blank lines are skipped."""
    return spark.read.schema(QUERY).option("mode", "FAILFAST").json(path)

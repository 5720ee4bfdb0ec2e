"""Snippets, highlights, answer rows, settings, roots and status: what surrounds a search."""

from __future__ import annotations

import re
import unicodedata
from copy import deepcopy

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelens.functions.text import utf16_length
from trovelens.operators.extract import glob_pattern

OPEN, CLOSE, ELLIPSIS = "", "", "..."
WINDOW = 10
SETTINGS = {"indexing", "models", "ui"}
LIMIT_MOST = 500


_TOKEN = re.compile(r"(?:[^\W_]|[\u0300-\u036f])+")
_SENTENCE = re.compile(r"[.:]\s+$")


def _plain(token: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c)).lower()


def phrases_of(query: str) -> list[tuple[list[str], bool]]:
    """The words of a query as phrases of plain tokens, and whether a phrase's last token is a beginning."""
    words = query.split()
    found = [([_plain(t) for t in _TOKEN.findall(w)], k == len(words) - 1) for k, w in enumerate(words)]
    return [(tokens, last) for tokens, last in found if tokens]


def marked_snippet(text: str, query: str, window: int = WINDOW) -> str:
    """The ``window`` tokens of a text that say most of a query, phrases between OPEN and CLOSE, ellipses where text is left out.

    A window that begins where a phrase occurs counts 1000 for each phrase in it and 1 for each further
    occurrence, and is moved so that what it found stands in its middle; one that begins with the sentence
    of the occurrence instead counts 100 more, 120 at the text's beginning. The first of the best is taken.
    """
    spans = [m.span() for m in _TOKEN.finditer(text)]
    plain = [_plain(text[a:b]) for a, b in spans]
    n, found = len(plain), []
    for p, (tokens, last) in enumerate(phrases_of(query)):
        for at in range(n - len(tokens) + 1):
            if all(plain[at + k] == t or (last and k == len(tokens) - 1 and plain[at + k].startswith(t)) for k, t in enumerate(tokens)):
                found.append((at, p, len(tokens)))
    found.sort()
    starts = [k for k in range(n) if k == 0 or _SENTENCE.search(text[spans[k - 1][1] : spans[k][0]])]

    def scored(begin: int) -> tuple[int, int]:
        inside = [(at, p, size) for at, p, size in found if begin <= at < begin + window]
        seen: set[int] = set()
        score = 0
        for _, p, _ in inside:
            score += 1 if p in seen else 1000
            seen.add(p)
        middle = inside[0][0] - (window - (inside[-1][0] + inside[-1][2] - inside[0][0])) // 2 if inside else begin
        return score, max(0, min(middle, n - window))

    best, begin = 0, 0
    for at, _, _ in found:
        score, middle = scored(at)
        if score > best:
            best, begin = score, middle
        sentence = max((k for k in starts if k <= at), default=0)
        if sentence < at:
            score = scored(sentence)[0] + (120 if sentence == 0 else 100)
            if score > best:
                best, begin = score, sentence
    end = min(begin + window, n)
    marks: dict[int, int] = {}  # first token of a mark -> token after its last one
    for at, _, size in found:
        if begin <= at and at + size <= end:
            open_ = next((k for k, stop in marks.items() if at < stop), at)
            marks[open_] = max(marks.get(open_, 0), at + size)
    out, place = [], spans[begin][0] if begin else 0
    for k in sorted(marks):
        a, b = spans[k][0], spans[marks[k] - 1][1]
        out += [text[place:a], OPEN, text[a:b], CLOSE]
        place = b
    out.append(text[place : spans[end - 1][1] if end < n else len(text)])
    return (ELLIPSIS if begin else "") + "".join(out) + (ELLIPSIS if end < n else "")


def snippet(text: Column, query: Column) -> Column:
    """``marked_snippet`` of the rows of an answer: a few for each query."""

    def run(texts: pd.Series, queries: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else marked_snippet(t, q or "") for t, q in zip(texts, queries, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(text, query)


def highlights(marked: Column) -> Column:
    """struct(text, highlights): the text without marks, and the marked byte ranges."""
    parts = F.split(F.regexp_replace(marked, CLOSE, OPEN), OPEN)  # every second part is marked
    sizes = F.transform(parts, lambda p: F.octet_length(p))
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x))
    ranges = F.transform(ends, lambda e, i: F.array(e - F.element_at(sizes, i + 1), e))
    return F.struct(F.array_join(parts, "").alias("text"), F.filter(ranges, lambda r, i: i % 2 == 1).alias("highlights"))


def shown_sources(sources: Column) -> Column:
    """Match sources as a row shows them: semantic only where it is the sole one."""
    return F.when(F.size(sources) > 1, F.filter(sources, lambda s: s != "semantic")).otherwise(sources)


def one_line(text: Column) -> Column:
    """Line breaks as spaces; byte offsets stay."""
    return F.translate(text, "\n\r", "  ")


def hidden_reason(sources: Column) -> Column:
    """Why a row matched when it does not show it: the most specific of ocr, qr, visual and semantic that it has, or null."""
    shown = shown_sources(sources)
    reason = F.lit(None).cast("string")
    for name in ("semantic", "visual", "qr", "ocr"):
        reason = F.when(F.array_contains(shown, name), name).otherwise(reason)
    return reason


def rows(answer: DataFrame, queries: DataFrame) -> DataFrame:
    """The answer of a search as its rows are shown: snippet and highlights, mtime_ms, shown_sources, hidden_reason.

    A keyword hit shows the marked window of its chunk, another one the chunk's first 200 characters, an
    image its name. Line breaks are spaces; the byte ranges of what is marked are the highlights.
    """
    asked = answer.drop("query").join(queries.select("query_id", "query"), "query_id")
    plain = F.coalesce(F.substring("chunk_text", 1, 200), F.col("file_name"))
    asked = asked.withColumn("marked", snippet(F.when(F.col("in_keyword"), F.col("chunk_text")), F.col("query")))
    out = asked.withColumn("h", highlights(F.coalesce("marked", plain))).withColumn("snippet", one_line(F.col("h.text"))).withColumn("highlights", F.col("h.highlights"))
    out = out.withColumn("mtime_ms", F.floor(F.col("mtime_ns") / 1_000_000).cast("long"))
    return out.withColumn("shown_sources", shown_sources(F.col("match_sources"))).withColumn("hidden_reason", hidden_reason(F.col("match_sources"))).drop("h", "marked", "chunk_text")


def limit_of(asked: int | None, configured: int) -> int:
    return min(max(asked if asked is not None else configured, 1), LIMIT_MOST)


def patched(settings: dict, patch: dict) -> dict:
    """Settings with a patch merged in. Only known sections and keys; exclusion globs must compile."""

    def merge(old: dict, new: dict, where: str) -> None:
        for k, v in new.items():
            if k not in old:
                raise KeyError(f"unknown setting {where}{k}")
            if isinstance(old[k], dict) and isinstance(v, dict):
                merge(old[k], v, f"{where}{k}.")
            else:
                old[k] = v

    if extra := set(patch) - SETTINGS:
        raise KeyError(f"not a section that can be changed: {sorted(extra)}")
    out = deepcopy(settings)
    merge(out, patch, "")
    for glob in out.get("indexing", {}).get("exclude_globs", []):
        if glob.count("[") != glob.count("]"):
            raise ValueError(f"not a glob: {glob}")
        glob_pattern(glob)
    return out


def root_added(roots: list[str], path: str) -> tuple[list[str], list[str]]:
    """(roots, collapsed) with ``path`` added: inside a known root it is refused, roots inside it become part of it."""
    path = path.rstrip("/")
    for r in roots:
        if path == r or path.startswith(r + "/"):
            raise ValueError(f"{path} is inside {r}")
    inside = [r for r in roots if r.startswith(path + "/")]
    return [r for r in roots if r not in inside] + [path], inside


def repointed(files: DataFrame, collapsed: list[str], path: str) -> DataFrame:
    """Files of collapsed roots as files of their new root, with paths relative to it."""
    mine = F.col("root").isin(collapsed) if collapsed else F.lit(False)
    return files.withColumn("rel_path", F.when(mine, F.expr(f"substring(path, {len(path) + 2})")).otherwise(F.col("rel_path"))).withColumn("root", F.when(mine, path).otherwise(F.col("root")))


def permissions(roots: DataFrame) -> DataFrame:
    """The enabled roots that are not ok, with their status."""
    return roots.filter(F.col("enabled") & (F.col("status") != "ok")).select("root", "status")


def root_enabled(roots: DataFrame, root: str, enabled: bool) -> DataFrame:
    """``roots`` with one switched; its rows stay, but are not indexed, watched or searched."""
    return roots.withColumn("enabled", F.when(F.col("root") == root, F.lit(enabled)).otherwise(F.col("enabled")))


def root_removed(roots: DataFrame, root: str, files: DataFrame, *derived: DataFrame) -> tuple[DataFrame, ...]:
    """``roots``, ``files`` and the tables derived from them without a root and all that is indexed under it."""
    gone = files.filter(F.col("root") == root).select("file_id")
    return (roots.filter(F.col("root") != root), *[t.join(gone, "file_id", "left_anti") for t in (files, *derived)])


def details(files: DataFrame, chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """file_id, path, size and pages (the largest page of its chunks, or null) of the wanted files (file_id)."""
    own = files.join(wanted.select("file_id").distinct(), "file_id", "left_semi").select("file_id", "path", F.greatest("size", F.lit(0)).alias("size"))
    pages = chunks.join(own.select("file_id"), "file_id", "left_semi").groupBy("file_id").agg(F.max("page").alias("pages"))
    return own.join(pages, "file_id", "left")


def shown_state(hits: DataFrame) -> DataFrame:
    """query_id, strong, weak, weak_open, shown of an answer (query_id, position, strength): with nothing strong the fold is open.

    strong are the hits ahead of the first weak one.
    """
    first_weak = F.min(F.when(F.col("strength") == "weak", F.col("position")))
    by = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), first_weak.alias("w"))
    strong = F.coalesce(F.col("w") - 1, F.col("n"))
    by = by.select("query_id", "n", strong.alias("strong"), (F.col("n") - strong).alias("weak"), (strong == 0).alias("weak_open"))
    return by.select("query_id", "strong", "weak", "weak_open", F.when(F.col("weak_open"), F.col("n")).otherwise(F.col("strong")).alias("shown"))


HINT_BELOW = 3


def hint(results: Column, features: Column) -> Column:
    """struct(kind, feature) for a short list, from features in their order (name, installed, enabled, downloading, left, dismissed).

    Work under way comes before an offer; dismissed features say nothing; lists of HINT_BELOW or more have none.
    """
    open_ = F.filter(features, lambda f: ~f["dismissed"])
    busy = F.filter(open_, lambda f: f["downloading"] | (f["installed"] & f["enabled"] & (f["left"] > 0)))
    offer = F.filter(open_, lambda f: ~(f["enabled"] & f["installed"]))
    made = lambda kind, f: F.struct(kind.alias("kind"), f["name"].alias("feature"))
    first = lambda a: F.try_element_at(a, F.lit(1))
    return (
        F.when(results >= HINT_BELOW, None)
        .when(F.size(busy) > 0, made(F.when(first(busy)["downloading"], "downloading").otherwise("updating"), first(busy)))
        .when(F.size(offer) > 0, made(F.lit("offer"), first(offer)))
    )


def index_state(paused: Column, scanning: Column, pending: Column) -> Column:
    """paused before scanning before indexing before idle."""
    return F.when(paused, "paused").when(scanning, "scanning").when(pending > 0, "indexing").otherwise("idle")


LOW_MEMORY_GB = 8


def low_memory(memory_gb: float) -> bool:
    """Whether models are used sparingly: at most LOW_MEMORY_GB."""
    return memory_gb <= LOW_MEMORY_GB


def unload_minutes(memory_gb: float, configured: int) -> int:
    """Idle minutes until models go: at most 2 with little memory."""
    return min(configured, 2) if low_memory(memory_gb) else configured


# What a question may carry.
QUESTION_UNITS, SOURCES, SOURCE_UNITS, TOTAL_UNITS, NAME_UNITS, ID_UNITS = 500, 5, 60_000, 120_000, 255, 64


def payload_fault(payloads: DataFrame) -> DataFrame:
    """``payloads`` (question, sources: array of (id, file_name, text)) with fault: why one is refused, or null. Lengths are UTF-16 units."""
    q, s = F.col("question"), F.col("sources")
    ids = F.transform(s, lambda x: x["id"])
    bad = F.exists(s, lambda x: x["id"].isNull() | (x["id"] == "") | (utf16_length(x["id"]) > ID_UNITS) | x["file_name"].isNull() | (utf16_length(x["file_name"]) > NAME_UNITS) | x["text"].isNull())
    total = F.aggregate(s, F.lit(0.0), lambda a, x: a + utf16_length(F.coalesce(x["text"], F.lit(""))))
    fault = (
        F.when(q.isNull() | ~q.rlike(r"\S") | s.isNull() | (F.size(s) == 0), "bad_request")
        .when(utf16_length(q) > QUESTION_UNITS, "question_too_long").when(F.size(s) > SOURCES, "too_many_sources")
        .when(bad, "bad_request").when(F.exists(s, lambda x: utf16_length(x["text"]) > SOURCE_UNITS), "source_too_long").when(total > TOTAL_UNITS, "sources_too_long")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "bad_request")
    )
    return payloads.withColumn("fault", fault)


def workers(cores: int, memory_gb: float) -> int:
    """min(cores / 2, GB / 4), from 1 to 4."""
    return max(1, min(4, cores // 2, int(memory_gb // 4)))


def cited(sent: Column, reply: Column) -> Column:
    """The ids a reply cites: only those that were sent, each once, in the reply's order."""
    return F.array_distinct(F.filter(reply, lambda r: F.array_contains(sent, r)))

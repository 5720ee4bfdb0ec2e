"""Passages for question answering: ranking in a file, budgets, picking, whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, SEPARATOR, LEAST_LEFT = 60, 2, 200
PASSAGE_TOTAL, PASSAGE_LEAST, PASSAGE_MOST = 8000, 1200, 4000
OVERLAP_BYTES, WHOLE_FILE, WHOLE_TOTAL, CANDIDATES = 2000, 60_000, 120_000, 5000
#: Files whose texts are Python objects at once.
BATCH_FILES = 500


def budget(n_files: Column) -> Column:
    """Units for each file: a share of PASSAGE_TOTAL within its bounds."""
    return F.least(F.greatest(F.floor(F.lit(PASSAGE_TOTAL) / F.greatest(n_files, F.lit(1))), F.lit(PASSAGE_LEAST)), F.lit(PASSAGE_MOST)).cast("long")


def ranked(passages: DataFrame, terms: str, similarity: str) -> DataFrame:
    """score and place of passages (file_id, ordinal, text): RRF, ranks from 0, of the number of terms contained (over 0 only) and of meaning."""
    hits = F.size(F.filter(F.col(terms), lambda t: F.lower(F.col("text")).contains(t)))
    rows = passages.withColumn("hits", hits)
    by_file = Window.partitionBy("file_id")
    words = F.row_number().over(by_file.orderBy(F.desc("hits"), "ordinal")) - 1
    meaning = F.row_number().over(by_file.orderBy(F.desc_nulls_last(similarity), "ordinal")) - 1
    rows = rows.withColumn("k", words).withColumn("m", meaning)
    score = F.when(F.col("hits") > 0, 1 / (F.lit(RRF_K) + F.col("k"))).otherwise(0.0) + F.when(F.col(similarity).isNotNull(), 1 / (F.lit(RRF_K) + F.col("m"))).otherwise(0.0)
    rows = rows.withColumn("score", F.round(score, 9))
    return rows.withColumn("place", F.row_number().over(by_file.orderBy(F.desc("score"), "ordinal")).cast("long"))


def utf16(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2


def clip(text: str, units: int) -> str:
    """The longest beginning of at most ``units`` UTF-16 units that ends between characters."""
    return text.encode("utf-16-le")[: 2 * units].decode("utf-16-le", "ignore")


def pick(passages: list[tuple[int, str]], most: int) -> list[tuple[int, str]]:
    """Passages (ordinal, text) in rank order, trimmed, taken until the budget is used; in ordinal order.

    One that would be cut to less than LEAST_LEFT ends it, unless nothing is taken yet.
    """
    used, out = 0, []
    for ordinal, text in passages:
        gap, text = SEPARATOR if out else 0, text.strip()
        left = max(0, most - used - gap)
        if out and left < LEAST_LEFT and utf16(text) > left:
            break
        text = clip(text, left)
        if not text:
            continue
        used += gap + utf16(text)
        out.append((ordinal, text))
        if used >= most:
            break
    return sorted(out)


def by_file(rows: DataFrame, order: str, columns: list[str], one: Callable[[list[dict]], tuple], schema: str) -> DataFrame:
    """file_id and what ``one`` makes (``schema``) of each file's rows (``columns``) in their order; many files are one batch, not a call each."""
    listed = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias("rows"))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_ in batches:
            for at in range(0, whole_.num_rows, BATCH_FILES):
                ids, files = whole_.slice(at, BATCH_FILES).columns
                made = zip(*[one(f) for f in files.to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(list(x)) for x in made]], names=["file_id", *names])

    return listed.mapInArrow(run, f"file_id {listed.schema['file_id'].dataType.simpleString()}, {schema}")


def picked(ranked_passages: DataFrame, most: int) -> DataFrame:
    """file_id, n_passages, units, text of what is sent of each file; a file's first most/1 candidates are read in rank order."""

    def one(f: list[dict]) -> tuple:
        got = pick([(r["ordinal"], r["text"]) for r in f], most)
        text = "\n\n".join(t for _, t in got)
        return len(got), utf16(text), text

    return by_file(ranked_passages, "place", ["ordinal", "text"], one, "n_passages long, units long, text string")


def overlap(before: str, text: str) -> int:
    """How much of ``text``'s beginning, at word bounds, ``before`` ends with: OVERLAP_BYTES bytes at most."""
    sizes = [0]
    for c in text[:OVERLAP_BYTES]:  # a character is a byte at least
        sizes.append(sizes[-1] + len(c.encode()))
    limit = min(sizes[-1], len(before.encode()), OVERLAP_BYTES)
    for n in range(len(sizes) - 1, 0, -1):
        if sizes[n] <= limit and before.endswith(text[:n]) and (n == len(text) or text[n].isspace()) and (n == len(before) or before[-n - 1].isspace()):
            return n
    return 0


def whole(texts: list[str], most: int) -> tuple[str, bool]:
    """The chunks of a file put together, what they share taken out, ``most`` UTF-16 units, and whether it was cut."""
    out, used, before = [], 0, None
    for text in (t.strip() for t in texts):
        if not text:
            continue
        n = overlap(before, text) if before is not None else 0
        piece = text if before is None else text[n:] if n else "\n\n" + text
        if utf16(piece) > most - used:
            out.append(clip(piece, most - used))
            return "".join(out), True
        out.append(piece)
        used, before = used + utf16(piece), text
    return "".join(out), False


def whole_texts(chunks: DataFrame, most: int = WHOLE_FILE) -> DataFrame:
    """file_id, units, cut, text: the chunks of each file put together again."""

    def one(f: list[dict]) -> tuple:
        text, cut = whole([r["text"] for r in f], most)
        return utf16(text), cut, text

    # Every chunk adds a unit at least: those from ``most`` on can't be in it.
    return by_file(chunks.filter(F.col("ordinal") < most), "ordinal", ["text"], one, "units long, cut boolean, text string")


def candidates(chunks: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """The chunks that a question may be answered from: text of searchable files, CANDIDATES of a file at most."""
    from trovelens.operators.keyword import searchable

    usable = files.select("file_id", "root").join(searchable(roots), "root", "left_semi").select("file_id")
    own = chunks.filter(F.col("source").isin("body", "ocr", "code_symbol")).join(usable, "file_id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("ordinal"))
    return own.withColumn("_nth", nth).filter(F.col("_nth") <= CANDIDATES).drop("_nth")


def whole_budget(passage_files: int) -> int:
    """Units that files sent whole share: what the passages of others leave of WHOLE_TOTAL."""
    return max(0, WHOLE_TOTAL - passage_files * max(min(PASSAGE_TOTAL // max(passage_files, 1), PASSAGE_MOST), PASSAGE_LEAST))


def payload(picked_: list[str], wholes: list[list[str]]) -> list[str]:
    """What is sent: passages as they are, then each whole file as far as the shared budget goes, in order."""
    left, out = whole_budget(len(picked_)), list(picked_)
    for texts in wholes:
        text, _ = whole(texts, min(WHOLE_FILE, left))
        left = max(0, left - utf16(text))
        out.append(text)
    return out

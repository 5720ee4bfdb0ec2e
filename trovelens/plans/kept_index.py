"""An index that is kept in step with its files: tables that grow by parts, and what an open index reads of them.

A change writes one part of each table (files, chunks, tokens, vectors) and what it does to the counts: how many chunks
have a term, more or fewer, the number of chunks and of their words. Rows that it replaces
stay where they are; ``gone`` names their chunks and ``gone_files`` their files, and what is older than its entry there is dead.
A row of the table ``commits``, written last, makes all of a part readable at once; parts that no commit
names are never read. Counts are summed when an index is opened, so a search of it is one of a fresh index.

Parts are merged as they double: the newest ones are written anew as one, without their dead rows, as long as the part
before them is not more than GROW times as large; a row is rewritten a logarithmic number of times.

All tables are plain Parquet. One writer works at a time, as one index has one indexer; a second one that
writes the same commit is refused.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from trovelens.operators import fusion, keyword
from trovelens.plans.lineage import cut

#: Tables with rows by chunk, and by file; counts, which are summed.
BY_CHUNK, BY_FILE = ("chunks", "tokens", "text_vectors"), ("files", "image_vectors")
COUNTS = {"words": ("term", "n_chunks")}
#: Parts are merged while the part before them has at most so many times their chunks.
GROW = 2


class Part(NamedTuple):
    gen: int
    name: str
    first: int  # commits from here on up to gen are in it
    chunks: int


class KeptIndex:
    """The index in a folder that all share; ``roots`` are given at opening, they are not part of it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._opened: tuple[int, fusion.Store] | None = None

    def parts(self) -> list[Part]:
        """The parts that are read, oldest first: of merged commits only the one that holds them."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/commits").select("gen", "name", "first", "chunks").collect()  # one for each commit
        except AnalysisException:
            return []
        out: list[Part] = []
        for c in sorted(Part(r["gen"], r["name"], r["first"], r["chunks"]) for r in rows):
            out = [p for p in out if p.gen < c.first] + [c]
        return out

    def _read(self, table: str, parts: list[Part]) -> DataFrame | None:
        """The rows of a table in these parts, dead ones too, with gen."""
        found = None
        for p in parts:
            rows = self.spark.read.parquet(f"{self.path}/{table}/{p.name}").withColumn("gen", F.lit(p.gen))
            found = rows if found is None else found.unionByName(rows)
        return found

    def _live(self, table: str, parts: list[Part]) -> DataFrame:
        """The rows of these parts that no later one of them has replaced, with gen."""
        key, gone = ("file_id", "gone_files") if table in BY_FILE else ("chunk_id", "gone")
        dead = self._read(gone, parts).groupBy(key).agg(F.max("gen").alias("until"))
        rows = self._read(table, parts).join(dead, key, "left")
        return rows.filter(F.col("until").isNull() | (F.col("gen") >= F.col("until"))).drop("until")

    def live(self, table: str) -> DataFrame:
        """The rows of a table that are there now."""
        return self._live(table, self.parts()).drop("gen")

    def _write(self, name: str, tables: dict[str, DataFrame]) -> None:
        for table, rows in tables.items():
            rows.write.parquet(f"{self.path}/{table}/{name}")

    def _commit(self, part: Part) -> None:
        row = self.spark.createDataFrame([tuple(part)], "gen int, name string, first int, chunks long")
        row.coalesce(1).write.mode("error").parquet(f"{self.path}/commits/at={part.gen}")

    def change(self, files: DataFrame, chunks: DataFrame, text_vectors: DataFrame, image_vectors: DataFrame, deleted: DataFrame | None = None) -> None:
        """Put files (file_id, ..) with their chunks and vectors in place of what was there; files in ``deleted`` (file_id) go with all of theirs.

        A text vector of no chunk that comes with it, or a second one of a chunk, is an error and nothing is committed. A chunk that is
        again what it was (a moved file's text, say) is not written anew, and keeps its vector unless a new one comes.
        """
        strange = text_vectors.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).join(chunks.select("chunk_id", F.lit(True).alias("known")), "chunk_id", "left").filter("n > 1 OR known IS NULL")
        if wrong := [r[0] for r in strange.select("chunk_id").limit(5).collect()]:
            raise ValueError(f"vectors of no chunk, or several of one: {wrong}")
        parts = self.parts()
        gen = parts[-1].gen + 1 if parts else 1
        name = f"part_{uuid.uuid4().hex}"
        touched = files.select("file_id") if deleted is None else files.select("file_id").unionByName(deleted.select("file_id"))
        touched = cut(touched.distinct())
        new = chunks
        if parts:
            old = cut(self._live("chunks", parts).drop("gen").join(touched, "file_id", "left_semi"))
            columns = [c for c in chunks.columns if c in old.columns]
            same = chunks.select(*columns).intersect(old.select(*columns)).select("chunk_id")
            same = cut(same.join(text_vectors.select("chunk_id"), "chunk_id", "left_anti"))  # a new vector brings its chunk anew
            new, dead = cut(chunks.join(same, "chunk_id", "left_anti")), cut(old.join(same, "chunk_id", "left_anti"))
        else:
            new, dead = cut(chunks), chunks.limit(0)
        old_files = files.select("file_id").limit(0) if not parts else touched
        self._write(name, {"files": files, "image_vectors": image_vectors, "chunks": new, "text_vectors": text_vectors, "tokens": keyword.tokens_of(new), "gone": dead.select("chunk_id"), "gone_files": old_files})
        tokens = self.spark.read.parquet(f"{self.path}/tokens/{name}")
        lost = cut(keyword.tokens_of(dead))
        self._write(name, {
            "words": _changed("term", keyword.vocabulary(tokens), keyword.vocabulary(lost)),
            "totals": _total(tokens, 1).unionByName(_total(lost, -1)),
        })
        self._commit(Part(gen, name, gen, new.count()))
        self.merge()

    def merge(self, whole: bool = False) -> None:
        """Write the newest parts anew as one, as long as the one before them is not much larger; or all."""
        parts = self.parts()
        if not parts:
            return
        k, n = len(parts) - 1, parts[-1].chunks
        while k > 0 and (whole or parts[k - 1].chunks <= GROW * n):
            k -= 1
            n += parts[k].chunks
        some = parts[k:]
        if len(some) < 2:
            return
        name = f"part_{uuid.uuid4().hex}"
        tables = {t: self._live(t, some).drop("gen") for t in (*BY_FILE, *BY_CHUNK)}
        tables["chunks"] = chunks = cut(tables["chunks"])
        for t, (key, count) in COUNTS.items():
            tables[t] = self._read(t, some).groupBy(key).agg(F.sum(count).alias(count)).filter(F.col(count) != 0)
        tables["totals"] = self._read("totals", some).agg(F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens"))
        for t in ("gone", "gone_files"):  # what the oldest parts replace is nowhere
            rows = self._read(t, some).drop("gen").distinct()
            tables[t] = rows if k else rows.limit(0)
        self._write(name, tables)
        self._commit(Part(some[-1].gen + 1, name, some[0].first, chunks.count()))

    def open(self, roots: DataFrame) -> fusion.Store:
        """What a search reads; the counts are summed once for each commit."""
        parts = self.parts()
        if not parts:
            raise FileNotFoundError(self.path)
        if self._opened is None or self._opened[0] != parts[-1].gen:
            sums = {t: cut(self._read(t, parts).groupBy(key).agg(F.sum(count).alias(count)).filter(F.col(count) > 0)) for t, (key, count) in COUNTS.items()}
            total = self._read("totals", parts).agg(F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens")).first()
            n = total["chunks"] or 0
            tokens = self._live("tokens", parts).drop("gen")
            index = keyword.index_of(tokens, sums["words"], n, (total["tokens"] or 0) / n if n else 0.0, keyword.block_count(self._live("files", parts)))
            files, chunks, text, image = (self._live(t, parts).drop("gen") for t in ("files", "chunks", "text_vectors", "image_vectors"))
            self._opened = parts[-1].gen, fusion.Store(index, chunks, files, roots, fusion.vectors_told(text, files, chunks), fusion.vectors_told(image, files))
        return self._opened[1]._replace(roots=roots)


def _changed(key: str, more: DataFrame, fewer: DataFrame) -> DataFrame:
    """key, n_chunks: how much each count rises or falls."""
    both = more.unionByName(fewer.withColumn("n_chunks", -F.col("n_chunks")))
    return both.groupBy(key).agg(F.sum("n_chunks").alias("n_chunks")).filter("n_chunks <> 0")


def _total(tokens: DataFrame, sign: int) -> DataFrame:
    n = tokens.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    return n.select((F.col("chunks") * sign).cast("long").alias("chunks"), (F.col("tokens") * sign).cast("long").alias("tokens"))

"""Target-distribution importance resampling: documents that look like a target are likelier to be drawn.

Hashed n-gram features are counted in the raw texts and in a target's; a feature's bucket has as gain
the log ratio of the target's to the raw share of it, a document's weight is the sum of its features' gains,
and the documents with the largest weight plus Gumbel noise are drawn: a sample without replacement in
proportion to the exponential of the weights.

A task counts in a trie of words of its own: a node stands for a run of words and holds how often it
occurred and the CRC state of its bytes, which a child continues, so no run's bytes are joined or hashed twice.
A full trie gives its counts to the task's bucket totals and begins anew. Tasks' totals are summed by
bucket; then texts walk such tries again, with gains on the nodes.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelens.llm.columns import documents, folded, needed, slices
from trovelens.plans.lineage import cut
from trovelens.plans.skew import numbered

#: Nodes of a task's trie, and bytes of a long text that are cut into words at once.
NODES_KEPT, RUN_BYTES = 300_000, 1 << 20
#: A-Z become a-z; all other bytes below 128 that are no digit or letter become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Params(NamedTuple):
    shortest: int = 1  # words of a feature, from
    longest: int = 1  # to
    buckets: int = 10_000
    seed: str = "2024"
    percent: int = 10  # of the documents that are long enough, drawn
    least_words: int = 20


DEFAULT = Params()


def word_runs(raw: bytes, run: int = RUN_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, folded, in lists of about ``run`` bytes; a word is never cut."""
    at = 0
    while at < len(raw):
        end = min(at + run, len(raw))
        part = raw[at:end].translate(_FOLD)
        while end < len(raw) and part[-1] != 32:  # on to the next separator, by runs
            more = raw[end : end + run].translate(_FOLD)
            gap = more.find(b" ")
            part += more if gap < 0 else more[: gap + 1]
            end += len(more) if gap < 0 else gap + 1
        yield part.split()
        at = end


def features(raw: bytes, params: Params, run: int = RUN_BYTES) -> tuple[int, Counter]:
    """The number of a text's words, and how often each run of words (a tuple) occurs in it."""
    n, counts, tail = 0, Counter(), []
    for words in word_runs(raw, run):
        n += len(words)
        held = tail + words
        for k in range(params.shortest, params.longest + 1):
            begin = max(0, len(tail) - k + 1)  # runs that end in the tail have been counted
            counts.update(zip(*[held[begin + i :] for i in range(k)], strict=False))
        tail = held[len(held) - params.longest + 1 :] if params.longest > 1 else []
    return n, counts


class Trie:
    """Runs of words with what belongs to them. A node is [CRC state, value, children or None]."""

    def __init__(self, gains: np.ndarray | None = None, params: Params = DEFAULT, most: int = NODES_KEPT):
        self.params, self.most = params, most
        self.gains = None if gains is None else gains.tolist()
        self.totals = np.zeros(params.buckets, np.int64)
        self.clear()

    def clear(self) -> None:
        self.root, self.nodes = [0, 0, {}], 0

    def node(self, words: tuple[bytes, ...]) -> list:
        """The node of a run of words; nodes on its path that are missing are made, with the gain of their bucket or a count of 0."""
        here = self.root
        for word in words:
            kids = here[2]
            if kids is None:
                kids = here[2] = {}
            found = kids.get(word)
            if found is None:
                state = zlib.crc32(b" " + word if here is not self.root else word, here[0])
                found = kids[word] = [state, 0 if self.gains is None else self.gains[state % self.params.buckets], None]
                self.nodes += 1
            here = found
        return here

    def count(self, counts: Counter) -> None:
        for words, n in counts.items():
            self.node(words)[1] += n
            if self.nodes >= self.most:
                self.flush()

    def flush(self) -> np.ndarray:
        """The bucket totals, with the nodes' counts added; the trie is empty after it."""
        stack, states, counts = [self.root], [], []
        while stack:
            for child in (stack.pop()[2] or {}).values():
                states.append(child[0])
                counts.append(child[1])
                stack.append(child)
        np.add.at(self.totals, np.array(states, np.int64) % self.params.buckets, np.array(counts, np.int64))
        self.clear()
        return self.totals

    def weight(self, counts: Counter) -> int:
        """The sum of gains of a text's features."""
        if self.nodes >= self.most:
            self.clear()
        return sum(self.node(words)[1] * n for words, n in counts.items())


def _raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    column = batch.column(batch.schema.get_field_index(name))
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def bucket_totals(texts: DataFrame, params: Params = DEFAULT) -> np.ndarray:
    """How many features of all ``texts`` (text) each bucket has; the driver gets ``buckets`` numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(params=params)
        for batch in slices(batches):
            for raw in _raw(batch, "text"):
                trie.count(features(raw, params)[1])
        totals = trie.flush()
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[at])], names=["bucket", "n"])

    found = needed(texts, "text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(params.buckets, np.int64)
    for r in found.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket the floored thousandfold log ratio of its smoothed shares of the target and of the raw features."""
    k = len(raw)
    s_all, t_all = float(raw.sum()), float(target.sum())
    ratio = [(float(t) + 1) * (s_all + k) / ((float(s) + 1) * (t_all + k)) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    """Floored thousandfold Gumbel noise of a document, from its id and the seed; a null id is the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gains_: np.ndarray, params: Params = DEFAULT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row; whole texts are read, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(gains_, params)
        for batch in slices(batches):
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            out = []
            for i, raw in zip(ids, _raw(batch, "text"), strict=True):
                n, counts = features(raw, params)
                weight = trie.weight(counts)
                out.append((i, n, counts.total(), weight, weight + noise(i, params.seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return needed(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def drawn(docs: DataFrame, target: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of ``docs`` (doc_id, text), drawn for the texts of ``target`` (text).

    Of the N rows with at least ``least_words`` words the floor(percent * N / 100) with the highest scores have
    a rank from 1, ties by the smaller doc_id; all others have none. Null and empty texts have no words, weight 0 and
    the score of their noise. A null doc_id has the noise of an empty id and comes after others of its score; repeated
    rows are drawn each, in any order among themselves. Very long texts are cut into words by runs. Without a
    target all gains tell raw shares alone; an empty table gives an empty result. Other columns are ignored.
    Ranks are numbered by ranges of scores: no task sees more than a range.
    """
    by_bucket = gains(bucket_totals(docs, params), bucket_totals(target, params))
    table = cut(weighed(docs, by_bucket, params))
    able = F.col("n_words") >= params.least_words
    n = table.filter(able).count()
    keys = table.withColumn("place", F.struct((~able).alias("short"), (-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("none"), "doc_id", F.monotonically_increasing_id().alias("row")))
    ranked = numbered(keys, "place", "number").drop("place")
    return ranked.withColumn("rank", F.when(able & (F.col("number") <= params.percent * n // 100), F.col("number").cast("long"))).drop("number")


def resampled(docs: DataFrame, target: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns as they are, whatever their names: ``drawn`` by id.

    Rows of one id are drawn together if any of them is. Edge cases are as in ``drawn``.
    """
    ids = drawn(docs, target, params).filter("rank IS NOT NULL").select(F.struct(F.col("doc_id")).alias("key")).distinct()
    own = docs.select(F.struct(F.col("doc_id")).alias("key"), folded(docs).alias("whole"))
    return own.join(ids, own["key"].eqNullSafe(ids["key"]), "left_semi").select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return drawn(documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB has no CRC: its table of 256 entries comes from the polynomial, and each distinct word's bytes are folded through it.
ORACLE_SQL = r"""
WITH bits AS (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM (SELECT unnest(range(256)) AS b)),
crcs AS (SELECT list(v ORDER BY b) AS tbl FROM bits),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
dc AS (SELECT doc_id, w, count(*) AS c FROM dw GROUP BY ALL),
tw AS (SELECT unnest(ws) AS w FROM t),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM dc UNION SELECT DISTINCT w FROM tw)),
vb AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda a, b: xor(a >> 8, tbl[xor(a & 255, b) + 1]))) % 10000 AS bucket FROM v, crcs),
s AS (SELECT bucket, sum(c) AS s FROM dc JOIN vb USING (w) GROUP BY 1),
g AS (SELECT bucket, count(*) AS t FROM tw JOIN vb USING (w) GROUP BY 1),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM g)::DOUBLE AS t_all),
gain AS (SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM vb) b LEFT JOIN s USING (bucket) LEFT JOIN g USING (bucket), n),
wt AS (SELECT doc_id, sum(c * gain) AS weight FROM dc JOIN vb USING (w) JOIN gain USING (bucket) GROUP BY 1),
o AS (SELECT d.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN wt USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM r
"""

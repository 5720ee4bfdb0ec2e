"""Document fingerprints: SimHash of weighted terms, and a search for all fingerprints within a Hamming radius.

Terms are the words of a text and its runs of five words. Each term's hash votes on every bit, for or against,
with the term's weight; a bit is set where the votes for it prevail. The share of bits in which two
fingerprints differ is the angle between their texts' term vectors over pi, and its cosine their likeness.

The search keeps tables of fingerprints whose digits are permuted so that some blocks of them lead: of
``blocks`` blocks at least ``blocks - radius`` are the same in both fingerprints of a pair, so each choice of so
many is a table, and who shares its leading digits is compared. Equal fingerprints are one class from the start.
Keys that many classes share are compared block by block in tasks of bounded size, which say how many
partners each has and only as many links as connect them.

The next document of each is found in a sort by ranges: a task streams its range with one text at hand, and only
the ends of ranges meet by a join.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelens.llm.columns import documents, needed, rows
from trovelens.llm.ngram_join import _SPACE, mix, word_hashes
from trovelens.plans.components import components
from trovelens.plans.lineage import cut
from trovelens.plans.skew import skewed_join

WORDS, BITS = 5, 128
#: Weights of a run of words and of a single word that occur once, in 256ths; more occurrences count 1 + log2.
RUN_WEIGHT, WORD_WEIGHT = 256, 128
#: Characters of text for each range, about; bytes of a long text that are hashed at once; terms that vote at once.
TASK_CHARS, RUN_BYTES, VOTERS = 20_000_000, 1 << 20, 1 << 17
#: Fingerprints that differ in so many bits at most are found; into so many blocks their digits are parted.
RADIUS, BLOCKS = 3, 4
#: A key with more classes than HOT is compared in blocks of about BLOCK.
HOT, BLOCK = 64, 512

_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1
_PLACES = np.arange(BITS // 8) * 256
_SALTS = np.array([0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF for k in range(WORDS + 1)], np.uint64)


def words(text: str, run: int = RUN_BYTES) -> np.ndarray:
    """64-bit hashes of a text's words, A-Z folded, in order; long texts are hashed in runs that end between words."""
    raw = np.frombuffer(text.encode("utf-8").lower(), np.uint8)  # bytes: A-Z only
    parts, at = [], 0
    while at < len(raw):
        end = min(at + run, len(raw))
        while end < len(raw) and not _SPACE[raw[end]]:
            gap = np.flatnonzero(_SPACE[raw[end : end + run]])
            end = min(end + (int(gap[0]) if len(gap) else run), len(raw))
        parts.append(word_hashes(raw[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def terms(word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, weights) of a text's terms: its words, then its runs of WORDS words, or all of fewer as one run."""
    n = len(word)
    if n == 0:
        return
    k = min(WORDS, n)
    run = np.full(n - k + 1, _SALTS[k])
    for i in range(k):
        run = mix(run + word[i : n - k + 1 + i] * _SALTS[i])
    for own, weight in ((word, WORD_WEIGHT), (run, RUN_WEIGHT)):
        kinds, times = np.unique(own, return_counts=True)
        yield kinds, np.rint(weight * (1 + np.log2(times)))


def fingerprint(text: str | None) -> bytes:
    """BITS bits of a whole text; none is set where there are no words. Votes are whole numbers, so their order is no matter."""
    votes = np.zeros(BITS // 8 * 256)
    for kinds, weight in terms(words(text or "")):
        for at in range(0, len(kinds), VOTERS):
            own, w = kinds[at : at + VOTERS], weight[at : at + VOTERS]
            drawn = np.stack([mix(own ^ _SALTS[1 + i]) for i in range(BITS // 64)], axis=1).view(np.uint8)
            votes += np.bincount((drawn + _PLACES).ravel(), np.repeat(w, BITS // 8), len(votes))
    return np.packbits((votes.reshape(-1, 256) @ _SIGNS > 0).ravel()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The cosine that two fingerprints' differing bits stand for, 0 where it would be less."""
    apart = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return max(0.0, math.cos(math.pi * apart / BITS)) if apart < BITS // 2 else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(doc_id: int | None, text: str, own: bytes, following: str, next_: bytes) -> tuple:
    changed = edited(text, following)
    print_ = fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8")).hexdigest(), own.hex(), print_.hex(), likeness(own, print_), likeness(own, next_)


_RESULT = [("doc_id", "long", pa.int64()), ("n_chars", "long", pa.int64()), ("edited_sha256", "string", pa.string()), ("fingerprint", "string", pa.string()), ("edited_fingerprint", "string", pa.string()), ("near_edited", "double", pa.float64()), ("near_next", "double", pa.float64())]
_ENDS = [("part", "int", pa.int32()), ("end", "string", pa.string()), ("text", "string", pa.string())]


def _schema(columns: list[tuple]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind, _ in columns)


def _batch(found: list[tuple], columns: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(zip(*found, strict=True), columns, strict=True)], names=[name for name, _, _ in columns])


def with_next(docs: DataFrame) -> DataFrame:
    """The columns of ``_RESULT`` for each row of ``docs`` (doc_id, text): its fingerprint, and those of its edited text and its next document.

    The next document is that of the next smaller doc_id, after the last one the first; of rows of one id
    the order is that of their texts' hashes, null ids come last. Texts are shuffled once, to ranges of ids.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for ids, texts in rows(batches, "doc_id", "text"):
            out = []
            for i, t in zip(ids, texts, strict=True):
                t, own = t or "", fingerprint(t)
                if last is None:
                    out.append((i, *[None] * 6, part, "first", t))
                else:
                    out.append((*compared(*last, t, own), part, None, None))
                last = i, t, own
            yield _batch(out, _RESULT + _ENDS)
        if last is not None:
            yield _batch([(last[0], *[None] * 6, part, "last", last[1])], _RESULT + _ENDS)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, following in rows(batches, "doc_id", "text", "following"):
            yield _batch([compared(i, t, fingerprint(t), f, fingerprint(f)) for i, t, f in zip(ids, texts, following, strict=True)], _RESULT)

    chars = docs.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    order = [F.desc_nulls_last("doc_id"), F.col("of_text"), F.col("row")]
    dealt = needed(docs, "doc_id", "text").withColumn("of_text", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(max(4, -(-chars // TASK_CHARS)), *order).sortWithinPartitions(*order)
    found = cut(dealt.select("doc_id", "text").mapInArrow(ranges, _schema(_RESULT + _ENDS)))
    first = found.filter("end = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))
    parts = sorted(r[0] for r in first.select("after").collect())  # a number for each range
    ring = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")
    ends = found.filter("end = 'last'").select("part", "doc_id", "text").join(ring, "part").join(first, "after")
    done = found.filter("end IS NULL").select([name for name, _, _ in _RESULT])
    return done.unionByName(ends.select("doc_id", "text", "following").mapInArrow(finished, _schema(_RESULT)))


def tables(radius: int = RADIUS, blocks: int = BLOCKS) -> list[list[tuple[int, int]]]:
    """Of each table the leading runs of hex digits (from, to): each choice of blocks - radius blocks."""
    digits = BITS // 4
    if not 0 <= radius < blocks <= digits:
        raise ValueError(f"a radius needs more blocks, and {digits} blocks at most")
    edge = [k * digits // blocks for k in range(blocks + 1)]
    return [[(edge[b], edge[b + 1]) for b in some] for some in itertools.combinations(range(blocks), blocks - radius)]


def _masks(table: list[tuple[int, int]]) -> list[int]:
    """The bits of a table's digits in each 64-bit half, as signed numbers."""
    whole = sum(15 << 4 * (BITS // 4 - 1 - d) for a, b in table for d in range(a, b))
    halves = [whole >> 64, whole & (1 << 64) - 1]
    return [h - (1 << 64) if h >> 63 else h for h in halves]


def _halves() -> list[Column]:
    return [F.conv(F.substring("fingerprint", at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "h0"), (17, "h1"))]


def _apart_in_blocks(radius: int, masks: list[list[int]]):
    """Of two packed blocks: partners by node, and links that connect whoever is linked."""
    kinds = [("node", pa.int64()), ("partners", pa.int64()), ("to", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tables_, na, pa_, nb, pb, same in rows(batches, "tab", "na", "pa", "nb", "pb", "same"):
            for tab, *packed, own in zip(tables_, na, pa_, nb, pb, same, strict=True):
                one, two = (np.frombuffer(x, np.int64) for x in (packed[0], packed[2]))
                x, y = (np.frombuffer(v, np.int64).reshape(-1, 2) for v in (packed[1], packed[3]))
                differ = [x[:, None, h] ^ y[None, :, h] for h in range(2)]
                near = sum(np.bitwise_count(d.view(np.uint64)).astype(np.int16) for d in differ) <= radius
                for m in masks[:tab]:  # counted in the first table where they meet
                    near &= ((differ[0] & m[0]) | (differ[1] & m[1])) != 0
                if own:
                    near &= ~np.eye(len(one), dtype=bool)
                if not near.any():
                    continue
                # The smallest node that each reaches within the two blocks, by rounds.
                low, high = one.copy(), two.copy()
                big = np.iinfo(np.int64).max
                while True:
                    new_high = np.minimum(high, np.where(near, low[:, None], big).min(axis=0))
                    new_low = np.minimum(low, np.where(near, new_high[None, :], big).min(axis=1))
                    if own:
                        new_low = new_high = np.minimum(new_low, new_high)
                    if (new_low == low).all() and (new_high == high).all():
                        break
                    low, high = new_low, new_high
                count = [near.sum(axis=1)] + ([] if own else [near.sum(axis=0)])
                nodes, to = (one, low) if own else (np.concatenate([one, two]), np.concatenate([low, high]))
                n = np.concatenate(count)
                some = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(v[some], t) for v, (_, t) in zip((nodes, n, to), kinds, strict=True)], names=[k for k, _ in kinds])

    return run


def _pack(table: pa.Table) -> pa.Table:
    prints = np.stack([table["h0"].to_numpy(), table["h1"].to_numpy()], axis=1)
    return pa.table({**{c: table[c].slice(0, 1) for c in ("tab", "t", "block")}, "nodes": pa.array([table["node"].to_numpy().tobytes()], pa.binary()), "prints": pa.array([np.ascontiguousarray(prints).tobytes()], pa.binary())})


def partners(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), counts (node, partners)) of stored ``classes`` (node, fingerprint; all different).

    Links connect all that are within the radius of each other, directly or by others; counts are of all
    other classes within it. Both are exact: every pair meets in a table, and is counted in the first where it does.
    """
    tables_ = tables(radius, blocks)
    masks = [_masks(t) for t in tables_]
    keys = [F.struct(F.lit(k).alias("tab"), F.xxhash64(F.lit(k), *[F.substring("fingerprint", a + 1, b - a) for a, b in t]).alias("t")) for k, t in enumerate(tables_)]
    keyed = cut(classes.select("node", *_halves(), F.explode(F.array(*keys)).alias("k")).select("k.tab", "k.t", "node", "h0", "h1"))
    several = cut(keyed.groupBy("tab", "t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = cut(skewed_join(keyed, several, ["tab", "t"], sizes=several))
    cold = met.filter(F.col("n") <= HOT).drop("n")
    other = cold.select("tab", "t", F.col("node").alias("b"), F.col("h0").alias("o0"), F.col("h1").alias("o1"))
    differ = [F.col("h0").bitwiseXOR(F.col("o0")), F.col("h1").bitwiseXOR(F.col("o1"))]
    first: Column = F.lit(True)
    for k in range(1, len(masks)):
        meets = F.lit(False)
        for m in masks[:k]:
            meets = meets | (differ[0].bitwiseAND(F.lit(m[0])).bitwiseOR(differ[1].bitwiseAND(F.lit(m[1]))) == 0)
        first = first & ((F.col("x.tab") != k) | ~meets)
    near = (F.bit_count(differ[0]) + F.bit_count(differ[1]) <= radius) & (F.col("node") < F.col("b"))
    pairs = cold.alias("x").join(other.alias("y"), (F.col("x.tab") == F.col("y.tab")) & (F.col("x.t") == F.col("y.t")) & near & first)
    pairs = cut(pairs.select(F.col("node").alias("a"), "b"))
    both = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("partners"))
    hot = met.filter(F.col("n") > HOT)
    if hot.isEmpty():
        return pairs, both
    numbered_ = hot.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)))
    packed = cut(numbered_.select("tab", "t", "block", "node", "h0", "h1").groupBy("tab", "t", "block").applyInArrow(_pack, "tab int, t long, block long, nodes binary, prints binary"))
    left = packed.select("tab", "t", F.col("block").alias("of"), F.col("nodes").alias("na"), F.col("prints").alias("pa"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("block"))
    right = packed.select("tab", "t", "block", F.col("nodes").alias("nb"), F.col("prints").alias("pb"))
    found = left.join(right, ["tab", "t", "block"]).withColumn("same", F.col("of") == F.col("block")).select("tab", "na", "pa", "nb", "pb", "same")
    found = cut(found.mapInArrow(_apart_in_blocks(radius, masks), "node long, partners long, to long"))
    counts = both.unionByName(found.groupBy("node").agg(F.sum("partners").alias("partners"))).groupBy("node").agg(F.sum("partners").alias("partners"))
    return pairs.unionByName(found.filter("node <> to").select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()), counts


def near_groups(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``prints`` (stored; doc_id, fingerprint, ..) and component_id, n_near: the smallest doc_id within reach by steps of ``radius`` bits, and the number of other fingerprints that close.

    Rows of equal fingerprints are one class and not expanded into pairs. A null id is no component's, where
    there is any other; texts without words share a fingerprint.
    """
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = cut(cut(classes).withColumn("node", F.monotonically_increasing_id()))
    links, counts = partners(classes, radius, blocks)
    known = classes.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node")).join(counts, "node", "left")
    known = cut(known.select("fingerprint", "rep", "n", "component", F.coalesce("partners", F.lit(0)).cast("long").alias("n_near")))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"), F.sum("n").alias("n"))
    known = skewed_join(known.drop("n"), cut(least).drop("n"), ["component"], sizes=known.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    sizes = classes.select("fingerprint", "n")
    return skewed_join(prints, cut(known.select("fingerprint", "component_id", "n_near")), ["fingerprint"], sizes=sizes)


def fingerprints(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, component_id, n_near of each row.

    Null texts are empty; empty and blank texts have no terms, no bit set, and are like one another. Equal texts have
    equal fingerprints. Of rows with one id the next document follows the order of their texts' hashes; null ids come after
    all others; a table of one row is its own next document. Very long texts are hashed by runs; repeated rows count
    each; other columns are ignored whatever their names; an empty table gives an empty result.
    """
    return near_groups(cut(with_next(docs)), radius, blocks)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))

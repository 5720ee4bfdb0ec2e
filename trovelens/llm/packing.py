"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Each partition packs its own pieces best-fit-decreasing and emits the nearly full bins. Underfull
bins travel on as items: a round deals them anew to groups of about GROUP_BINS, packs each group best-fit
again and emits what is nearly full. Once one group is left it is packed as a whole. If a round no longer
merges much while several groups are left, the rest is packed as a whole too, however many bins it
holds: best fit over counts of equal fills needs only the histogram of fills (CAPACITY values at
most), and bins find their place in that plan by their rank among equal fills.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovelens.llm.bpe import encoder, vocabulary_path
from trovelens.llm.columns import documents, needed, rows
from trovelens.plans.lineage import cut

CAPACITY, END_ID = 4096, 1
#: A bin this full is emitted at once.
NEARLY_FULL = 0.995
#: Underfull bins that one task of a merge round takes, about.
GROUP_BINS = 8192
#: After a round that leaves more than this share of its bins, what is left is planned by its histogram.
STALLED = 0.9
#: Bins of one fill that are ranked in one task, about.
RANKED = 1_000_000


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset of each item in its bin, fill of each bin).

    Items go largest first, ties in their order, each into the fullest bin that takes it; a bit set
    over free sizes finds that bin in one step.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    bins, offsets, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        above = mask >> size
        if above:
            room = (above & -above).bit_length() - 1 + size
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[k], offsets[k] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            free[room].append(b)
            mask |= 1 << room
    return bins, offsets, np.array(fill, np.int64)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"
_NAMES = [c.split(" ")[0] for c in PIECES.split(", ")]


def local_bins(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """The pieces of each document placed in bins of their own partition; bin ids are unique."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path), END_ID.to_bytes(4, "little")
        table: list[tuple] = []
        wide = 4 * capacity
        for ids, texts in rows(batches, "doc_id", "text"):
            for doc, text in zip(ids, texts, strict=True):
                raw = (own.ids(text) if text else b"") + end
                for piece, at in enumerate(range(0, len(raw), wide)):
                    part = raw[at : at + wide]
                    table.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        if not table:
            return
        # The scan's row order is not part of the table: order first, so ties fall the same way each time.
        table.sort(key=lambda t: (t[0] is None, t[0] or 0, t[1], t[4]))
        sizes = np.array([t[3] for t in table], np.int64)
        bins, offsets, fill = best_fit_decreasing(sizes, capacity)
        first = TaskContext.get().partitionId() << 32
        for k in range(0, len(table), 50_000):
            doc, piece, start, length, crc = zip(*table[k : k + 50_000], strict=True)
            some = bins[k : k + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(some + first), pa.array(offsets[k : k + 50_000]), pa.array(fill[some])],
                names=_NAMES,
            )

    return needed(docs, "doc_id", "text").mapInArrow(pack, PIECES)


BIN = "bin long, fill long, leaves array<long>, shifts array<long>"


def merge_round(bins: DataFrame, groups: int, capacity: int, deal: int = 0) -> DataFrame:
    """Underfull bins packed as items within each of ``groups`` groups; a merged bin lists its first bins and their places.

    Each ``deal`` puts other bins together.
    """

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        ids, sizes = table["bin"].to_numpy(), table["fill"].to_numpy()
        leaves, shifts = table["leaves"].to_pylist(), table["shifts"].to_pylist()
        bins, offsets, fill = best_fit_decreasing(sizes, capacity)
        own = [[] for _ in fill]
        for k, b in enumerate(bins.tolist()):
            own[b].append(k)
        return pa.table(
            {
                "bin": pa.array([int(ids[k].min()) for k in own], pa.int64()),
                "fill": pa.array(fill, pa.int64()),
                "leaves": pa.array([[x for k in ks for x in leaves[k]] for ks in own], pa.list_(pa.int64())),
                "shifts": pa.array([[x + int(offsets[k]) for k in ks for x in shifts[k]] for ks in own], pa.list_(pa.int64())),
            }
        )

    dealt = bins.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(deal)), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(lambda table: merge(table.drop_columns("g")), BIN)


def histogram_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit decreasing over ``counts`` of equal sizes: (how many bins, [(size, first rank of it in these bins)]).

    Bins that hold the same sizes are one entry, whose k-th bin takes the k-th next rank of each size.
    Time and length follow the number of different sizes, not the number of items.
    """
    done: list[tuple[int, list[tuple[int, int]]]] = []
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # free room -> entries
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        # The fullest bins that take it come first; a bin that it goes into may take it again.
        rooms = sorted(r for r in open_ if r >= size)
        while left and rooms:
            room = rooms.pop(0)
            entries = open_.pop(room)
            while left and entries:
                n, own = entries.pop()
                take = min(n, left)
                if take < n:
                    entries.append((n - take, [(s, r + take) for s, r in own]))
                filled = take, [*own, (size, rank)]
                rank, left, rest = rank + take, left - take, room - size
                if rest == 0:
                    done.append(filled)
                    continue
                if rest >= size and rest not in open_:
                    bisect.insort(rooms, rest)
                open_.setdefault(rest, []).append(filled)
            if entries:
                open_[room] = entries
        while left:
            each = capacity // size
            n, fit = (left // each, each) if left >= each else (1, left)
            own = [(size, rank + k * n) for k in range(fit)]
            rank, left = rank + n * fit, left - n * fit
            rest = capacity - fit * size
            (open_.setdefault(rest, []) if rest else done).append((n, own))
    return done + [entry for entries in open_.values() for entry in entries]


def packed_as_whole(bins: DataFrame, capacity: int) -> DataFrame:
    """``bins`` packed as items of one group without any task or the driver seeing them all."""
    ranked = bins.withColumn("salt", F.pmod(F.xxhash64("bin"), F.lit(max(1, -(-bins.count() // RANKED)))))
    parts = cut(ranked.groupBy("fill", "salt").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("fill").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("fill", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("fill", "salt").orderBy("bin")
    ranked = ranked.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["fill", "salt"])
    ranked = cut(ranked.select("bin", "fill", "leaves", "shifts", (F.col("rank") + F.col("start")).alias("rank")))
    counts = {r["fill"]: r["n"] for r in parts.groupBy("fill").agg(F.sum("n").alias("n")).collect()}  # CAPACITY rows at most
    slots, total = [], 0
    for n, own in histogram_plan(counts, capacity):
        at = 0
        for size, first in own:
            slots.append((size, first, n, total, at))
            at += size
        total += n
    plan = bins.sparkSession.createDataFrame(slots or [(0, 0, 0, 0, 0)], "fill long, first long, n long, base long, at long")
    # The slots of a fill cover its ranks without gaps: the last one that begins at or before a rank holds it.
    places = ranked.select("fill", "rank", "bin", "leaves", "shifts", *[F.lit(None).cast("long").alias(c) for c in ("first", "base", "at")])
    # Ranks are dealt in blocks, so that a fill that very many bins have is no single task; a slot goes to each block that it reaches.
    reach = F.sequence(F.floor(F.col("first") / RANKED), F.floor((F.col("first") + F.col("n") - 1) / RANKED))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("bin", "long"), ("leaves", "array<long>"), ("shifts", "array<long>"))]
    marks = plan.filter("n > 0").select("fill", F.col("first").alias("rank"), *none, "first", "base", "at", F.explode(reach).alias("block"))
    both = places.withColumn("block", F.floor(F.col("rank") / RANKED)).unionByName(marks)
    order = Window.partitionBy("fill", "block").orderBy("rank", F.col("first").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(c, ignorenulls=True).over(order).alias(f"_{c}") for c in ("first", "base", "at")]
    found = both.select("*", *last).filter("first IS NULL")
    found = found.select((F.col("_base") + F.col("rank") - F.col("_first")).alias("g"), F.col("_at").alias("at"), "fill", "leaves", "shifts", "bin")
    merged = found.groupBy("g").agg(F.min("bin").alias("bin"), F.sum("fill").alias("fill"), F.flatten(F.collect_list("leaves")).alias("leaves"), F.flatten(F.collect_list(F.transform("shifts", lambda x: x + F.col("at")))).alias("shifts"))
    return cut(merged.select("bin", "fill", "leaves", "shifts"))


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; only a longer one is cut, into pieces of ``capacity``. A
    null or empty text is the end id alone. Null doc_ids, ties and repeated rows are packed like any
    other row; other columns are ignored; an empty table gives an empty result. Every piece is
    placed: a bin that finds no partner is emitted as it is.
    """
    pieces = cut(local_bins(docs, path or vocabulary_path(), capacity))
    least = int(NEARLY_FULL * capacity)
    open_ = pieces.filter(F.col("fill") < least)
    bins = cut(open_.groupBy("bin").agg(F.first("fill").alias("fill")).select("bin", "fill", F.array("bin").alias("leaves"), F.array(F.lit(0).cast("long")).alias("shifts")))
    done: list[DataFrame] = []
    left = bins.count()
    deal = 0
    while left > 1:
        groups = -(-left // GROUP_BINS)
        merged = cut(merge_round(bins, groups, capacity, deal))
        bins = merged.filter(F.col("fill") < least)
        done.append(merged.filter(F.col("fill") >= least))
        before, left, deal = left, bins.count(), deal + 1
        if groups == 1:
            break
        if left > STALLED * before:
            bins = packed_as_whole(bins, capacity)
            break
    done.append(bins)
    places = done[0]
    for more in done[1:]:
        places = places.unionByName(more)
    places = places.select(F.col("bin").alias("sequence_id"), F.arrays_zip("leaves", "shifts").alias("z")).select("sequence_id", F.explode("z").alias("z")).select("sequence_id", F.col("z.leaves").alias("bin"), F.col("z.shifts").alias("shift"))
    full = pieces.filter(F.col("fill") >= least).select(*_NAMES[:5], F.col("bin").alias("sequence_id"), "offset")
    moved = open_.join(places, "bin").select(*_NAMES[:5], "sequence_id", (F.col("offset") + F.col("shift")).alias("offset"))
    return full.unionByName(moved)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))

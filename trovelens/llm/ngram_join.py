"""Near-duplicate join on word shingles with exact Jaccard similarity, by parity sketches.

A document's set of shingles becomes a sketch of lanes: each shingle is XOR-ed into the one lane its
hash chooses. Two sketches differ in at most as many lanes as the sets have elements not in common,
and sets with Jaccard similarity t or more have at most d = (1-t)/(1+t) * (|A|+|B|) of these. So of any
d + 1 lanes one at least is the same in both (pigeonhole): lanes are join keys, per band of sizes, and
pairs that meet are verified on their whole sets.

Documents with equal sets are one class from the start. Lanes that many classes share (a passage that
is everywhere, a large group of near copies) are hot. Each document offers ``spare`` lanes more than it
must, so one with few hot lanes leaves these out and loses nothing: a true partner shares more than
``spare`` lanes with it. For the same reason a pair that shares fewer lanes than the spare ones and one, less the hot
ones of either side, is no pair and is not verified. The others, which consist of common passages or belong to a large group,
meet at the member of a hot lane that has most hot lanes. Who is not linked to that member's component
meets further members, each of the largest component that is left, as long as that makes much less of
the work left; the rest is compared with the group in blocks, where the sketches' distance decides who
is verified.

A text is hashed into shingles once for its class and lanes; only the texts of candidates are hashed
again for verification. Hot lanes are found in each task first, so that no lane's members meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from trovelens.llm.columns import documents, folded, needed, rows, slices
from trovelens.plans.components import components
from trovelens.plans.lineage import cut
from trovelens.plans.skew import skewed_join

WORDS = 5
#: Similarity NUM / DEN and what follows: at most (|A| + |B|) * (DEN - NUM) / (DEN + NUM) elements differ.
NUM, DEN = 3, 4
#: Lanes for each element of the largest set of a band; spare lanes for each lane that must be offered.
LANES, SPARE = 0.4, 0.25
#: A lane value with more classes than this is hot.
HOT = 8
#: Characters of text for each reduce task, about.
TASK_CHARS = 20_000_000
BLOCK = 256
#: Bytes of a long text that are hashed at once.
RUN_BYTES = 1 << 20
#: Lane keys that a task holds before it deals them; what is hot among these is hot.
FLUSH_KEYS = 2_000_000
#: Bits for each candidate in the filter of documents, and bits of the filter at least and at most (16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS, BLOCK_BITS = 16, 1 << 19, 1 << 27, 1 << 19
#: Members meet further centres while more than this many comparisons a member are left, ROUNDS times at most.
COMPARED, ROUNDS = 2048, 6

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_PLACE = _rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
ENTRY = np.dtype([("fa", "<i8"), ("fb", "<i4"), ("s", "u1"), ("always", "u1"), ("n", "<u4")])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(29))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, r in (("up", _R), ("down", _R_INVERSE)):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words in a run of bytes: polynomials of the bytes, from sums over the whole run."""
    edge = np.diff((~_SPACE[raw]).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, run: int = RUN_BYTES) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; of fewer words than WORDS, of all of them as one.

    Long texts are hashed in runs of about ``run`` bytes that end between words.
    """
    raw = np.frombuffer((text or "").encode("utf-8").lower(), np.uint8)  # bytes: A-Z only
    if len(raw) <= run:
        word = word_hashes(raw)
    else:
        parts, at = [], 0
        while at < len(raw):
            end = min(at + run, len(raw))
            while end < len(raw) and not _SPACE[raw[end]]:
                gap = np.flatnonzero(_SPACE[raw[end : end + run]])
                end = min(end + (int(gap[0]) if len(gap) else run), len(raw))
            parts.append(word_hashes(raw[at:end]))
            at = end
        word = np.concatenate(parts)
    n = len(word)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < WORDS:
        tag = np.full(1, n, np.uint64) * _PLACE[WORDS]  # arrays: their arithmetic wraps
        return mix(tag + (word * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True))
    g = word[: n - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        g += word[k : n - WORDS + 1 + k] * _PLACE[k]
    return np.unique(mix(g))


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """96 bits that stand for a set: two sums of mixed elements."""
    a = int(mix(own ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    b = int(mix(own + _U(0x14057B7EF767814F)).sum(dtype=np.uint64)) & 0xFFFFFFFF
    return a - (1 << 64) if a >= 1 << 63 else a, b - (1 << 32) if b >= 1 << 31 else b


def band(s: int) -> tuple[int, int, int]:
    """(sizes are below, lanes, spare lanes) of band s, in which the larger set of a pair has at least 2**s elements."""
    below = 2 << s
    most = (2 * below - 2) * (DEN - NUM) // (DEN + NUM)
    return below, max(int(LANES * below), most + 2), int(SPARE * most)


def lanes(own: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, values) of the lanes of band s that have any element; elements are sorted, so lanes are too."""
    lane = ((own >> _U(32)) * _U(band(s)[1]) >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(lane, prepend=-1))
    return lane[first], np.bitwise_xor.reduceat(mix(own ^ _U(0x2545F4914F6CDD1D)), first)


def offered(own: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(band, always, keys): the lanes to join on in each band that a partner can be in.

    A document with d differences at most offers its first d + 1 + spare lanes with elements, all if
    there are fewer, and the empty ones too if there are no more than d. always: it has less than the
    full spare, so it may not leave out hot lanes.
    """
    n = len(own)
    if n == 0:
        return
    home = n.bit_length() - 1
    for s in (home, home + 1):
        below, count, spare = band(s)
        if s > home and DEN * n < NUM * (1 << s):
            continue
        differ = (n + min(below - 1, n * DEN // NUM)) * (DEN - NUM) // (DEN + NUM)
        if differ == 0:
            continue  # only equal sets, which are one class
        number, value = lanes(own, s)
        must = differ + 1 + spare
        always = len(number) < must
        if len(number) <= differ:
            every = np.zeros(count, np.uint64)
            every[number] = value
            number, value = np.arange(count), every
        salt = mix(number.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U(s))
        yield s, always, mix(value ^ salt) if always else mix(value ^ salt)[:must]


FOUND = "shared int, lane long, s int, always boolean, a_fa long, a_fb int, b_fa long, b_fb int, doc_id long, n_shingles long"
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
_NAMES = [c.split(" ")[0] for c in FOUND.split(", ")]


def _found(n: int, **columns) -> pa.Table:
    """Rows of FOUND; columns that are not given are null."""
    return pa.table({c: pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _KINDS, strict=True)})


def _ipc(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def keys(docs: DataFrame, parts: int) -> DataFrame:
    """(p, entries, keys, hot, rows) by reduce part: packed lane keys, keys that are hot in a task, and rows of FOUND.

    Of equal sets in a task the first one speaks. Rows are the documents themselves and the members of
    hot lanes; they only pass through, dealt evenly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: set[tuple[int, int]] = set()
        heads, all_keys, held, turn = [], [], 0, 0

        def batch(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.binary()] * 4], strict=True)], names=["p", "entries", "keys", "hot", "rows"])

        def flush() -> Iterator[tuple]:
            entry, key = np.array(heads, ENTRY), np.concatenate(all_keys)
            of = np.repeat(np.arange(len(entry)), entry["n"])
            kinds, back, times = np.unique(key, return_inverse=True, return_counts=True)
            hot = times[back.ravel()] > HOT
            part = ((key >> _U(32)) % _U(parts)).astype(np.int64)
            who = entry[of[hot]]
            passing = _found(len(who), lane=(key[hot] & _U(0xFFFFFFFF)).astype(np.int64) | part[hot] << 32, s=who["s"].astype(np.int32), always=who["always"] > 0, a_fa=who["fa"].copy(), a_fb=who["fb"].copy())
            for k in range(0, len(passing), 50_000):
                yield int(part[hot][k]), None, None, None, _ipc(passing.slice(k, 50_000))
            marks = kinds[times > HOT]
            mark_part = ((marks >> _U(32)) % _U(parts)).astype(np.int64)
            for p in np.unique(mark_part):
                yield int(p), None, None, (marks[mark_part == p] & _U(0xFFFFFFFF)).astype("<u4").tobytes(), None
            part, low, of = part[~hot], (key[~hot] & _U(0xFFFFFFFF)).astype("<u4"), of[~hot]
            order = np.argsort(part, kind="stable")
            part, low, of = part[order], low[order], of[order]
            bounds = np.flatnonzero(np.diff(part, prepend=-1, append=parts + 1))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                mine, counts = np.unique(of[a:b], return_counts=True)
                some = entry[mine].copy()
                some["n"] = counts
                yield int(part[a]), some.tobytes(), low[a:b].tobytes(), None, None

        for ids, texts in rows(batches, "doc_id", "text"):
            own = []
            for t in texts:
                set_ = shingles(t)
                mark = fingerprint(set_)
                own.append((*mark, len(set_)))
                if mark in said:
                    continue
                said.add(mark)
                for s, always, k in offered(set_):
                    heads.append((*mark, s, always, len(k)))
                    all_keys.append(k)
                    held += len(k)
            fa, fb, n = zip(*own, strict=True)
            turn += 1
            yield batch([((fa[0] + turn) % parts, None, None, None, _ipc(_found(len(ids), a_fa=fa, a_fb=fb, doc_id=ids, n_shingles=n)))])
            if held >= FLUSH_KEYS:
                for row in flush():
                    yield batch([row])
                heads, all_keys, held = [], [], 0
        if heads:
            for row in flush():
                yield batch([row])

    return needed(docs, "doc_id", "text").mapInArrow(run, "p int, entries binary, keys binary, hot binary, rows binary")


def met(table: pa.Table) -> pa.Table:
    """One part's keys: pairs of classes with the number of lanes they share, (shared null) the members of hot lanes, and what passes through."""
    p = table["p"][0].as_py()
    passing = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["rows"] if x.is_valid]
    hot = np.unique(np.concatenate([np.zeros(0, "<u4"), *[np.frombuffer(x.as_buffer(), "<u4") for x in table["hot"] if x.is_valid]]))
    entry = np.concatenate([np.zeros(0, ENTRY), *[np.frombuffer(x.as_buffer(), ENTRY) for x in table["entries"] if x.is_valid]])
    key = np.concatenate([np.zeros(0, "<u4"), *[np.frombuffer(x.as_buffer(), "<u4") for x in table["keys"] if x.is_valid]])
    kinds, of = np.unique(entry[["fa", "fb", "s", "always"]], return_inverse=True)
    both = key.astype(np.uint64) << _U(32)
    both |= np.repeat(of.ravel().astype(np.uint32), entry["n"])
    del key, entry, of
    both.sort()
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    lane, who = (both >> _U(32)).astype(np.int64), (both & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(lane, prepend=-1))
    size = np.repeat(np.diff(np.append(first, len(lane))), np.diff(np.append(first, len(lane))))
    warm = (size > HOT) | np.isin(lane, hot.astype(np.int64))
    pairs = [np.zeros(0, np.uint64)]
    some = np.flatnonzero((size > 1) & ~warm)
    lane_s, who_s = lane[some], who[some].astype(np.uint64)
    for gap in range(1, HOT):
        same = lane_s[gap:] == lane_s[:-gap]
        pairs.append(who_s[:-gap][same] << _U(32) | who_s[gap:][same])
    pair, shared = np.unique(np.concatenate(pairs), return_counts=True)
    a, b = kinds[(pair >> _U(32)).astype(np.int64)], kinds[(pair & _U(0xFFFFFFFF)).astype(np.int64)]
    h = kinds[who[warm]]
    return pa.concat_tables(
        [
            *passing,
            _found(len(pair), shared=shared.astype(np.int32), lane=np.zeros(len(pair), np.int64), s=a["s"].astype(np.int32), always=(a["always"] | b["always"]) > 0, a_fa=a["fa"].copy(), a_fb=a["fb"].copy(), b_fa=b["fa"].copy(), b_fb=b["fb"].copy()),
            _found(len(h), lane=lane[warm] | (np.int64(p) << np.int64(32)), s=h["s"].astype(np.int32), always=h["always"] > 0, a_fa=h["fa"].copy(), a_fb=h["fb"].copy()),
        ]
    )


def filter_bits(n: int) -> int:
    """Bits of the filter for n candidates: a power of two within its bounds, so what is broadcast is at most MOST_BITS / 8 bytes."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, n * BITS_EACH) - 1).bit_length()))


def _bit(bits: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(bits))


def candidate_filter(ids: DataFrame, bits: int) -> bytes:
    """A bit array with the bits of ``ids`` (doc_id) set: a bounded filter, an exact join follows it."""

    def run(table: pa.Table) -> pa.Table:
        own = np.zeros(BLOCK_BITS, bool)
        own[table["bit"].to_numpy() % BLOCK_BITS] = True
        return pa.table({"block": table["block"].slice(0, 1), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    set_ = ids.select(_bit(bits).alias("bit")).distinct().withColumn("block", F.floor(F.col("bit") / BLOCK_BITS))
    out = np.zeros(bits // 8, np.uint8)
    for row in set_.groupBy("block").applyInArrow(run, "block long, bits binary").collect():
        at = row["block"] * (BLOCK_BITS // 8)
        out[at : at + BLOCK_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, own): the whole sets of the classes in ``wanted`` (node, doc_id, fa, fb), read from the texts of these documents."""
    bits = filter_bits(wanted.count())
    have = docs.sparkSession.sparkContext.broadcast(candidate_filter(wanted, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_bits = np.frombuffer(have.value, np.uint8)
        for batch in slices(batches):
            at = batch.column(2).to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array((set_bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            if not some.num_rows:
                continue
            own = [shingles(t) for t in some.column(1).to_pylist()]
            prints = [fingerprint(x) for x in own]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array([a for a, _ in prints], pa.int64()), pa.array([b for _, b in prints], pa.int32()), pa.array([x.tobytes() for x in own], pa.binary())], names=["doc_id", "fa", "fb", "own"]
            )

    read = needed(docs, "doc_id", "text").filter("doc_id IS NOT NULL").withColumn("bit", _bit(bits))
    sets = read.mapInArrow(run, "doc_id long, fa long, fb int, own binary")
    return sets.join(wanted, ["doc_id", "fa", "fb"]).select("node", "own").dropDuplicates(["node"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether DEN * intersection >= NUM * union."""
    if len(a) > len(b):
        a, b = b, a
    if DEN * len(a) < NUM * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar. Many pairs may share a side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, xs, ys = (batch.column(k) for k in range(4))
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(xs, ys, strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    one = sets.select(F.col("node").alias("a"), F.col("own").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("own").alias("y"))
    met_ = skewed_join(pairs, one, ["a"])
    met_ = skewed_join(met_, two, ["b"], sizes=pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), spread=["a"])
    return met_.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def sketches(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(s, node, size, sketch) for each (s, node) in ``members``: the lanes of its set in a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, out = [], []
            for s, x in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                sketch = np.zeros(band(s)[1], np.uint8)
                number, value = lanes(own, s)
                sketch[number] = (value >> _U(56)).astype(np.uint8)
                sizes.append(len(own))
                out.append(sketch.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["s", "node", "size", "sketch"])

    return members.select("s", "node").distinct().join(sets, "node").select("s", "node", "own").mapInArrow(run, "s int, node long, size long, sketch binary")


def close_stars(stars: DataFrame, drawn: DataFrame) -> DataFrame:
    """Pairs (a, b) of stars (s, centre, node; stored) whose sketches differ in few enough lanes: these are a tenth of a set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ka, kb = (batch.column(k) for k in range(6))
            apart = np.array([int((np.frombuffer(x.as_buffer(), np.uint8) != np.frombuffer(y.as_buffer(), np.uint8)).sum()) for x, y in zip(ka, kb, strict=True)], np.int64)
            near = pa.array(apart * (DEN + NUM) <= (na.to_numpy() + nb.to_numpy()) * (DEN - NUM), pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(near), b.filter(near)], names=["a", "b"])

    one = drawn.select("s", F.col("node").alias("centre"), F.col("size").alias("na"), F.col("sketch").alias("ka"))
    two = drawn.select("s", "node", F.col("size").alias("nb"), F.col("sketch").alias("kb"))
    met_ = skewed_join(stars, one, ["s", "centre"]).join(two, ["s", "node"])
    return _ordered(met_.select("centre", "node", "na", "nb", "ka", "kb").mapInArrow(run, "a long, b long"), "a", "b").distinct()


def blocks(members: DataFrame, drawn: DataFrame, numbers: DataFrame) -> DataFrame:
    """Members (s, top, node, component) of groups with their sketches, packed in blocks of about BLOCK; ``numbers`` says how many (n_blocks)."""

    def pack(table: pa.Table) -> pa.Table:
        columns = {n: pa.array([table[c].to_numpy().astype(np.int64).tobytes()], pa.binary()) for n, c in (("reps", "node"), ("comps", "component"), ("sizes", "size"))}
        return pa.table({**{c: table[c].slice(0, 1) for c in ("s", "top", "block")}, **columns, "sketch": pa.array([b"".join(table["sketch"].to_pylist())], pa.binary())})

    dealt = skewed_join(members, numbers, ["s", "top"]).join(drawn, ["s", "node"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")))
    schema = "s int, top long, block long, reps binary, comps binary, sizes binary, sketch binary"
    return dealt.select("s", "top", "block", "node", "component", "size", "sketch").groupBy("s", "top", "block").applyInArrow(pack, schema)


def close_in_blocks(some: DataFrame, all_: DataFrame, numbers: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components, from a block of each side, whose sketches differ in few enough lanes.

    Each block of ``some`` goes to each block of its group, which is a key of its own: a large group is many tasks' work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s_, ra, ca, na, ka, rb, cb, nb, kb in rows(batches, "s", "ra", "ca", "na", "ka", "rb", "cb", "nb", "kb"):
            for k, s in enumerate(s_):
                count = band(s)[1]
                one, two = (np.frombuffer(x, np.int64) for x in (ra[k], rb[k]))
                comp_a, comp_b, size_a, size_b = (np.frombuffer(x, np.int64) for x in (ca[k], cb[k], na[k], nb[k]))
                lanes_a, lanes_b = np.frombuffer(ka[k], np.uint8).reshape(-1, count), np.frombuffer(kb[k], np.uint8).reshape(-1, count)
                out_a, out_b = [], []
                for i in range(len(one)):
                    near = (lanes_b != lanes_a[i]).sum(axis=1) * (DEN + NUM) <= (size_a[i] + size_b) * (DEN - NUM)
                    near &= comp_b != comp_a[i]
                    out_a += [one[i]] * int(near.sum())
                    out_b += two[near].tolist()
                if out_a:
                    yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    left = some.join(numbers, ["s", "top"]).select("s", "top", F.col("reps").alias("ra"), F.col("comps").alias("ca"), F.col("sizes").alias("na"), F.col("sketch").alias("ka"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    right = all_.select("s", "top", "block", F.col("reps").alias("rb"), F.col("comps").alias("cb"), F.col("sizes").alias("nb"), F.col("sketch").alias("kb"))
    found = left.join(right, ["s", "top", "block"]).drop("top", "block").mapInArrow(run, "a long, b long")
    return _ordered(found, "a", "b").distinct()


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


class Linked(NamedTuple):
    """members: doc_id, n_shingles, fa, fb, rep, node of each row; classes: node, rep, fa, fb; links (a, b) between nodes."""

    members: DataFrame
    classes: DataFrame
    links: DataFrame
    alike: bool  # nodes are reps


def numbered(classes: DataFrame) -> tuple[DataFrame, bool]:
    """``classes`` (stored) with node, a number for each: the smallest doc_id, or where ids repeat with other texts the row's place."""
    if classes.groupBy("rep").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").isEmpty():
        return classes.withColumn("node", F.col("rep")), True
    return cut(classes.withColumn("node", F.monotonically_increasing_id())), False


def linked(docs: DataFrame) -> Linked:
    """Each row's class (rows with equal sets), its smallest doc_id, and verified links between classes: enough of them to connect what belongs together."""
    chars = docs.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(4, -(-chars // TASK_CHARS))
    found = cut(keys(docs, parts).repartition(parts, "p").groupBy("p").applyInArrow(met, FOUND))
    own = found.filter("n_shingles IS NOT NULL").select("doc_id", "n_shingles", F.col("a_fa").alias("fa"), F.col("a_fb").alias("fb"))
    of = own.filter("n_shingles > 0").groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    of, alike = numbered(cut(of.filter("rep IS NOT NULL")))
    members = skewed_join(own, of.drop("n"), ["fa", "fb"], "left", sizes=own.filter("n_shingles > 0").groupBy("fa", "fb").agg(F.count(F.lit(1)).alias("n")))

    def as_nodes(df: DataFrame, side: str, name: str) -> DataFrame:
        named = of.select(F.col("fa").alias(f"{side}_fa"), F.col("fb").alias(f"{side}_fb"), F.col("node").alias(name), F.col("n").alias(f"n_{name}"))
        return df.join(named, [f"{side}_fa", f"{side}_fb"]).drop(f"{side}_fa", f"{side}_fb")

    spare = F.when(F.lit(False), 0)
    for s in range(40):
        spare = spare.when(F.col("s") == s, band(s)[2])
    sizes_fit = DEN * F.least("n_a", "n_b") >= NUM * F.greatest("n_a", "n_b")
    hot = found.filter("shared IS NULL AND n_shingles IS NULL").select("lane", "s", "always", "a_fa", "a_fb").distinct()  # tasks may say the same
    hot = cut(as_nodes(hot, "a", "node").withColumnRenamed("n_node", "n"))
    warmth = cut(hot.groupBy("s", "node").agg(F.count(F.lit(1)).alias("hot_lanes"), F.max("always").alias("always")))
    pairs = found.filter("shared IS NOT NULL").groupBy("s", "always", "a_fa", "a_fb", "b_fa", "b_fb").agg(F.sum("shared").alias("shared"))
    pairs = as_nodes(as_nodes(pairs, "a", "a"), "b", "b").filter((F.col("a") != F.col("b")) & sizes_fit)
    for side in ("a", "b"):
        pairs = pairs.join(warmth.select("s", F.col("node").alias(side), F.col("hot_lanes").alias(f"hot_{side}")), ["s", side], "left")
    hot_both = F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0)))
    # Linked documents share more than ``spare`` lanes; hot ones are not counted here, and where both sides
    # have more hot ones than that they meet in a hot lane or share enough others.
    enough = F.col("shared") > F.when(hot_both <= spare, spare - hot_both).otherwise(spare)
    pairs = _ordered(pairs.filter(F.col("always") | enough), "a", "b")
    many = warmth.filter(F.col("always") | (F.col("hot_lanes") > spare))
    crowd = cut(hot.select("lane", "s", "node", "n").join(many.select("s", "node", "hot_lanes"), ["s", "node"]))
    tops = crowd.groupBy("lane", "s").agg(F.max(F.struct("hot_lanes", (-F.col("node")).alias("r"), "n")).alias("t")).select("lane", "s", (-F.col("t.r")).alias("top"), F.col("t.n").alias("n_a"))
    groups = cut(skewed_join(crowd, cut(tops), ["lane", "s"]).select("s", "top", "node", "n_a", F.col("n").alias("n_b")).distinct())
    pairs = cut(pairs.distinct())
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(groups.select("node")).distinct()
    sets = cut(candidate_sets(docs, cut(wanted.join(of.select("node", F.col("rep").alias("doc_id"), "fa", "fb"), "node"))))
    if groups.isEmpty():
        return Linked(members, of.select("node", "rep", "fa", "fb"), cut(verified(pairs, sets)), alike)
    drawn = cut(sketches(groups, sets))
    stars = cut(groups.filter((F.col("top") != F.col("node")) & sizes_fit).select("s", F.col("top").alias("centre"), "node"))
    pairs = cut(pairs.unionByName(close_stars(stars, drawn)).distinct())
    links = within_groups(groups, pairs, cut(verified(pairs, sets)), sets, drawn)
    return Linked(members, of.select("node", "rep", "fa", "fb"), links, alike)


def within_groups(groups: DataFrame, pairs: DataFrame, links: DataFrame, sets: DataFrame, drawn: DataFrame) -> DataFrame:
    """``links`` and those that are left between members of groups (s, top, node, n_a, n_b) whose sets have not met; ``drawn`` are their sketches."""
    centres = groups.select("s", "top").distinct().withColumn("node", F.col("top"))
    sizes, before = groups.select("s", "top", "node", F.col("n_b").alias("n")), None
    for _ in range(ROUNDS + 1):
        known = sizes.join(components(links).withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").drop("_n")
        known = cut(known.withColumn("component", F.coalesce("component", "node")))
        # Of each component, its members by group: who is in a centre's component has met a member of it or is linked by others.
        by = cut(known.groupBy("s", "top", "component").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("node", "n")).alias("head")))
        met_ = centres.join(known.select("s", "top", "node", "component"), ["s", "top", "node"]).select("s", "top", "component").distinct()
        first = centres.filter("node = top").join(known.select("s", "top", "node", "component"), ["s", "top", "node"]).select("s", "top", "component")
        apart_by = cut(by.join(first, ["s", "top", "component"], "left_anti"))
        if apart_by.isEmpty():
            return links
        whole = by.groupBy("s", "top").agg(F.sum("k").alias("size"), F.max("k").alias("largest"))
        work = whole.join(apart_by.groupBy("s", "top").agg(F.sum("k").alias("apart")), ["s", "top"])
        work = cut(work)
        sums = work.agg(F.sum(F.col("apart") * F.col("size")).alias("left"), F.sum("size").alias("members")).first()
        if sums["left"] <= COMPARED * sums["members"] or (before is not None and sums["left"] > 0.8 * before):
            break
        before = sums["left"]
        # The next centre of a group: the first member of the largest component that no centre is of.
        order = F.struct("k", (-F.col("head.node")).alias("r"), F.col("head.n").alias("n"))
        next_ = cut(by.join(met_, ["s", "top", "component"], "left_anti").groupBy("s", "top").agg(F.max(order).alias("t")).select("s", "top", (-F.col("t.r")).alias("centre"), F.col("t.n").alias("n_c")))
        if next_.isEmpty():
            break
        centres = cut(centres.unionByName(next_.select("s", "top", F.col("centre").alias("node"))))
        stars = skewed_join(known, next_, ["s", "top"]).filter((F.col("node") != F.col("centre")) & (DEN * F.least("n", "n_c") >= NUM * F.greatest("n", "n_c")))
        stars = cut(close_stars(cut(stars.select("s", "centre", "node")), drawn).join(pairs, ["a", "b"], "left_anti"))
        pairs, links = pairs.unionByName(stars), cut(links.unionByName(verified(stars, sets)))
    numbers = cut(work.select("s", "top", F.ceil(F.col("size") / BLOCK).alias("n_blocks")))
    apart = cut(known.join(apart_by.select("s", "top", "component"), ["s", "top", "component"], "left_semi").select("s", "top", "node", "component"))
    mixed = cut(skewed_join(known, numbers, ["s", "top"], "left_semi").select("s", "top", "node", "component"))
    near = close_in_blocks(blocks(apart, drawn, numbers), blocks(mixed, drawn, numbers), numbers)
    near = cut(near.join(pairs, ["a", "b"], "left_anti"))
    return links.unionByName(verified(near, sets))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fa, fb, component_id, first: of each row its set's fingerprint, its group, and whether its class holds the group's smallest id."""
    found = linked(docs)
    comp = components(found.links)
    heads = found.classes.join(comp.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "rep", "fa", "fb", F.coalesce("component", "node").alias("component"))
    if found.alike:
        heads = heads.select("node", F.col("component").alias("component_id"), (F.col("component") == F.col("node")).alias("first"))
    else:
        heads = cut(heads)
        least = heads.groupBy("component").agg(F.min(F.struct("rep", "fa", "fb")).alias("m"))
        heads = heads.join(least, "component").select("node", F.col("m.rep").alias("component_id"), (F.struct("rep", "fa", "fb") == F.col("m")).alias("first"))
    members = cut(found.members.select("doc_id", "n_shingles", "fa", "fb", "node"))
    return skewed_join(members, cut(heads), ["node"], "left").select(
        "doc_id", "n_shingles", "fa", "fb", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("first", F.lit(True)).alias("first")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) of each document.

    Null and empty texts, and texts of white space, have no shingles and link with nothing. Texts of
    fewer than five words are one shingle. A row is a document: rows with one id and different texts are
    linked each by its own text. Repeated rows and equal sets share a class; a null doc_id is carried
    through and is no class's representative, and a class without any id links with nothing. Other columns
    are ignored; an empty table gives an empty result. Shingles are compared as 64-bit hashes, equal sets
    as 96-bit fingerprints.
    """
    return grouped(docs).select("doc_id", "n_shingles", "component_id")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(whole, id, fa, fb): each row of ``docs`` as a struct, its id, and the fingerprint of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [fingerprint(shingles(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in prints], pa.int64()), pa.array([b for _, b in prints], pa.int32())], names=["whole", "id", "fa", "fb"])

    rows_ = docs.select(folded(docs).alias("whole"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("said"))
    return rows_.mapInArrow(run, StructType([rows_.schema["whole"], rows_.schema["id"], StructField("fa", LongType()), StructField("fb", IntegerType())]))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, columns as they are, of which one stays for each group: the one with the smallest doc_id.

    Rows without shingles (null, empty or blank texts) are linked with nothing and all stay, and so do
    rows that no id is linked with. Of rows of one id and equal sets one stays, whichever it is; rows of
    one id and different texts are told apart. An empty table gives an empty result.
    """
    found = cut(grouped(docs))
    stay = found.filter("component_id <=> doc_id AND first").select(F.col("doc_id").alias("stays"), F.col("fa").alias("of_a"), F.col("fb").alias("of_b"))
    repeated = cut(found.groupBy(F.col("doc_id").alias("again")).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("again"))

    def semi(ids: DataFrame, name: str) -> DataFrame:
        rows_ = docs.select(folded(docs).alias("whole"), F.col("doc_id").alias("id"))
        return rows_.join(ids.select(name), F.col("id").eqNullSafe(F.col(name)), "left_semi").select("whole.*")

    if repeated.isEmpty():
        return semi(stay, "stays")
    once = stay.join(repeated, F.col("stays").eqNullSafe(F.col("again")), "left_anti")
    many = fingerprinted(semi(repeated, "again"))
    many = cut(many.join(stay, F.col("id").eqNullSafe(F.col("stays")) & (F.col("fa") == F.col("of_a")) & (F.col("fb") == F.col("of_b")), "left_semi"))
    none = fingerprint(np.zeros(0, np.uint64))
    blank = (F.col("fa") == none[0]) & (F.col("fb") == none[1]) | F.col("id").isNull()
    several = many.filter(blank).unionByName(many.filter(~blank).dropDuplicates(["id", "fa", "fb"]))
    return semi(once, "stays").unionByName(several.select("whole.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: list_slice(ws, i, i + 4)))
  WHEN len(ws) > 0 THEN [ws] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.y FROM r JOIN u ON u.x = r.reach),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN m USING (doc_id)
"""

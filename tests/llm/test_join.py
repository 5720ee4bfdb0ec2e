import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from trovelens.llm import ngram_join
from trovelens.plans import skew


def shingle_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed):
    """Groups of near copies up to hundreds, passages shared by many, short texts, sizes around band limits."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    new = lambda n: [r.choice(words) for _ in range(n)]

    def edited(d, k):
        d = list(d)
        for _ in range(k):
            d[r.randrange(len(d))] = r.choice(words)
        return d

    base, passages, docs = new(150), [new(50) for _ in range(4)], []
    docs += [edited(base, r.randint(0 if k < 3 else 1, 7)) for k in range(150)]
    docs += [edited(base[: r.randint(110, 150)], r.randint(0, 4)) for _ in range(40)]
    docs += [new(r.randint(0, 120)) + r.choice(passages) + new(r.randint(0, 100)) for _ in range(80)]
    docs += [sum(r.sample(passages, 3), []) + new(r.randint(0, 30)) for _ in range(50)]
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30):
        short = new(n)
        docs += [edited(short, r.randint(0, 2)) + new(r.randint(0, 2)) for _ in range(10)]
    for _ in range(40):
        d = new(r.choice([40, 100, 130, 260, 520]))
        docs += [edited(d, max(1, len(d) // 45))[r.randint(0, 3) :] for _ in range(3)]
    r.shuffle(docs)
    return [(i * 3 + 1, " ".join(d)) for i, d in enumerate([*docs, [], []])]


@pytest.mark.parametrize("seed", [5, 23])
def test_components_are_exact(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_odd_rows(odd_documents, no_documents):
    got = ngram_join.near_duplicates(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by_id = {r.doc_id: r for r in got}
    for r in odd_documents.collect():
        assert by_id[r.doc_id].n_shingles == len(shingle_set(r.text))
    assert by_id[6].component_id == 5 and by_id[8].component_id == 7 and by_id[1].component_id == 1 and by_id[3].component_id == 3
    assert by_id[None].component_id is None
    assert ngram_join.near_duplicates(no_documents).count() == 0
    out = ngram_join.representatives(odd_documents)
    assert out.columns == odd_documents.columns and {r.doc_id for r in out.collect()} >= {1, 2, 3, 4, 5, 7, None}


def test_sketch_distance_bounds_the_difference():
    r = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 63, r.integers(4, 200), dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 1 << 63, 5, dtype=np.uint64)]))
        s = max(len(a), len(b)).bit_length() - 1
        sketches = []
        for x in (a, b):
            full = np.zeros(ngram_join.band(s)[1], np.uint64)
            number, value = ngram_join.lanes(x, s)
            full[number] = value
            sketches.append(full)
        assert (sketches[0] != sketches[1]).sum() <= len(np.setxor1d(a, b))


def test_similarity_at_the_limit():
    a = np.arange(7, dtype=np.uint64)
    assert ngram_join.similar(a[:6], a[:8]) and ngram_join.similar(np.arange(3, dtype=np.uint64), np.arange(4, dtype=np.uint64))
    assert not ngram_join.similar(np.arange(5, dtype=np.uint64), np.arange(7, dtype=np.uint64))


def test_filter_lets_every_candidate_pass(spark):
    ids = spark.createDataFrame([(i * 7919,) for i in range(500)], "doc_id long")
    for size in (1 << 19, 1 << 21):
        bits = np.frombuffer(ngram_join.candidate_filter(ids, size), np.uint8)
        assert len(bits) == size // 8
        at = [r[0] for r in ids.select(ngram_join._bit(size)).collect()]
        assert all(bits[b >> 3] >> (b & 7) & 1 for b in at) and np.unpackbits(bits).sum() == len(set(at))
    assert ngram_join.filter_bits(0) == ngram_join.LEAST_BITS and ngram_join.filter_bits(1 << 40) == ngram_join.MOST_BITS


def test_components_are_exact_however_the_work_is_cut(spark, monkeypatch):
    """Hot lanes found in tasks, further centres, salted joins and small blocks change nothing."""
    monkeypatch.setattr(ngram_join, "FLUSH_KEYS", 500)
    monkeypatch.setattr(ngram_join, "COMPARED", 0)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(skew, "LEAST", 20)
    rows = corpus(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_rows_with_one_id_are_told_apart(spark):
    long_ = [" ".join(f"{w}{i}" for i in range(80)) for w in ("a", "b", "c")]
    rows = [(1, "t u v w x y"), (1, "t u v w x y"), (2, "t u v w x y"), (3, long_[0]), (3, long_[1]), (5, long_[0] + " more"), (5, long_[2]), (4, long_[1] + " more"), (6, ""), (6, ""), (None, long_[2]), (None, "q r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    got = ngram_join.near_duplicates(docs.repartition(2)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (5, 3), (5, 5), (6, 6), (6, 6)]
    out = ngram_join.representatives(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text) for r in out.collect())) == sorted([(0, "q r"), (1, "t u v w x y"), (3, long_[0]), (3, long_[1]), (5, long_[2]), (6, ""), (6, "")])


def test_long_texts_are_hashed_in_runs():
    r = random.Random(8)
    text = " ".join("".join(r.choice("abé") for _ in range(r.randint(1, 40))) for _ in range(3000)) + " " * 300 + "z" * 900 + "\ty"
    whole = ngram_join.shingles(text)
    for run in (64, 257, 5000):
        assert np.array_equal(ngram_join.shingles(text, run), whole)

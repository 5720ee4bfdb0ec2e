import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trovelens.llm import importance
from trovelens.llm.importance import Params, Trie

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def runs(text, p):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(p.shortest, p.longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, p):
    """The contract, document by document."""

    def totals(texts):
        return Counter(zlib.crc32(f.encode()) % p.buckets for t in texts for f in runs(t, p))

    raw, want = totals(t for _, t in docs), totals(target)
    s_all, t_all = sum(raw.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s_all + p.buckets) / ((raw[b] + 1) * (t_all + p.buckets)))) for b in range(p.buckets)]
    out, able = [], []
    for i, t in docs:
        f = runs(t, p)
        weight = sum(gain[zlib.crc32(x.encode()) % p.buckets] for x in f)
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(words_of(t)) >= p.least_words:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: p.percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("p", [importance.DEFAULT, Params(1, 2, 97, "x", 40, 2), Params(2, 3, 5000, "", 100, 0)])
def test_drawn_against_brute_force(spark, odd_documents, no_documents, p):
    target = [("Same WORDS one two",), (None,), ("",), ("日本語 of the the",)]
    t = spark.createDataFrame(target, "text string")
    got = importance.drawn(odd_documents, t, p).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = brute([(r.doc_id, r.text) for r in odd_documents.collect()], [x for x, in target], p)
    assert sorted(map(tuple, got), key=repr) == want
    none = importance.drawn(no_documents, t, p)
    assert none.count() == 0
    kept = importance.resampled(odd_documents, t, p)
    assert kept.columns == odd_documents.columns
    ids = {r[0] for r in want if r[4]}
    assert kept.count() == sum(r[0] in ids for r in want)
    assert importance.drawn(odd_documents, t.limit(0), p).count() == len(want)


def test_hot_id(spark):
    rows = [(i if i % 3 else 0, f"word{i % 5} " * 25) for i in range(3000)]
    got = importance.drawn(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame([("word1 word2",)], "text string"), Params(least_words=20))
    ranks = sorted(r["rank"] for r in got.filter("rank IS NOT NULL").collect())
    assert ranks == list(range(1, 301))


@pytest.mark.parametrize("p", [Params(1, 1), Params(1, 3), Params(2, 2)])
def test_runs_and_full_tries(p):
    r = random.Random(6)
    for _ in range(60):
        text = "".join(r.choice(["a", "B", "c1", "é", " ", "-", "\n", " ", "\x7f"]) for _ in range(r.randint(0, 80)))
        for run in (1, 7, 1 << 20):
            n, counts = importance.features(text.encode(), p, run)
            assert n == len(words_of(text)) and Counter({b" ".join(k).decode(): v for k, v in counts.items()}) == Counter(runs(text, p))
    counts = importance.features(("ab cd ef gh " * 50).encode() + b"x y z", p)[1]
    want = Trie(params=p).totals * 0
    for words, n in counts.items():
        want[zlib.crc32(b" ".join(words)) % p.buckets] += n
    for most in (1, 5, 1000):
        trie = Trie(params=p, most=most)
        trie.count(counts)
        assert (trie.flush() == want).all() and trie.nodes == 0
    gain = np.arange(p.buckets) - 17
    assert Trie(gain, p, most=3).weight(counts) == int((want * gain).sum())

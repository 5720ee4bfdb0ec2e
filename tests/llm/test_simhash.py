import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from trovelens.llm import simhash
from trovelens.llm.ngram_join import mix
from trovelens.plans.lineage import cut

SF = "/root/testdata/sf0.001"


def slow(text):
    """The fingerprint by its definition: each bit of each term's hash votes by itself."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    one = {w: simhash.words(w)[0] for w in words}
    k = min(simhash.WORDS, len(words))
    runs = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else {}
    votes = [0] * simhash.BITS
    terms = [(np.array([one[w]]), n, simhash.WORD_WEIGHT) for w, n in Counter(words).items()]
    for run, n in runs.items():
        h = simhash._SALTS[k : k + 1]
        for i, w in enumerate(run):
            h = mix(h + one[w] * simhash._SALTS[i : i + 1])
        terms.append((h, n, simhash.RUN_WEIGHT))
    for h, n, weight in terms:
        drawn = b"".join(int(mix(h ^ simhash._SALTS[1 + i : 2 + i])[0]).to_bytes(8, "little") for i in range(simhash.BITS // 64))
        bits = "".join(f"{b:08b}" for b in drawn)
        for at, b in enumerate(bits):
            votes[at] += round(weight * (1 + math.log2(n))) * (1 if b == "1" else -1)
    return int("".join("1" if v > 0 else "0" for v in votes), 2).to_bytes(simhash.BITS // 8, "big")


def apart(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def brute(rows, radius):
    """The contract's columns, and components and partners, by all pairs."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (i, text) in enumerate(order):
        t, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + nxt[:half]
        own, ed, after = (simhash.fingerprint(x).hex() for x in (t, changed, nxt))
        like = [max(0.0, math.cos(math.pi * apart(own, x) / simhash.BITS)) for x in (ed, after)]
        out[i] = [len(t), hashlib.sha256(changed.encode()).hexdigest(), own, ed, *[round(v, 9) for v in like]]
    kinds = sorted({v[2] for v in out.values()})
    near = {a: [b for b in kinds if a != b and apart(a, b) <= radius] for a in kinds}
    for i, v in out.items():
        seen, todo = {v[2]}, [v[2]]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [j for j, w in out.items() if w[2] in seen and j is not None]
        v += [min(ids) if ids else None, len(near[v[2]])]
    return out


def rows_of(df):
    return {r.doc_id: [r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9), r.component_id, r.n_near] for r in df.collect()}


def test_fingerprint_by_its_definition(monkeypatch):
    r = random.Random(7)
    for _ in range(80):
        text = "".join(r.choice(["aa ", "B", "c1 ", "é", " ", "-\n", "日本 ", "the of and to in "]) for _ in range(r.randint(0, 60)))
        want = slow(text)
        assert simhash.fingerprint(text) == want
        monkeypatch.setattr(simhash, "VOTERS", r.randint(1, 9))
        assert simhash.fingerprint(text) == want and np.array_equal(simhash.words(text, 5), simhash.words(text))
        monkeypatch.undo()
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == bytes(16)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows_of(simhash.query(spark, SF))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], simhash.RADIUS)
    whole = [v for v in got.values() if v[0] > 200]
    assert np.mean([v[4] > 0.3 for v in whole]) > 0.98 and np.mean([v[5] < 0.3 for v in whole]) > 0.9


def test_odd_rows(spark, odd_documents, no_documents):
    got = simhash.fingerprints(odd_documents).collect()
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert sorted((r.doc_id or 0) for r in got) == sorted((i or 0) for i, _ in rows)
    want = brute(list(dict(rows).items()), simhash.RADIUS)
    for r in got:
        assert [r.n_chars, r.fingerprint] == [want[r.doc_id][0], want[r.doc_id][2]]
        if r.doc_id not in (14, 13, 9, 8):  # repeated ids are their own next
            assert [r.edited_sha256, r.component_id, r.n_near] == [want[r.doc_id][k] for k in (1, 6, 7)]
    assert simhash.fingerprints(no_documents).count() == 0
    one = simhash.fingerprints(odd_documents.filter("doc_id = 5")).collect()[0]
    assert one.near_next == 1.0 and one.n_near == 0 and one.component_id == 5


@pytest.mark.parametrize("radius, blocks, hot, block", [(3, 4, 64, 512), (3, 4, 4, 7), (2, 5, 2, 3), (0, 1, 64, 512), (5, 7, 8, 16)])
def test_all_within_the_radius(spark, monkeypatch, radius, blocks, hot, block):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(radius)
    base = [r.getrandbits(simhash.BITS) for _ in range(6)]
    made = set()
    for k in range(240):
        x = base[0] if k < 120 else r.choice(base)
        for _ in range(r.randint(0, 4)):
            x ^= 1 << r.randrange(simhash.BITS)
        made.add(x)
    prints = [(i, f"{x:032x}") for i, x in enumerate(sorted(made, key=lambda v: v % 1009))]
    prints += [(1000 + i, prints[i % 3][1]) for i in range(60)] + [(None, prints[0][1])]
    got = simhash.near_groups(cut(spark.createDataFrame(prints, "doc_id long, fingerprint string").repartition(5)), radius, blocks).collect()
    near = {a: {b for _, b in prints if b != a and apart(a, b) <= radius} for _, a in prints}
    comp = {}
    for i, a in sorted((p for p in prints if p[0] is not None)):
        if a not in comp:
            todo = [a]
            comp[a] = i
            while todo:
                for b in near[todo.pop()]:
                    if b not in comp:
                        comp[b] = i
                        todo.append(b)
    assert len(got) == len(prints)
    for x in got:
        assert (x.component_id, x.n_near) == (comp[x.fingerprint], len(near[x.fingerprint]))
    with pytest.raises(ValueError):
        simhash.tables(4, 4)

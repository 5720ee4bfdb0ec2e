import math
import random

import numpy as np
import pytest

from trovelens.llm import whitening

SF = "/root/testdata/sf0.01"
NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(rows):
    """The contract by whole numbers and a covariance, for usable rows (id, entries)."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows]
    n = len(x)
    s = [sum(c) for c in zip(*x, strict=True)]
    dev = [[n * c - t for c, t in zip(row, s, strict=True)] for row in x]
    y = np.array([[float(c) / n for c in row] for row in dev])
    e, v = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)
    return n, [sum(c * c for c in row) for row in dev], y, e[order], v[:, order]


def check(got, rows, components=32):
    n, deviation, y, e, v = brute(rows)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, min(components, len(e)) + 1))
    for k, found in by.items():
        ids = [i for i, _ in rows]
        found.sort(key=lambda r: ids.index(r.vec_id))
        want = y @ v[:, k - 1] / math.sqrt(e[k - 1])
        own = np.array([r.whitened for r in found])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-8
        assert [r.deviation for r in found] == deviation and {r.n for r in found} == {n}
        assert all(abs(r.explained - e[k - 1] / e.sum()) <= 1e-10 * r.explained for r in found)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10


def test_query_against_brute_force(spark):
    got = whitening.query(spark, SF)
    assert got.columns == NAMES
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(got.collect(), rows)


def test_odd_rows(spark, no_documents):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, k + 1) for k in range(5)]) for i in range(80)]
    bad = [(90, None), (91, [1.0, None, 2.0, 3.0, 4.0]), (92, [float("nan")] * 5), (93, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (94, []), (95, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, component string, n string, whitened string, id string, x string"
    both = [(i, v, "a", "b", "c", "d", "e") for i, v in rows + bad]
    df = spark.createDataFrame(both, schema).repartition(7)
    check(whitening.report(df).collect(), rows)
    assert whitening.report(df.limit(0)).count() == 0 and whitening.report(df.limit(0)).columns == NAMES
    assert whitening.report(df.filter("vec_id = 1")).count() == 0
    twice = whitening.report(df.union(df).union(spark.createDataFrame([(None, rows[0][1], *"abcde")], schema))).collect()
    assert len(twice) == 161 * 5 and {x.n for x in twice} == {161} and sum(x.vec_id is None for x in twice) == 5


def test_dependent_and_constant_dimensions(spark):
    r = random.Random(4)
    rows = [(i, [float(a), 7.0, float(b), float(a)]) for i, a, b in ((i, r.randint(-50, 50), r.randint(-9, 9)) for i in range(60))]
    got = whitening.report(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)).collect()
    assert {x.component for x in got} == {1, 2} and got[0].identity_error < 1e-10 and abs(sum(x.explained for x in got) / 60 - 1) < 1e-12


def test_large_entries_are_exact(spark):
    big = [(i, [(i % 7) * 1e13, (-1.0) ** i * 3e12]) for i in range(40)] + [(40, [1e300, -1e300])]
    x = [[max(-whitening.LARGEST, min(whitening.LARGEST, math.floor(64 * c) + 1_000_000)) for c in v] for _, v in big]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((41 * c - t) ** 2 for c, t in zip(row, s, strict=True)) for row in x]
    got = whitening.report(spark.createDataFrame(big, "vec_id long, embedding array<double>").repartition(3)).filter("component = 1").collect()
    assert {r.vec_id: r.deviation for r in got} == {i: w if w < 1 << 63 else None for (i, _), w in zip(big, want, strict=True)}


@pytest.mark.parametrize("fan", [1, 1 << 26])
def test_tree_is_one_factor(spark, monkeypatch, fan):
    monkeypatch.setattr(whitening, "MERGE_BYTES", fan)
    r = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(300, 6)))]
    df, d = whitening.of_one_length(whitening.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(13)))
    n, s = whitening.sums(df, d)
    f = whitening.factor(df, n, s)
    _, _, y, _, _ = brute(rows)
    assert f.shape == (6, 6) and np.allclose(f.T @ f, y.T @ y)

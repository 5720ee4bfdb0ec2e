"""Toxicity as an ordered severity: cumulative-link regression on sparse text features.

One weight for each feature is shared by all thresholds: P(grade <= k) = sigmoid(theta_k - w . x).
Features are whole words and word beginnings; their values are log(1 + occurrences). The tables
label documents as toxic or not, so grades above 0 are set when fitting: toxic texts are parted by how
densely the words that tell toxic texts apart occur in them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelens.llm.columns import documents, kept_rows, needed, rows, slices
from trovelens.llm.sampling import SAMPLE_ROWS, held_out, sampled, set_aside
from trovelens.plans.lineage import cut

GRADES = 4
#: Features that are kept from the sample, and the fewest sampled documents that one must occur in.
FEATURES, LEAST_DOCS = 512, 4
PREFIXES = range(4, 9)
STEPS, RATE, RIDGE = 300, 0.1, 1e-4
#: A text is toxic from a probability of a grade above 0 that the model sets on a part of the sample that a first
#: model has not learned from: a clean text flagged there counts as FLAGGED toxic ones missed.
FLAGGED, LEAST_FROM, MOST_FROM, UNSET_FROM = 5.0, 0.05, 0.5, 0.25
WORDS_KEPT = 300_000
_WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    index: dict  # feature -> position
    weights: np.ndarray
    thresholds: np.ndarray  # GRADES - 1, rising
    toxic_from: float = UNSET_FROM  # the probability of a grade above 0 from which a text is toxic


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings of 4 to 8 letters, each with its own mark."""
    return [f"={word}", *[f"^{word[:k]}" for k in PREFIXES if k <= len(word)]]


def counts(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def feature_counts(text: str) -> Counter:
    out: Counter = Counter()
    for word, n in counts(text).items():
        for f in word_features(word):
            out[f] += n
    return out


class Chosen(NamedTuple):
    """Features in the order of their weight, and which of them tell toxic texts strongly."""

    features: list[str]
    strong: np.ndarray


NOTHING = Model({}, np.zeros(0), np.arange(1, GRADES) * 3.0)


def fit(sample: list[tuple[str, int]]) -> Model:
    """Choose features by how differently they occur, set grades, and descend on the likelihood of the grades.

    Without toxic or without other samples nothing is found toxic: no weights, high thresholds. All
    is counted here, so this is for small samples; ``trained`` counts in the executors.
    """

    def chosen(pick: list[int]) -> Chosen | None:
        docs, n = [Counter(), Counter()], [0, 0]
        for k in pick:
            text, label = sample[k]
            docs[label].update(feature_counts(text).keys())
            n[label] += 1
        if not all(n):
            return None
        odds = {f: float(np.log((docs[1][f] + 0.5) / (n[1] + 1)) - np.log((docs[0][f] + 0.5) / (n[0] + 1))) for f in docs[0].keys() | docs[1].keys() if docs[0][f] + docs[1][f] >= LEAST_DOCS}
        weight = {f: abs(o) * (docs[0][f] + docs[1][f]) ** 0.5 for f, o in odds.items()}
        best = sorted(weight, key=lambda f: (-weight[f], f))[:FEATURES]
        return Chosen(best, np.array([odds[f] > 2 and docs[1][f] >= LEAST_DOCS for f in best], bool))

    every = chosen(list(range(len(sample))))
    if every is None:
        return NOTHING
    first = chosen([k for k in range(len(sample)) if not set_aside(k)])

    def read(index: dict) -> list[tuple]:
        return [(k, label, *vector(text, index)) for k, (text, label) in enumerate(sample)]

    return learned(every, first, read)


def learned(every: Chosen, first: Chosen | None, read) -> Model:
    """The model of the features chosen from all samples; its threshold by a model of ``first``, chosen without those set aside.

    ``read`` gives (key, label, occurrences of all features, positions in an index, occurrences there) of each sample.
    """
    names = list(dict.fromkeys([*every.features, *(first.features if first else [])]))
    index = {f: k for k, f in enumerate(names)}
    found = read(index)
    y = np.array([r[1] for r in found], np.int64)
    total = np.array([r[2] for r in found], float)
    x = np.zeros((len(found), len(names)), np.float32)
    for i, r in enumerate(found):
        x[i, r[3]] = np.log1p(r[4])

    def model(some: Chosen, pick: np.ndarray) -> Model:
        own = x[np.ix_(pick, [index[f] for f in some.features])]
        return descended(own, total[pick], y[pick], some.features, some.strong)

    out = model(every, np.arange(len(y)))
    aside = np.array([set_aside(r[0]) for r in found], bool)
    rest, aside = np.flatnonzero(~aside), np.flatnonzero(aside)
    if first is None or len(set(y[rest])) < 2 or len(set(y[aside])) < 2:
        return out
    part = model(first, rest)
    z = x[aside][:, [index[f] for f in part.index]] @ part.weights
    return out._replace(toxic_from=cheapest(1 / (1 + np.exp(np.clip(part.thresholds[0] - z, -40, 40))), y[aside]))


def cheapest(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold on ``p`` that costs least on labelled texts; the middle (by log odds) of the best range."""
    cuts = np.unique(np.clip(np.concatenate([p, [LEAST_FROM, MOST_FROM]]), LEAST_FROM, MOST_FROM))
    cost = np.array([FLAGGED * ((p >= c) & (y == 0)).sum() + ((p < c) & (y == 1)).sum() for c in cuts])
    k = int(cost.argmin())  # the lowest threshold of the cheapest; all above it up to the next cut but one cost the same
    low = cuts[k - 1] if k else cuts[0]
    odds = np.log([low / (1 - low), cuts[k] / (1 - cuts[k])]).mean()
    return float(1 / (1 + np.exp(-odds)))


def vector(text: str, index: dict) -> tuple[int, list[int], list[int]]:
    """The occurrences of all features of a whole text, the positions of those in ``index`` and their occurrences."""
    found = feature_counts(text)
    hits = [(index[f], v) for f, v in found.items() if f in index]
    return sum(found.values()), [k for k, _ in hits], [v for _, v in hits]


def descended(x: np.ndarray, total: np.ndarray, y: np.ndarray, chosen: list[str], strong: np.ndarray) -> Model:
    """The model of sampled vectors ``x``: grades by the density of ``strong`` features, then descent."""
    density = x[:, strong].sum(axis=1) / np.log(20 + total)
    parts = np.quantile(density[y == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(y == 1, 1 + np.searchsorted(parts, density, side="right"), 0)
    w, theta, gaps = np.zeros(len(chosen)), 1.0, np.zeros(GRADES - 2)  # thresholds: theta, then steps exp(gaps)
    state = [np.zeros(len(w) + GRADES - 1), np.zeros(len(w) + GRADES - 1)]
    balance = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()) ** 0.5
    balance /= balance.sum()
    for step in range(1, STEPS + 1):
        t = np.concatenate([[-40.0], theta + np.concatenate([[0.0], np.exp(gaps).cumsum()]), [40.0]])
        z = x @ w
        s = 1 / (1 + np.exp(-np.clip(t[None, :] - z[:, None], -40, 40)))
        i = np.arange(len(y))
        high, low = s[i, grade + 1], s[i, grade]
        p = np.maximum(high - low, 1e-12)
        dh, dl = -balance * high * (1 - high) / p, balance * low * (1 - low) / p
        dt = np.zeros(GRADES + 1)
        np.add.at(dt, grade + 1, dh)
        np.add.at(dt, grade, dl)
        dt = dt[1:-1]
        dg = np.exp(gaps) * dt[1:][::-1].cumsum()[::-1]
        grad = np.concatenate([x.T @ -(dh + dl) + RIDGE * w, [dt.sum()], dg])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad * grad
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-10)
        w, theta, gaps = w - move[: len(w)], theta - move[len(w)], gaps - move[len(w) + 1 :]
    kept = [k for k in range(len(w)) if abs(w[k]) > 1e-3]
    return Model({chosen[k]: j for j, k in enumerate(kept)}, w[kept], theta + np.concatenate([[0.0], np.exp(gaps).cumsum()]))


class Scorer:
    """A model with a bounded memory of which features a word has."""

    def __init__(self, model: Model):
        self.model, self.words = model, {}

    def above(self, text: str) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        hits: dict[int, int] = {}
        index, words = self.model.index, self.words
        for word, n in counts(text).items():
            own = words.get(word)
            if own is None:
                own = tuple(index[f] for f in word_features(word) if f in index)
                if len(words) >= WORDS_KEPT:
                    words.clear()
                words[word] = own
            for k in own:
                hits[k] = hits.get(k, 0) + n
        z = sum(self.model.weights[k] * np.log1p(n) for k, n in sorted(hits.items()))
        return 1 / (1 + np.exp(np.clip(self.model.thresholds - z, -40, 40)))


def trained(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """``fit`` on the whole texts of the sample; texts and their features stay in the executors.

    The driver gets FEATURES features (twice) and, for each sampled text, at most as many counts.
    """
    sample = cut(sampled(docs, labels, "toxic", sample_rows))
    keys = [(r["_id"], r["_label"]) for r in sample.select("_id", "_label").collect()]  # sample_rows at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, toxic in rows(batches, "_id", "_text", "_label"):
            for i, t, label in zip(ids, texts, toxic, strict=True):
                own, rest = list(feature_counts(t)), int(not set_aside(i))
                columns = [pa.array(own, pa.string())] + [pa.array([v] * len(own), pa.int64()) for v in (label, rest, rest * label)]
                yield pa.RecordBatch.from_arrays(columns, names=["feature", "toxic", "rest", "toxic_rest"])

    by = sample.mapInArrow(each, "feature string, toxic long, rest long, toxic_rest long").groupBy("feature")
    by = cut(by.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"), F.sum("rest").alias("n_rest"), F.sum("toxic_rest").alias("toxic_rest")).filter(F.col("n") >= LEAST_DOCS))

    def chosen(n: str, toxic: str, rows_: list[int]) -> Chosen | None:
        all_, of = len(rows_), sum(rows_)
        if of in (0, all_):
            return None
        odds = F.log((F.col(toxic) + 0.5) / (of + 1)) - F.log((F.col(n) - F.col(toxic) + 0.5) / (all_ - of + 1))
        found = by.filter(F.col(n) >= LEAST_DOCS).withColumn("odds", odds).withColumn("weight", F.abs("odds") * F.sqrt(n))
        best = found.orderBy(F.desc("weight"), "feature").limit(FEATURES).collect()
        return Chosen([r["feature"] for r in best], np.array([r["odds"] > 2 and r[toxic] >= LEAST_DOCS for r in best], bool))

    every = chosen("n", "toxic", [label for _, label in keys])
    if every is None:
        return NOTHING
    first = chosen("n_rest", "toxic_rest", [label for i, label in keys if not set_aside(i)])

    def read(index: dict) -> list[tuple]:
        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, texts, toxic in rows(batches, "_id", "_text", "_label"):
                total, at, n_at = zip(*[vector(t, index) for t in texts], strict=True)
                columns = [pa.array(ids, pa.int64()), pa.array(toxic, pa.int32()), pa.array(total, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(n_at, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "total", "at", "n_at"])

        found = sample.mapInArrow(vectors, "id long, label int, total long, at array<int>, n_at array<long>").collect()
        return sorted((tuple(r) for r in found), key=lambda r: r[:3])

    return learned(every, first, read)


SCHEMA = "doc_id long, severity double, grade int, p_toxic double, toxic boolean"


def graded(p: np.ndarray, toxic_from: float) -> np.ndarray:
    """Grades of texts from P(grade > k): 0 where P(grade > 0) is under ``toxic_from``, else the likeliest above 0."""
    each = -np.diff(np.hstack([p, np.zeros((len(p), 1))]), axis=1)  # P(grade = 1), P(grade = 2), ..
    return np.where(p[:, 0] >= toxic_from, 1 + each.argmax(axis=1), 0).astype(np.int32)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected severity, grade, P(grade > 0) and toxic: whether that reaches the model's threshold, and so grade > 0.

    Whole texts are read. Null and empty texts have no features and get the thresholds' own grade
    probabilities. Null ids are carried through, repeated rows and ties score alike, other columns are
    ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for ids, texts in rows(batches, "doc_id", "text"):
            p = np.array([scorer.above(t or "") for t in texts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(p.sum(axis=1)), pa.array(graded(p, model.toxic_from)), pa.array(p[:, 0]), pa.array(p[:, 0] >= model.toxic_from)],
                names=["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

    return needed(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, model: Model, toxic_from: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose whole text is not toxic, all columns as they are; nothing is shuffled.

    Only ``text`` is read, other columns stay whatever their names. Null and empty texts have no
    features and stay unless the thresholds alone say toxic. Repeated rows and ties go or stay together,
    null ids do not matter, an empty table gives an empty one; a very long text costs its words.
    """
    toxic_from = model.toxic_from if toxic_from is None else toxic_from

    text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches):
            texts = batch.column(text).to_pylist()
            yield batch.filter(pa.array([bool(scorer.above(t or "")[0] < toxic_from) for t in texts], pa.bool_()))

    return kept_rows(docs, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).withColumn("held_out", held_out(F.col("doc_id")))

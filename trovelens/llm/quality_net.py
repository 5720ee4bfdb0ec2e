"""Text quality by a byte-level convolutional network in numpy.

The bytes of a text are read in overlapping chunks that cover all of it. Learned filters run over
each chunk and are max-pooled; a chunk's pooled values and its own verdict are averaged and
maximised over the document and one logistic unit makes the probability of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelens.llm.columns import documents, kept_rows, needed, rows, slices
from trovelens.llm.sampling import SAMPLE_ROWS, held_out, sampled, set_aside
from trovelens.plans.lineage import cut

FILTERS, WIDTH = 16, 5
#: A chunk has 2 * STRIDE bytes and the next begins STRIDE bytes later.
STRIDE = 128
#: Bytes that are convolved at once.
BLOCK_CHUNKS = 512
EPOCHS, RATE, CHUNKS_PER_TEXT = 6, 0.02, 6
#: A filtering stage may reject this share of good texts: its threshold is set on a part of the sample that
#: a first net has not learned from, and is MOST_BELOW at most.
GOOD_LOST, MOST_BELOW = 0.002, 0.5
#: This share of the sampled texts is learned a second time as a slice of 10 to 150 characters.
SHORT_SHARE = 0.3
SEED = 7


class Net(NamedTuple):
    table: np.ndarray  # WIDTH x 256 x FILTERS: what each byte adds to each filter at each place
    bias: np.ndarray
    out: np.ndarray  # a chunk's verdict from its pooled values
    out_bias: float
    head: np.ndarray  # a document's verdict from its features
    head_bias: float
    mean: np.ndarray
    scale: np.ndarray
    reject_below: float = 0.0  # a filtering stage rejects texts that score less


def padded(text: bytes) -> np.ndarray:
    """The bytes with zeros to a whole number of strides, two at least."""
    strides = max(2, -(-len(text) // STRIDE))
    out = np.zeros(strides * STRIDE, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def convolved(net_table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Filter values at each of the first len(data) - WIDTH + 1 places."""
    n = len(data) - WIDTH + 1
    out = net_table[0].take(data[:n], axis=0)
    for k in range(1, WIDTH):
        out += net_table[k].take(data[k : k + n], axis=0)
    return out


def pooled(net: Net, text: bytes) -> np.ndarray:
    """Max-pooled filter values of each chunk; filters may reach WIDTH - 1 bytes over a stride's end."""
    data = np.concatenate([padded(text), np.zeros(WIDTH - 1, np.uint8)])
    strides = (len(data) - WIDTH + 1) // STRIDE
    most = np.empty((strides, FILTERS), np.float32)
    for k in range(0, strides, BLOCK_CHUNKS):
        end = min(strides, k + BLOCK_CHUNKS)
        part = convolved(net.table, data[k * STRIDE : end * STRIDE + WIDTH - 1])
        most[k:end] = part.reshape(end - k, STRIDE, FILTERS).max(axis=1)
    return np.maximum(np.maximum(most[:-1], most[1:]) + net.bias, 0)


def features(net: Net, text: bytes) -> np.ndarray:
    """Mean and maximum over the chunks of pooled values and verdicts, and the log of the length."""
    p = pooled(net, text)
    verdict = np.tanh((p @ net.out + net.out_bias) / 2)[:, None]
    both = np.hstack([p, verdict])
    return np.concatenate([both.mean(axis=0), both.max(axis=0), both[:, -1:].min(axis=0), [np.log1p(len(text))]])


def probability(net: Net, f: np.ndarray) -> float:
    """The probability of label 1 from a text's features."""
    z = float(((f - net.mean) / net.scale) @ net.head + net.head_bias)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(net: Net, text: bytes) -> float:
    """The probability of label 1."""
    return probability(net, features(net, text))


class Drawn(NamedTuple):
    """What the filters learn from one sampled text: chunks from anywhere in it, and maybe a short slice."""

    label: int
    chunks: list[bytes]
    short: str | None


def chunks_of(text: bytes, rng: np.random.Generator) -> list[bytes]:
    """At most CHUNKS_PER_TEXT chunks of the whole text."""
    data = padded(text)
    starts = np.arange(0, len(data) // STRIDE - 1) * STRIDE
    if len(starts) > CHUNKS_PER_TEXT:
        starts = rng.choice(starts, CHUNKS_PER_TEXT, replace=False)
    return [data[s : s + 2 * STRIDE].tobytes() for s in starts]


def drawn(text: str, label: int, key: int, seed: int = SEED) -> Drawn:
    """Drawn by ``key`` alone, so that it does not matter where or in which order texts are read."""
    rng = np.random.default_rng([seed, key % 2**64])
    short = None
    if rng.random() < SHORT_SHARE:  # short texts are rare and read mostly as padding
        size = int(rng.integers(10, 150))
        at = int(rng.integers(0, max(1, len(text) - size)))
        short = text[at : at + size]
    return Drawn(label, chunks_of(text.encode("utf-8"), rng), short)


def learned(found: list[tuple[int, Drawn]], read: Callable[[list[Net]], list[tuple[int, int, list[np.ndarray]]]], seed: int = SEED) -> Net:
    """The net of drawn texts (key, drawn); ``read`` gives (key, label, features under each net) of the whole texts.

    A first net learns from the texts that are not set aside and scores the others; the threshold for
    rejecting comes from these scores alone. The net itself then learns from all. Without any label,
    or with one class only, the net gives that class's share to every text and rejects nothing.
    """
    net = with_filters([d for _, d in found], seed)
    if net is None:
        return flat(found[0][1].label if found else None)
    first = with_filters([d for key, d in found if not set_aside(key)], seed)
    whole = read([net, first] if first else [net])
    out = with_head(net, [(f[0], label) for _, label, f in whole] + short_features(net, [d for _, d in found]))
    if first is None:
        return out
    known = [(f[1], label) for key, label, f in whole if not set_aside(key)] + short_features(first, [d for key, d in found if not set_aside(key)])
    if len({label for _, label in known}) < 2:
        return out
    first = with_head(first, known)
    good = [probability(first, f[1]) for key, label, f in whole if set_aside(key) and label == 1]
    return out._replace(reject_below=min(MOST_BELOW, float(np.quantile(good, GOOD_LOST, method="lower"))) if good else 0.0)


def fit(sample: list[tuple[str, int]], seed: int = SEED) -> Net:
    """``learned`` on a small local sample of whole texts."""
    found = [(k, drawn(t, label, k, seed)) for k, (t, label) in enumerate(sample)]
    return learned(found, lambda nets: [(k, label, [features(n, t.encode("utf-8")) for n in nets]) for k, (t, label) in enumerate(sample)], seed)


def untrained(rng: np.random.Generator) -> Net:
    table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
    size = 2 * FILTERS + 4
    return Net(table, np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0, np.zeros(size), 0.0, np.zeros(size), np.ones(size))


def flat(label: int | None) -> Net:
    """The net of a sample with one class only, or with none."""
    return untrained(np.random.default_rng(SEED))._replace(head_bias=0.0 if label is None else 4.0 * (2 * float(label) - 1))


def short_features(net: Net, sample: list[Drawn]) -> list[tuple[np.ndarray, int]]:
    return [(features(net, d.short.encode("utf-8")), d.label) for d in sample if d.short is not None]


def with_filters(sample: list[Drawn], seed: int = SEED) -> Net | None:
    """A net whose filters are learned; none without both classes."""
    if len({d.label for d in sample}) < 2:
        return None
    rng = np.random.default_rng(seed)
    start = untrained(rng)
    table, bias, out, out_bias = start.table, start.bias, start.out, start.out_bias
    pairs = [(c, d.label) for d in sample for c in d.chunks]
    pairs += [(c, d.label) for d in sample if d.short is not None for c in chunks_of(d.short.encode("utf-8"), rng)]
    x, y = np.frombuffer(b"".join(c for c, _ in pairs), np.uint8).reshape(-1, 2 * STRIDE), np.array([v for _, v in pairs], np.float32)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)).astype(np.float32)
    n = 2 * STRIDE - WIDTH + 1
    moments = [np.zeros_like(v) for v in (table, bias, out)] + [np.zeros_like(v) for v in (table, bias, out)]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 256):
            pick = order[k : k + 256]
            b = x[pick]
            act = table[0].take(b[:, :n], axis=0)
            for w in range(1, WIDTH):
                act += table[w].take(b[:, w : w + n], axis=0)
            where = act.argmax(axis=1)
            top = np.take_along_axis(act, where[:, None, :], axis=1)[:, 0, :] + bias
            hidden = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ out + out_bias, -30, 30)))
            err = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            back = (err[:, None] * out) * (top > 0)
            grad = [np.zeros_like(table), back.sum(axis=0), hidden.T @ err]
            for w in range(WIDTH):
                np.add.at(grad[0][w], (np.take_along_axis(b, where + w, axis=1), np.arange(FILTERS)[None, :]), back)
            step += 1
            for j, (v, g) in enumerate(zip((table, bias, out), grad, strict=True)):
                moments[j] = 0.9 * moments[j] + 0.1 * g
                moments[j + 3] = 0.999 * moments[j + 3] + 0.001 * g * g
                v -= RATE * (moments[j] / (1 - 0.9**step)) / (np.sqrt(moments[j + 3] / (1 - 0.999**step)) + 1e-8)
            out_bias -= RATE * float(err.sum())
    return start._replace(table=table, bias=bias, out=out, out_bias=out_bias)


def with_head(net: Net, pairs: list[tuple[np.ndarray, int]]) -> Net:
    """The net with its document's unit fitted on (features of a text, label)."""
    f, labels = np.array([v for v, _ in pairs]), np.array([y for _, y in pairs], np.float32)
    mean, scale = f.mean(axis=0), f.std(axis=0) + 1e-3
    z = (f - mean) / scale
    head, head_bias = np.zeros(z.shape[1]), 0.0
    w = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for _ in range(50):  # Newton steps of logistic regression with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ head + head_bias, -30, 30)))
        a = np.hstack([z, np.ones((len(z), 1))])
        g = a.T @ (w * (p - labels)) + 0.5 * np.append(head, 0)
        h = (a * (w * p * (1 - p) + 1e-6)[:, None]).T @ a + 0.5 * np.diag(np.append(np.ones(len(head)), 0))
        move = np.linalg.solve(h, g)
        head, head_bias = head - move[:-1], head_bias - move[-1]
        if np.abs(move).max() < 1e-4:
            break
    return net._replace(head=head, head_bias=float(head_bias), mean=mean, scale=scale)


def trained(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Net:
    """``learned`` on the whole texts of the sample, which stay in the executors.

    The driver gets CHUNKS_PER_TEXT chunks, a slice of 150 characters and two rows of features of each at most.
    """
    sample = cut(sampled(docs, labels, "quality", sample_rows))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, own in rows(batches, "_id", "_text", "_label"):
            found = [drawn(t, y, i) for i, t, y in zip(ids, texts, own, strict=True)]
            columns = [pa.array(ids, pa.int64()), pa.array(own, pa.int32()), pa.array([d.chunks for d in found], pa.list_(pa.binary())), pa.array([d.short for d in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "chunks", "short"])

    found = sample.mapInArrow(draw, "id long, label int, chunks array<binary>, short string").collect()
    found = [(r["id"], Drawn(r["label"], [bytes(c) for c in r["chunks"]], r["short"])) for r in sorted(found, key=lambda r: (r["id"], r["chunks"]))]

    def read(nets: list[Net]) -> list[tuple[int, int, list[np.ndarray]]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, texts, own in rows(batches, "_id", "_text", "_label"):
                values = [np.concatenate([features(n, t.encode("utf-8")) for n in nets]).tolist() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.int32()), pa.array(values, pa.list_(pa.float64()))], names=["id", "label", "f"])

        whole = sample.mapInArrow(run, "id long, label int, f array<double>").collect()
        return [(r["id"], r["label"], np.split(np.array(r["f"]), len(nets))) for r in sorted(whole, key=lambda r: (r["id"], r["f"]))]

    return learned(found, read)


def scored(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, score and predicted of every whole text; null and empty texts are scored as no bytes.

    Null ids are carried through, repeated rows get the same score, other columns are ignored. A
    text's memory is its bytes and one block of filter values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(batches, "doc_id", "text"):
            s = [score(net, (t or "").encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], names=["doc_id", "score", "predicted"])

    return needed(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, net: Net, least: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose whole text scores ``least`` (the net's own threshold) or more; nothing is shuffled.

    All columns stay as they are, whatever their names; only ``text`` is read. A null text is scored
    as an empty one, and both as no bytes; a null doc_id does not matter. Repeated rows and ties score
    alike and go or stay together. An empty table gives an empty one; a very long text costs its bytes.
    """
    least = net.reject_below if least is None else least

    text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(text).to_pylist()
            yield batch.filter(pa.array([score(net, (t or "").encode("utf-8")) >= least for t in texts], pa.bool_()))

    return kept_rows(docs, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

import math
import random
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from trovelens.llm import quality_net, toxicity
from trovelens.llm.sampling import labelled_sample
from trovelens.plans.lineage import cut

SF = "/root/testdata/sf0.01"


def split(spark, label):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", label).collect()
    return docs, labels, [(r.text, r[2]) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]


def test_sample_is_bounded_and_not_held_out(spark):
    docs, labels, held = split(spark, "quality")
    sample = labelled_sample(docs, labels, "quality", rows=50)
    whole = {r.text or "" for r in docs.select("text").collect()}
    assert 0 < len(sample) <= 50 and all(t in whole for t, _ in sample)
    learned = labelled_sample(docs, labels, "quality")
    assert len(learned) + len(held) <= labels.count() + 50


def test_quality_on_held_out_texts(spark):
    docs, labels, held = split(spark, "quality")
    net = quality_net.trained(docs, labels)
    right = [(quality_net.score(net, (t or "").encode()) >= 0.5) == (y == 1) for t, y in held]
    assert np.mean(right) >= 0.97


def test_toxicity_on_held_out_texts(spark):
    docs, labels, held = split(spark, "toxic")
    model = toxicity.trained(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    scorer = toxicity.Scorer(model)
    found = [scorer.above(t or "")[0] >= model.toxic_from for t, _ in held]
    clean = [f for f, (_, y) in zip(found, held, strict=True) if y == 0]
    toxic = [f for f, (_, y) in zip(found, held, strict=True) if y == 1]
    assert np.mean(clean) <= 0.02 and np.mean(toxic) >= 0.8


@pytest.mark.parametrize("module", [quality_net, toxicity])
def test_models_without_both_classes(module):
    for sample in ([], [("a b", 1)] * 3, [("a b", 0)] * 3):
        model = module.fit(sample)
        value = quality_net.score(model, b"") if module is quality_net else toxicity.Scorer(model).above("")[0]
        assert 0 <= value <= 1


def test_odd_rows(spark, odd_documents, no_documents):
    r = random.Random(1)
    sample = [("fine words here. " * r.randint(1, 30), 1) for _ in range(20)] + [("%%% ### junk$$$ " * r.randint(1, 30), 0) for _ in range(20)]
    net = quality_net.fit(sample)
    got = quality_net.scored(odd_documents, net).collect()
    assert len(got) == odd_documents.count() and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    assert quality_net.scored(no_documents, net).count() == 0
    model = toxicity.fit([(t, 1 - y) for t, y in sample])
    got = toxicity.scored(odd_documents, model).collect()
    assert len(got) == odd_documents.count() and all(0 <= x.severity <= toxicity.GRADES - 1 for x in got)
    kept = quality_net.accepted(odd_documents, net)
    assert kept.columns == odd_documents.columns and toxicity.accepted(kept, model).columns == odd_documents.columns


def test_whole_text_is_read():
    net = quality_net.fit([("fine words here and there. " * 20, 1)] * 15 + [("%%% ### $$$ " * 40, 0)] * 15)
    far = "fine words here and there. " * 3000
    a, b = quality_net.features(net, far.encode()), quality_net.features(net, (far + "%%% ### $$$ " * 3000).encode())
    assert not np.allclose(a, b) and quality_net.pooled(net, far.encode()).shape[0] == -(-len(far) // quality_net.STRIDE) - 1


def test_pipeline_is_its_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "exact_dedup", "near_duplicates", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert out.exceptAll(docs).count() == 0
        docs = spark.createDataFrame(out.collect(), docs.schema)
    final = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    assert final == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_on_odd_rows_and_none(spark, odd_documents, no_documents, tmp_path, labelled):
    sample = [(100 + i, i % 2, int(i % 3 == 0)) for i in range(60)] if labelled else []
    spark.createDataFrame(sample, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = [(100 + i, ("%%% ### " if i % 2 == 0 else "fine words here, ") * 40 + ("vexfoul " * 5 if i % 3 == 0 else "kindly ") + f"number {i}") for i in range(60)]
    extra = odd_documents.columns[2:]
    added = spark.createDataFrame(more, "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(dict(odd_documents.dtypes)[c]).alias(c) for c in extra])
    for start in (odd_documents.unionByName(added), no_documents):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = cut(stage(spark, docs, str(tmp_path)))
            assert out.columns == start.columns, name
            assert out.exceptAll(docs).count() == 0, name
            docs = out
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
        start.write.parquet(f"{tmp_path}/documents.parquet", mode="overwrite")
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
    assert len(packed) == 0


def slow_features(net, text):
    """The network by its definition: each filter at each place of each chunk, one after the other."""
    stride, strides = quality_net.STRIDE, max(2, -(-len(text) // quality_net.STRIDE))
    data = text + bytes(strides * stride - len(text) + quality_net.WIDTH)
    found = []
    for c in range(strides - 1):
        best = [max(sum(float(net.table[w, data[c * stride + i + w], f]) for w in range(quality_net.WIDTH)) for i in range(2 * stride)) for f in range(quality_net.FILTERS)]
        pooled = [max(0.0, b + float(net.bias[f])) for f, b in enumerate(best)]
        verdict = math.tanh((sum(p * float(o) for p, o in zip(pooled, net.out, strict=True)) + net.out_bias) / 2)
        found.append([*pooled, verdict])
    columns = list(zip(*found, strict=True))
    return [sum(c) / len(c) for c in columns] + [max(c) for c in columns] + [min(columns[-1]), math.log1p(len(text))]


def test_network_by_its_definition():
    net = quality_net.fit([("fine words here. " * 9, 1)] * 15 + [("%%% ### $$$ " * 9, 0)] * 15)
    for text in (b"", b"short", "é日本 words ".encode() * 40, bytes(range(256)) * 3, b"x" * 640):
        assert np.allclose(quality_net.features(net, text), slow_features(net, text), atol=1e-4)


def test_ordinal_model_by_its_definition():
    """P(grade <= k) = sigmoid(theta_k - w . x) word by word, and no small change of the fit is more likely."""
    r = random.Random(2)
    texts = [" ".join(r.choice(["vex", "grim", "foul"] if y and r.random() < 0.5 else ["kind", "calm", "day", "tree"]) for _ in range(30)) for y in [0, 1] * 60]
    sample = [(t, k % 2) for k, t in enumerate(texts)]
    model = toxicity.fit(sample)
    scorer = toxicity.Scorer(model)
    for text in [*texts[:10], "", "VEX vexing day"]:
        z = 0.0
        for f, k in model.index.items():
            n = sum((f[1:] == w if f[0] == "=" else w.startswith(f[1:])) for w in re.findall(r"[^\W\d_]+", text.lower()))
            z += model.weights[k] * math.log1p(n)
        want = [1 - 1 / (1 + math.exp(-(theta - z))) for theta in model.thresholds]
        assert np.allclose(scorer.above(text), want, atol=1e-9)
        assert toxicity.graded(scorer.above(text)[None], model.toxic_from)[0] == (0 if want[0] < model.toxic_from else 1 + int(np.argmax(-np.diff([*want, 0]))))


def test_threshold_costs_least():
    p, y = np.array([0.02, 0.1, 0.2, 0.3, 0.6, 0.9]), np.array([0, 0, 0, 1, 1, 1])
    assert 0.2 < toxicity.cheapest(p, y) <= 0.3
    r = np.random.default_rng(1)
    for _ in range(50):
        p, y = r.random(40), r.integers(0, 2, 40)
        cost = lambda c: toxicity.FLAGGED * ((p >= c) & (y == 0)).sum() + ((p < c) & (y == 1)).sum()  # noqa: B023, E731
        assert cost(toxicity.cheapest(p, y)) == min(cost(c) for c in [*p[(p > toxicity.LEAST_FROM) & (p < toxicity.MOST_FROM)], toxicity.LEAST_FROM, toxicity.MOST_FROM])


def late(spark, label):
    """Texts of three times the former 8,000 characters, told apart by their last words only, and their labels."""
    rows = [(i, "plain words of no matter. " * 1000 + ("vexfoul grimspit " * 60 if i % 2 else "gentle kindly " * 60), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {label} int")
    return df.select("doc_id", "text"), df.select("doc_id", label), rows


def test_toxicity_learns_from_whole_texts(spark):
    docs, labels, rows = late(spark, "toxic")
    model = toxicity.trained(docs, labels)
    assert "=vexfoul" in model.index and "=gentle" in model.index
    local = toxicity.fit(labelled_sample(docs, labels, "toxic"))
    assert model.index.keys() == local.index.keys() and np.allclose(model.thresholds, local.thresholds, atol=1e-6)
    scorer = toxicity.Scorer(model)
    assert all((scorer.above(t)[0] >= model.toxic_from) == (y == 1) for _, t, y in rows)


def test_quality_learns_from_whole_texts(spark):
    docs, labels, rows = late(spark, "quality")
    net = quality_net.trained(docs, labels)
    assert all((quality_net.score(net, t.encode()) >= 0.5) == (y == 1) for _, t, y in rows)


def test_rare_features_are_counted_exactly(spark):
    rows = [(i, "grimspit" if i % 600 == 0 else "vexfoul words" if i % 7 == 0 else "kindly words", int(i % 600 == 0 or i % 7 == 0)) for i in range(1, 6001)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert toxicity.LEAST_DOCS <= sum(t == "grimspit" for _, t, _ in rows)
    assert "=grimspit" in toxicity.fit([(t, y) for _, t, y in rows]).index
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert "=grimspit" in toxicity.trained(df.select("doc_id", "text"), df.select("doc_id", "toxic"), 6000).index

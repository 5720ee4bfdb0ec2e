import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from trovelens.llm import bpe, packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_exact(library):
    own = bpe.encoder(bpe.vocabulary_path())
    r = random.Random(1)
    letters = "aabbcdeehilmnorst'  !.é1<|>/\u0301ßİΣÀ\t\n\x1c日×"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 5000, "ab" * 3000, "a<|startoftext|>b <|endoftext|>", "x</w>y </w>", "Ａ①Ⅷ ǅ", "\x00b\x85c", "don't WE'LL"]
    for text in texts:
        raw, decoded = own.encode(text)
        ids = ids_of(library, text)
        assert np.frombuffer(raw, "<u4").tolist() == ids, text
        assert decoded == library.decode(ids, skip_special_tokens=False)
        assert own.ids(text) == raw


def test_prefix_programming_is_merging():
    own = bpe.encoder(bpe.vocabulary_path())
    r = random.Random(2)
    for _ in range(500):
        word = "".join(r.choice("abcdeinorst") for _ in range(r.randint(1, 14)))
        symbols = word[:-1] + chr(ord(word[-1]) + 256)
        assert own.encode_symbols(symbols) == own.merge_plainly(symbols)


def test_kept_words_are_bounded():
    made = bpe.Kept(str.upper, 10)
    for i in range(100):
        assert made[f"w{i}"] == f"W{i}"
    assert len(made) <= 10 and len(made.older) <= 10
    assert made["y" * 100] == "Y" * 100 and "y" * 100 not in made


def test_encoded_odd_rows(odd_documents, no_documents, library):
    got = bpe.encoded(odd_documents).collect()
    texts = {r.doc_id: r.text for r in odd_documents.collect()}
    assert len(got) == odd_documents.count()
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == ids_of(library, texts[r.doc_id]) and r.n_tokens == len(r.ids) // 4
    assert bpe.encoded(no_documents).count() == 0


def test_best_fit_decreasing():
    r = np.random.default_rng(1)
    for _ in range(20):
        sizes = r.integers(1, 4097, r.integers(1, 400))
        bins, offsets, fill = packing.best_fit_decreasing(sizes)
        for b in range(len(fill)):
            own = sorted((int(offsets[k]), int(sizes[k])) for k in np.flatnonzero(bins == b))
            at = 0
            for o, s in own:
                assert o == at
                at += s
            assert at == fill[b] <= 4096
        assert len(fill) <= np.ceil(sizes.sum() / 4096) * 1.25 + 1


def check_packing(rows, texts, library):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    for doc, text in texts.items():
        ids = [*ids_of(library, text), 1]
        want = sorted((k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096)))
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc])
        assert sorted(set(got)) == want and len(got) % len(want) == 0
    return len(by_sequence)


def test_packed_odd_rows(odd_documents, no_documents, library):
    rows = packing.packed(odd_documents).collect()
    check_packing(rows, {r.doc_id: r.text for r in odd_documents.collect()}, library)
    assert packing.packed(no_documents).count() == 0


def test_rounds_of_merging_stay_whole(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BINS", 8)  # many groups, several rounds
    texts = {i: " ".join(["word"] * (40 * (i % 37) + 5)) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(40)
    rows = packing.packed(docs).collect()
    n = check_packing(rows, texts, library)
    assert n <= sum(r.length for r in rows) / 4096 * 1.1 + 2


def test_histogram_plan_is_best_fit_decreasing():
    r = np.random.default_rng(4)
    for _ in range(60):
        sizes = r.integers(1, r.choice([8, 40, 300]), r.integers(1, 500))
        plan = packing.histogram_plan({int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True), strict=True)}, 300)
        bins = [[(s, first + k) for s, first in own] for n, own in plan for k in range(n)]
        assert sorted(x for b in bins for x in b) == [(int(s), k) for s, n in zip(*np.unique(sizes, return_counts=True), strict=True) for k in range(n)]
        fills = sorted(sum(s for s, _ in b) for b in bins)
        assert fills[-1] <= 300 and fills == sorted(packing.best_fit_decreasing(sizes, 300)[2].tolist())


def test_stalled_rounds_end_in_a_plan_of_the_whole(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BINS", 4)
    monkeypatch.setattr(packing, "RANKED", 7)  # several blocks of equal fills
    monkeypatch.setattr(packing, "STALLED", 0.0)  # at once
    texts = {i: " ".join(["word"] * n) for i, n in enumerate([2500] * 60 + [1400] * 30 + [200] * 200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(80)
    rows = packing.packed(docs).collect()
    n = check_packing(rows, texts, library)
    sizes = np.array([r.length for r in rows])
    assert n <= 1.2 * len(packing.best_fit_decreasing(sizes)[2])

"""Retrieval rules on small tables."""

import cProfile
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trovelens.functions import text as fx
from trovelens.operators import fusion, keyword, language, rank, substring, vector
from trovelens.plans import index_store, lifecycle_queries, search_queries
from trovelens.sources import tables


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_names_and_terms(spark):
    assert column(spark, ["docs/MyFile-v2.final_report.txt", "Shot2024.png"], fx.name_words) == ["docs My File v2 final report txt", "Shot2024 png"]
    assert column(spark, ["IMG_0494.JPG", "a1b2c3d4.pdf", "2024-01-02.txt", "Screenshot 1.png", "ñ.txt", "deadbeef.txt", ".env"], fx.is_opaque_name) == [True, True, True, False, False, False, False]
    assert column(spark, ["the Invoice of the CAFÉ café 7 12"], fx.query_terms) == [["invoice", "cafe", "12"]]
    assert column(spark, ['plain words', 'say "hi"', "  "], fx.sanitised) == ['"plain" "words"*', '"say" """hi"""*', ""]
    assert column(spark, ["  a\u2003b \n", "\u00a0"], fx.trim_all) == ["a\u2003b", ""]
    assert column(spark, ["a😀"], fx.utf16_length) == [3]


def hits(spark, **lists):
    return {n: spark.createDataFrame([(1, f, r + 1, 0.5) for r, f in enumerate(ids)], "query_id int, file_id long, rank long, similarity double") for n, ids in lists.items()}


def test_fusion_ties_go_to_the_smaller_file(spark):
    fused = fusion.fuse(hits(spark, keyword=[5, 2], text=[2, 5])).orderBy(F.desc("rrf"), "file_id").collect()
    assert [r.file_id for r in fused] == [2, 5] and fused[0].rrf == pytest.approx(fused[1].rrf)
    one = fusion.fuse(hits(spark, text=list(range(100, 0, -1)))).orderBy(F.desc("rrf")).collect()
    assert [r.file_id for r in one] == list(range(100, 0, -1))


def test_boosts(spark):
    df = spark.createDataFrame([("annual report", "AnnualReport.pdf"), ("café menu", "cafe_menu.txt"), ("", "x"), ("report report", "other.txt")], "q string, n string")
    assert [r[0] for r in df.select(F.round(fusion.filename_boost(F.col("q"), F.col("n")), 3)).collect()] == [1.2, 1.2, 1.0, 1.0]
    now = 10_000_000
    ages = column(spark, [now * 10**9, (now - 30 * 86_400) * 10**9, (now - 15 * 86_400) * 10**9, (now + 99) * 10**9], lambda c: F.round(fusion.recency_boost(c, now), 4), "long")
    assert ages == [1.1, 1.0, 1.05, 1.1]


def small_index(spark, texts):
    chunks = spark.createDataFrame([(i, i // 10, t) for i, t in texts.items()], "chunk_id long, file_id long, text string")
    return keyword.memory_index(chunks)


def test_and_in_one_chunk_last_word_prefix_ties_by_chunk(spark):
    index = small_index(spark, {10: "black bean arepas", 11: "black", 12: "arepas bean", 20: "black bean arepas", 30: "blackarepas"})
    ask = lambda q: [r.chunk_id for r in keyword.bm25(index, spark.createDataFrame([(1, q)], "query_id int, query string")).orderBy(F.desc("score"), "chunk_id").collect()]
    assert ask("black arep") == [10, 20]
    assert ask("arep black") == [] and ask("arepas bla") == [10, 20]
    assert ask("BEÁN") == [12, 10, 20]
    assert [r.chunk_id for r in keyword.phrase_chunks(index, "bean arepas").orderBy("chunk_id").collect()] == [10, 20]


def test_copies_and_strength(spark):
    rows = [(1, 1, 1, "h", "a"), (1, 2, 2, None, "b"), (1, 3, 3, "h", "c"), (1, 4, 4, None, "d")]
    df = spark.createDataFrame(rows, "query_id int, file_id long, rank long, content_hash string, path string")
    got = fusion.collapse_copies(df, 10).orderBy("rank").collect()
    assert [(r.file_id, r.rank, list(r.copies)) for r in got] == [(1, 1, ["c"]), (2, 2, []), (4, 3, [])]
    rows = [(1, 1, False, None, 0.79), (1, 2, False, None, 0.81), (1, 3, True, None, None), (1, 4, False, 0.2, 0.1), (1, 5, False, None, None)]
    df = spark.createDataFrame(rows, "query_id int, rank long, in_keyword boolean, image_similarity double, text_similarity double")
    got = fusion.strong_first(df.withColumn("strength", fusion.strength())).orderBy("position").collect()
    assert [r["rank"] for r in got] == [2, 3, 4, 5, 1]


def test_scale_needs_rows_and_blend_keeps_slots(spark):
    few = spark.createDataFrame([(1, 0.5)] * 19 + [(2, 0.5)] * 20, "query_id int, similarity double")
    got = {r.query_id: (r.mean, r.sd) for r in rank.scale(few).collect()}
    assert got == {1: (None, None), 2: (0.5, rank.SD_FLOOR)}
    rows = [(1, 10, 1, 1.0), (1, 11, 2, None), (1, 12, 3, 9.0)]
    got = rank.blend(spark.createDataFrame(rows, "query_id int, file_id long, rank long, model double")).orderBy("position").collect()
    assert [r.file_id for r in got] == [10, 11, 12]


def test_regressions(spark):
    a = spark.createDataFrame([("en", 0.9), ("es", 0.8), ("kw", 0.7)], "bucket string, mrr double")
    b = spark.createDataFrame([("en", 0.8999), ("es", 0.79), ("img", 0.5)], "bucket string, mrr double")
    assert {r.bucket: r.verdict for r in rank.regressions(a, b).collect()} == {"en": "fine", "es": "regressed", "kw": "gone", "img": "new"}


def test_chunks_of_very_long_files_are_told_apart(spark, tmp_path):
    long_ = " ".join(["plain"] * (tables.CHUNK_STEP * 1002) + ["zebra crossing"])
    docs = [(1, long_), (2, " ".join(["other words"] * 800))]
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    chunks = tables.chunks(spark, str(tmp_path)).cache()
    assert chunks.count() == chunks.select("chunk_id").distinct().count() > 1000
    index = keyword.memory_index(chunks)
    ask = lambda q: [r.file_id for r in keyword.bm25(index, spark.createDataFrame([(1, q)], "query_id int, query string")).collect()]
    assert set(ask("zebra crossing")) == {1} and set(ask("other words")) == {2}
    assert len(ask("other words")) == chunks.filter("file_id = 2 and text like '%other words%'").count()


def test_phrases_are_in_a_row(spark):
    index = small_index(spark, {1: "foo bar", 2: "bar then foo", 3: "foo x bar", 4: "foo barn and foo bar", 5: "foo  bar."})
    ask = lambda q: sorted((r.chunk_id, r.tf) for r in keyword.occurrences(index, spark.createDataFrame([(1, q)], "query_id int, query string")).collect())
    assert ask("foo-bar") == [(1, 1), (4, 2), (5, 1)]  # the last word is a beginning
    assert ask("foo-bar .") == [(1, 1), (4, 1), (5, 1)] and ask("-- .") == []
    assert ask("foo-x-bar") == [(3, 1)]


def test_meaning_subtracts_the_mean_of_centred_scores(spark):
    rows = [(1, i, "text", 0.5 + 0.01 * i) for i in range(30)] + [(1, 100 + i, "image", 0.1 + 0.02 * i) for i in range(3)]
    df = spark.createDataFrame(rows, "query_id int, file_id long, modality string, similarity double")
    every = sum(r[3] for r in rows) / 33
    own = {"text": sum(r[3] for r in rows[:30]) / 30, "image": every}
    d = [r[3] - own[r[2]] for r in rows]
    mean = sum(d) / 33
    sd = max((sum((x - mean) ** 2 for x in d) / 33) ** 0.5, rank.SD_FLOOR)
    got = {r.file_id: r.z for r in rank.meaning_z(df).collect()}
    assert all(got[r[1]] == pytest.approx((x - mean) / sd) for r, x in zip(rows, d, strict=True))
    few = df.filter("file_id < 5")
    assert {round(r.z, 6) for r in rank.meaning_z(few, df.limit(0)).collect()} == {0.0}


def test_words_under_the_gate_count_nothing_if_gated(spark):
    best = spark.createDataFrame([(1, 5, 3.0), (1, 6, 0.5)], "query_id int, file_id long, z double")
    cov = spark.createDataFrame([(1, 5, 0.25), (1, 6, 0.5)], "query_id int, file_id long, coverage double")
    q = spark.createDataFrame([(1, "plain words")], "query_id int, query string")
    score = lambda p: {r.file_id: round(r.score, 6) for r in rank.zfuse(best, cov, q, p).collect()}
    assert score(rank.ZParams()) == {5: 3.25, 6: round(0.5 + 2 * 0.5**1.5, 6)}
    assert score(rank.ZParams(words_gated=True)) == {5: 3.0, 6: round(0.5 + 2 * 0.5**1.5, 6)}


def test_nearest_neighbours_are_exact_and_ties_go_to_the_smaller_id(spark, monkeypatch):
    r = np.random.default_rng(1)
    v = r.integers(0, 3, (500, 4)).astype(float)
    vectors = spark.createDataFrame([(int(999 - i), int(i), [float(x) for x in v[i]]) for i in range(500)], "chunk_id long, file_id long, embedding array<float>").repartition(3)
    q = r.integers(0, 3, (7, 4)).astype(float)
    queries = spark.createDataFrame([(i, [float(x) for x in q[i]]) for i in range(7)], "query_id long, embedding array<float>")
    for batch in (1000, 2):
        monkeypatch.setattr(vector, "BATCH_QUERIES", batch)
        got = {}
        for row in vector.knn(vectors, queries, 20).orderBy("query_id", F.desc("similarity"), "chunk_id").collect():
            got.setdefault(row.query_id, []).append(row.chunk_id)
        for i in range(7):
            sims = np.round(v @ q[i], 9)
            assert got[i] == [999 - k for k in sorted(range(500), key=lambda k: (-sims[k], 999 - k))[:20]]


def test_search_degrades_to_what_is_there(spark):
    chunks = spark.createDataFrame([(1, 1, "body", "red fox", None), (2, 2, "body", "blue fox", 3)], "chunk_id long, file_id long, source string, text string, page long")
    files = spark.createDataFrame([(1, "r", "a.txt", "r/a.txt", 0, "h1"), (2, "r", "b.txt", "r/b.txt", 0, "h2")], "file_id long, root string, file_name string, path string, mtime_ns long, content_hash string")
    roots = spark.createDataFrame([("r", True, "ok")], "root string, enabled boolean, status string")
    store = fusion.Store(keyword.memory_index(chunks), chunks, files, roots)
    q = spark.createDataFrame([(1, "fox"), (2, "  "), (3, "none")], "query_id int, query string")
    got = fusion.search(q, store, 10**9).collect()
    assert sorted((r.query_id, r.file_id, r.page, list(r.match_sources)) for r in got) == [(1, 1, None, ["keyword"]), (1, 2, 3, ["keyword"])]
    assert fusion.search(q, store, 10**9, mode="vector").count() == 0 and fusion.search(q, store, 10**9, limit=0).count() == 0


def test_promising_blocks_give_the_same_best(spark, monkeypatch):
    """With few blocks read first, and many to leave out, the best of each query are those of scoring all."""
    r = np.random.default_rng(11)
    words = ["alpha", "alpine", "beta", "beth", "gamma", "delta", "rare"]
    texts = [" ".join(r.choice(words, size=r.integers(1, 30), p=[0.3, 0.05, 0.3, 0.05, 0.2, 0.09, 0.01])) for _ in range(600)]
    chunks = spark.createDataFrame([(i * 10, i, t) for i, t in enumerate(texts)], "chunk_id long, file_id long, text string")
    index = keyword.memory_index(chunks)
    queries = spark.createDataFrame(enumerate(["alpha beta .", "beta al", "alpha-beta gamma .", "rare gamma .", "gamm", "alphab x", "delta gamma-d"]), "query_id int, query string")
    usable = spark.createDataFrame([(i,) for i in range(600) if i % 7], "file_id long")
    whole = keyword.bm25(index, queries, usable).collect()
    assert len({x.query_id for x in whole}) == 6
    monkeypatch.setattr(keyword, "BLOCK_FILES", 3)
    monkeypatch.setattr(keyword, "FIRST_BLOCKS", 5)
    index = keyword.memory_index(chunks)
    asked = keyword.asked_words(index, queries)
    blocks = keyword.promising(index, asked).count()
    for depth in (1, 10, 200):
        got = keyword.bm25(index, queries, usable, depth).collect()
        for q in range(7):
            order = lambda rows: sorted(((x.score, x.chunk_id) for x in rows if x.query_id == q), key=lambda p: (-p[0], p[1]))[:depth]  # noqa: E731, B023
            assert order(got) == order(whole)
    assert blocks > 200 and len(keyword.bm25(index, queries, usable, 1).collect()) < len(whole)


def test_substrings_begin_and_end_anywhere(spark):
    texts = {1: "the Quickest brown foxes run", 2: "quick brown fox", 3: "a b", 4: "!! --", 5: "Unquickest brown foxglove", 6: "brown"}
    chunks = spark.createDataFrame([(i, i, x) for i, x in texts.items()], "chunk_id long, file_id long, text string")
    index, grams = keyword.memory_index(chunks), None
    grams = substring.vocabulary_grams(index)
    needles = ["ickest brown fox", "brown fox", "row", "t b", "a b", "!! -", "x", "QUICK", "brown foxx", "own"]
    got = substring.containing(index, grams, chunks.select("file_id", "text"), spark.createDataFrame(enumerate(needles), "query_id int, needle string")).collect()
    assert sorted(map(tuple, got)) == sorted((k, i) for k, n in enumerate(needles) for i, x in texts.items() if n in x)


def test_language_by_trigrams(spark):
    rows = [(2 * i, x, lang) for i, (x, lang) in enumerate([("the cat sat on the mat with the hat", "en"), ("le chat est sur la table avec le chien", "fr")] * 6)]
    model = language.model(spark.createDataFrame([*rows, (99, "xx yy", None)], "id long, text string, lang string"))
    asked = [(1, "The mat, the hat", "en"), (3, "le chien est sur la table", "fr"), (5, "12 34", None), (7, None, None), (9, "zzz qqq", None), (11, "the cat est sur la", None)]
    got = language.detected(spark.createDataFrame(asked, "id long, text string, lang string"), model, "id").collect()
    assert {r.id: r.detected for r in got if r.id != 11} == {i: lang for i, _, lang in asked if i != 11} and len(got) == 6
    assert model.columns == ["gram", "en", "fr"]


def test_searches_by_chunk_are_those_word_by_word(spark, monkeypatch):
    """Phrases, beginnings, repeated and shared words in blocks of a few chunks; a depth gives that many rows and no more."""
    monkeypatch.setattr(keyword, "BLOCK_CHUNKS", 7)
    r = np.random.default_rng(5)
    words = ["ab", "abc", "abd", "b", "bc", "Ünï", "x1"]
    texts = [" ".join(r.choice(words, size=r.integers(0, 12))) for _ in range(120)]
    chunks = spark.createDataFrame([(i * 3, i // 4, t) for i, t in enumerate(texts)], "chunk_id long, file_id long, text string").repartition(3)
    index = keyword.memory_index(chunks)
    asked = ["ab-bc .", "ab", "ab ab", "bc ab-b", "ab-ab-a", "uni-x", "b .", "zz ab", "x1 uni-bc ab"]
    queries = spark.createDataFrame(enumerate(asked), "query_id int, query string")
    toks = [t.lower().replace("ü", "u").replace("ï", "i").split() for t in texts]

    def count(tk, phrase, prefix):
        fits = lambda t, p, last: t.startswith(p) if last and prefix else t == p
        return sum(all(fits(tk[i + k], p, k == len(phrase) - 1) for k, p in enumerate(phrase)) for i in range(len(tk) - len(phrase) + 1))

    want = {}
    average = sum(map(len, toks)) / len(toks)
    for q, text in enumerate(asked):
        raw = text.split()
        units = [(w.split("-"), k == len(raw) - 1) for k, w in enumerate(raw) if w != "."]
        tf = [[count(tk, *u) for u in units] for tk in toks]
        df = [sum(x[k] > 0 for x in tf) for k in range(len(units))]
        idf = [max(np.log((len(toks) - d + 0.5) / (d + 0.5)), keyword.IDF_FLOOR) for d in df]
        for i, x in enumerate(tf):
            if all(x):
                want[q, i * 3] = sum(w * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(toks[i]) / average)) for w, n in zip(idf, x, strict=True))
    got = {(h.query_id, h.chunk_id): h.score for h in keyword.bm25(index, queries).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want) and len({q for q, _ in want}) == 8
    few = [(h.query_id, h.chunk_id) for h in keyword.bm25(index, queries, depth=3).collect()]
    assert sorted(few) == sorted((q, c) for q in range(len(asked)) for _, c in sorted((-s, c) for (p, c), s in got.items() if p == q)[:3])
    assert "Exchange" not in keyword.matched(index, keyword.terms_of(queries)).met._jdf.queryExecution().executedPlan().toString()


def test_words_are_looked_up_as_columns():
    """How much Python runs for a block of chunks does not depend on how many distinct words it has."""

    def calls(n: int) -> int:
        lists = pa.array([[f"w{i}" for i in range(a, a + 100)] for a in range(0, n, 100)], pa.list_(pa.string()))
        ids = pa.array(range(len(lists)), pa.int64())
        run = keyword._matching([(("w7", False),), (("w12", True),), (("w8", False), ("w", True))], [[0], [1], [2]])
        seen = cProfile.Profile()
        got = seen.runcall(lambda: [r for b in run(iter([pa.RecordBatch.from_arrays([ids, ids, lists], names=["chunk_id", "file_id", "tokens"])])) for r in b.to_pylist()])
        assert got[0] == {"chunk_id": 0, "file_id": 0, "n_tokens": 100, "units": [0, 1, 2], "tfs": [1, 1, 1], "asks": [0, 1, 2]}
        assert [r["units"] for r in got[1:3]] == [[1], [1]][: n // 100 - 1]
        return sum(x.callcount for x in seen.getstats())

    calls(100)  # what is imported and made ready at the first call
    assert calls(20_000) < calls(200) + 10_000


def test_hits_are_scored_in_blocks_and_files_are_left_out_before(spark, monkeypatch):
    """Blocks of three chunks, words of queries without an answer in between; what meets the files are chunks, not their hits."""
    monkeypatch.setattr(keyword, "SCORED_CHUNKS", 3)
    index = small_index(spark, {i * 10: t for i, t in enumerate(["ab x1", "ab", "x1 ab ab", "ab zz", "x1", "b ab x1"] * 5)})
    asked = ["ab", "x1 none", "ab ab", "a", "b .", "x1 ab"]
    queries = spark.createDataFrame(enumerate(asked), "query_id int, query string")
    alone = {(q, h.chunk_id): h.score for q, text in enumerate(asked) for h in keyword.bm25(index, spark.createDataFrame([(q, text)], "query_id int, query string")).collect()}
    assert {(h.query_id, h.chunk_id): h.score for h in keyword.bm25(index, queries).collect()} == alone and len(alone) == 25 * 3 + 5 + 15
    usable = spark.createDataFrame([(i,) for i in range(0, 30, 2)], "file_id long")
    some = keyword.bm25(index, queries, usable)
    assert {(h.query_id, h.chunk_id): h.score for h in some.collect()} == {k: s for k, s in alone.items() if k[1] // 10 % 2 == 0}
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("LeftSemi")


def test_tokens_of_plain_texts_are_those_of_others(spark):
    assert column(spark, ["It's 2 A-B_c", "", "É 2 A-B_c", "\x00x\x7fy"], fx.tokens) == [["it", "s", "2", "a", "b", "c"], [], ["e", "2", "a", "b", "c"], ["x", "y"]]


def test_what_reads_no_words_builds_no_keyword_index(spark, tmp_path):
    rows = [(i, f"some words {i}", "en", f"src{i % 3}", 9) for i in range(1, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], i) for i in range(1, 7)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert tuple(lifecycle_queries.root_remove(spark, str(tmp_path)).first()) == (2, 4, 8, 2)
    assert index_store.index(spark, str(tmp_path), words=False).keyword is None
    store = index_store.index(spark, str(tmp_path))
    assert store.keyword.chunks == 12 and index_store.index(spark, str(tmp_path), words=False) is store


def test_the_index_stores_a_chunks_tokens_as_one_text(spark):
    """What is written, read and handed to Python for each chunk is one value, however many tokens it has."""
    texts = ["It's 2 A-B_c", "", None, " \t", "É 2 A-B_c", "\x00x\x7fy", "éa ́ b", "straße ΣΑΣ ١٢ 你好，世界", "--", "a b c"]
    chunks = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "chunk_id long, file_id long, text string")
    rows = {r.chunk_id: r for r in keyword.tokens_of(chunks).collect()}
    assert dict(keyword.tokens_of(chunks).dtypes) == {"chunk_id": "bigint", "file_id": "bigint", "words": "string", "n_tokens": "int"}
    for i, own in enumerate(column(spark, texts, fx.tokens)):
        assert rows[i].words == " ".join(own or []) and rows[i].n_tokens == len(own or [])
    assert {(r.chunk_id, r.n_tokens) for r in keyword.memory_index(chunks).postings.collect()} == {(i, r.n_tokens) for i, r in rows.items() if r.n_tokens}


def test_chunks_are_cut_by_pieces_of_many_words(spark):
    """The same chunks as word by word, at every length around the borders and with any white space; a text becomes a fiftieth of as many values."""
    size, step = tables.CHUNK_WORDS, tables.CHUNK_STEP
    lengths = [0, 1, 49, 50, 51, 399, 400, 401, 450, 451, 749, 750, 751, 1100, 1101]
    gaps = [" ", "\n\n", " \t", "　 ", "  ", "\r\n"]
    texts = ["".join(["\n "] + [f"w{i}" + gaps[(i * n) % 6] for i in range(n)]) for n in lengths] + [" ", " ", None]
    files = spark.createDataFrame([(i, f"a/{i}.txt", t or "") for i, t in enumerate(texts)], "file_id long, path string, text string")
    got = {}
    for r in tables.chunks_of(files).filter("source <> 'filename'").orderBy("chunk_id").collect():
        got.setdefault(r.file_id, []).append(r.text)
    for i, t in enumerate(texts):
        units = re.findall(r"[^ \t-\r]+[ \t-\r]*", t or "")
        n = 0 if not units else 1 if len(units) <= size else 1 + -(-(len(units) - size) // step)
        assert got.get(i, []) == ["".join(units[k * step : k * step + size]).strip() for k in range(n)]
    longest = column(spark, [" ".join(["word"] * 1101)], tables.word_pieces)[0]
    assert len(longest) == 23


def test_searches_by_words_move_neither_files_nor_chunks(spark, tmp_path):
    """Tokens say their file's root, so that what was met is not exchanged to meet the files, however many these are; nor are files to meet what was found."""
    rows = [(i, f"pale river {'stone' if i % 2 else 'boat'} {i}", "en", f"src{i % 6}", 9) for i in range(1, 40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], i) for i in range(1, 40)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "a pale river"), (2, "a river stones"), (3, "a stone boat river")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    store, q = search_queries._ask(spark, str(tmp_path))
    words = keyword.keyword_list(store.keyword, q, store.files, store.roots)
    covered = keyword.coverage(store.keyword, rank.term_rows(q), store.files, store.roots)
    assert not set(store.files.inputFiles()) & {*words.inputFiles(), *covered.inputFiles()}
    on = [r for r in rows if r[3] not in ("src3", "src5")]
    assert sorted((r.query_id, r.file_id) for r in words.collect()) == [(1, r[0]) for r in on] + [(2, r[0]) for r in on if r[0] % 2]
    plain = store.keyword._replace(tokens=store.keyword.tokens.drop("root"))  # as in an index whose tokens don't say it
    for a, b in ((words, keyword.keyword_list(plain, q, store.files, store.roots)), (covered, keyword.coverage(plain, rank.term_rows(q), store.files, store.roots))):
        assert sorted(map(tuple, a.select(sorted(a.columns)).collect())) == sorted(map(tuple, b.select(sorted(b.columns)).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "SortMergeJoin" not in search_queries.filename_boost(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

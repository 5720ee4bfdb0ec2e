"""Extraction, index state, passages, storage and streams."""

import io
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovelens.operators import embed, extract, lifecycle, passages
from trovelens.plans.components import components
from trovelens.sources import walk
from trovelens.streaming import files as streams


def test_greedy_chunks():
    words = [f"w{i}" for i in range(1000)]
    got = extract.greedy_chunks(" ".join(words))
    assert [len(c.split()) for c in got] == [400, 400, 300] and got[1].split()[0] == "w350"
    assert len(extract.greedy_chunks(" ".join(words[:400]))) == 1 and extract.greedy_chunks("  ") == []
    assert extract.greedy_chunks("aa bb cc", most=1, count=lambda w: 500) == ["aa", "bb", "cc"]


def test_office_and_code():
    def packed(parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, x in parts.items():
                z.writestr(n, x)
        return out.getvalue()

    doc = packed({"word/document.xml": '<d xmlns:w="u"><w:p><w:t>One</w:t><w:t> two</w:t></w:p><w:p><w:t>three</w:t></w:p></d>'})
    assert extract.office_pages(doc) == ["One two\nthree"]
    deck = packed({f"ppt/slides/slide{n}.xml": f'<d xmlns:a="u"><a:p><a:t>s{n}</a:t></a:p></d>' for n in (10, 2)})
    assert extract.office_pages(deck) == ["s2", "s10"]
    got = extract.code_chunks("import a\n\ndef f():\n    return 1\n\nclass B:\n    pass\n", "py")
    assert [(c["line_start"], c["line_end"]) for c in got] == [(1, 7)]
    assert extract.extract_one("x.png", "image", b"x")[0]["error"]
    assert extract.extract_one("x.docx", "office", b"no zip")[0]["error"]


def test_decode_and_language():
    assert extract.decode_text("é".encode()) == "é" and extract.decode_text(b"\xe9") == "é" and extract.decode_text("e\u0301".encode("utf-16")) == "é"
    assert extract.detect_language("the cat and the dog sat in that house for the night") == "en"
    assert extract.detect_language("xyzzy") is None


def test_walk_and_queries(spark, tmp_path):
    for p in ("a.txt", "node_modules/b.txt", ".hidden", "deep/c.py", "My.app/Contents/x", "_under.md", "d.tmp"):
        f = tmp_path / "root" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    got = {r.rel_path: r.is_dir for r in walk.walk(spark, [str(tmp_path / "root")]).collect()}
    assert got == {"a.txt": False, "deep/c.py": False, "My.app": True, "_under.md": False}
    (tmp_path / "q.jsonl").write_text('{"query": "a", "lang": "en", "expected": ["x"]}\n\n{"query": "b", "lang": "neg", "expected": []}\n')
    assert [r.query for r in walk.labelled_queries(spark, f"file://{tmp_path}/q.jsonl").collect()] == ["a", "b"]


def test_embedders(spark):
    df = spark.createDataFrame([(1, "red green"), (2, "green RED"), (3, ""), (4, None)], "id long, text string")
    got = {r.id: np.array(r.embedding) for r in embed.hash_embed(df, "id", "text").collect()}
    assert np.allclose(got[1], got[2]) and abs(np.linalg.norm(got[1]) - 1) < 1e-9 and not got[3].any() and not got[4].any()
    assert embed.length_batches([1] * 17 + [200]) == [0] * 16 + [1, 2]

    def make():
        def model(texts):
            if "bad" in texts:
                raise ValueError("bad")
            return np.ones((len(texts), 2), np.float32)

        return model

    embed.register_model("toy", 2, make)
    got = {r.id: (r.embedding, r.error) for r in embed.model_embed(spark.createDataFrame([(1, "ok"), (2, "bad")], "id long, text string"), "id", "text", "toy").collect()}
    assert got[1] == ([1.0, 1.0], None) and got[2] == (None, "bad")


def test_moves_are_one_to_one(spark):
    new = spark.createDataFrame([("b", 1, "text", "h"), ("a", 1, "text", "h"), ("c", 2, "text", "h")], "path string, size long, kind string, content_hash string")
    old = spark.createDataFrame([(7, 1, "text", "h"), (9, 1, "text", "h"), (8, 1, "text", None)], "file_id long, size long, kind string, content_hash string")
    assert {(r.path, r.file_id) for r in lifecycle.moves(new, old).collect()} == {("a", 7), ("b", 9)}


@pytest.mark.parametrize("age,previous,want", [(0, None, ("defer", 3_000_000_000)), (2_500_000_000, None, ("defer", 1_000_000_000)), (4_000_000_000, None, ("watch", 1_000_000_000)), (4_000_000_000, 5, ("extract", 0)), (4_000_000_000, 6, ("defer", 5_000_000_000)), (-5_000_000_000, 5, ("extract", 0)), (-1_000_000_000, 5, ("defer", 3_000_000_000))])
def test_stability_forms_agree(spark, age, previous, want):
    now = 10**18
    assert streams.settle(now - age, now, 5, previous) == want
    prev = F.lit(previous).cast("long")
    r = spark.range(1).select(lifecycle.stability(F.lit(now - age), F.lit(now), F.lit(5), prev).alias("d")).first().d
    assert (r.decision, r.wait_ns) == want


def test_passages():
    assert passages.overlap("the quick brown fox", "brown fox jumps") == len("brown fox") and passages.overlap("the quick own fox", "wn fox jumps") == 0
    assert passages.whole(["the quick brown fox", "brown fox jumps", " ", "else"], 100) == ("the quick brown fox jumps\n\nelse", False)
    assert passages.whole(["abc", "déf"], 6) == ("abc\n\nd", True)
    assert passages.clip("a😀b", 2) == "a" and passages.utf16("a😀b") == 4
    assert passages.pick([(5, "x" * 300), (1, "y" * 300), (9, "z" * 300)], 850) == [(1, "y" * 300), (5, "x" * 300), (9, "z" * 246)]
    assert passages.pick([(0, "x" * 3900), (1, "y" * 500)], 4000) == [(0, "x" * 3900)]
    assert passages.pick([(3, "  " + "x" * 300), (0, " ")], 100) == [(3, "x" * 100)] and passages.pick([(0, "x" * 3900), (1, "y" * 50)], 4000) == [(0, "x" * 3900), (1, "y" * 50)]
    assert passages.whole_budget(0) == 120_000 and passages.whole_budget(5) == 112_000
    assert [len(x) for x in passages.payload(["p"], [["a" * 70_000], ["b" * 70_000]])] == [1, 60_000, 56_000]


def test_components_of_a_hub(spark):
    """A hub and a giant component hold most rows of every join."""
    links = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)] + [(9000, 9001), (9001, 9000), (9002, 9002), (2999, 5020)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {**{i: 0 for i in [*range(3000), *range(5000, 5041)]}, 9000: 9000, 9001: 9000}


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[101] == 100


def test_files_are_read_cut_and_named(spark):
    long_csv = ("é,1\n" * 40_000).encode()
    rows = [
        ("r/MyNote.txt", b"hello world", False, False), ("r/data.csv", long_csv, False, False), ("r/pic", b"\x89PNG\r\n", False, False), ("r/x.bin", b"??", False, False),
        ("r/c.txt", b"", True, False), ("r/a.app", b"", False, True), ("r/big.txt", b"x" * 5000, False, False),
    ]
    df = spark.createDataFrame([(p, p[2:], 10**9 if "big" in p else len(d), c, b, bytearray(d)) for p, d, c, b in rows], "path string, rel_path string, size long, cloud_only boolean, is_dir boolean, content binary")
    out, chunks = extract.read_files(df, ["text", "image"])
    got = {r.path: (r.kind, r.plan, r.skip_reason, r.state) for r in out.collect()}
    assert got["r/MyNote.txt"] == ("text", "extract", None, "indexed") and got["r/pic"] == ("image", "extract", None, "error") and got["r/x.bin"] == ("other", "name_only", None, "indexed")
    assert got["r/c.txt"][1:3] == ("skip", "cloud_only") and got["r/a.app"][1:3] == ("skip", "bundle") and got["r/big.txt"][1:3] == ("skip", "too_large")
    by = {}
    for r in chunks.orderBy("path", "ordinal").collect():
        by.setdefault(r.path, []).append((r.source, r.text))
    assert by["r/MyNote.txt"] == [("body", "hello world"), ("filename", "My Note txt")] and set(by) == set(got) and all(c[-1][0] == "filename" for c in by.values())
    assert sum(len(t.encode()) for s, t in by["r/data.csv"] if s == "body") < 1.3 * extract.PREFIX_BYTES
    assert extract.data_head(b"ab\ncd\nef", 7) == b"ab\ncd\n" and extract.data_head(b"abcdef", 3) == b"abc"
    pre = spark.createDataFrame([(bytearray("é1\né2\né3".encode()),)], "c binary").select(extract.data_prefix(F.col("c"), 9).alias("p")).first().p
    assert bytes(pre) == "é1\né2\n".encode()


def test_slow_files_are_errors(monkeypatch):
    import time

    monkeypatch.setitem(extract._SEAMS, "pdf", lambda path, data: time.sleep(5) or [])
    assert "over 1 s" in extract.extract_within("a.pdf", "pdf", b"", 1)[0]["error"]


def test_pdf_pages():
    import zlib

    draw = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Hello \\(big\\) ) Tj [(wor) -20 (ld)] TJ T* <c9> Tj ET")
    objects = [b"<< /Type /Catalog >>", b"<< /Type /Pages /Kids [3 0 R 5 0 R] >>", b"<< /Type /Page /Contents 4 0 R >>", b"<< /Filter /FlateDecode /Length 9 >> stream\n" + draw + b"\nendstream", b"<< /Type /Page /Contents [6 0 R] >>", b"<< /Length 3 >> stream\nBT (two) Tj ET\nendstream"]
    data = b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj %s endobj" % (k, o) for k, o in enumerate(objects, 1))
    assert extract.pdf_pages(data) == ["Hello (big) world\nÉ", "two"]
    got = extract.extract_one("a.pdf", "pdf", data)
    assert [(c["page"], c["text"]) for c in got] == [(1, "Hello (big) world\nÉ"), (2, "two")]
    assert extract.extract_one("a.pdf", "pdf", data + b"/Encrypt")[0]["error"] == "ValueError: password"
    packed = b"%PDF-1.5\n1 0 obj <</Type/ObjStm/N 1>> stream\nx\nendstream endobj"
    assert extract.extract_one("a.pdf", "pdf", packed)[0]["error"] == "ValueError: no_pages"
    page = b"1 0 obj <</Type /Page /Contents 2 0 R>> endobj 2 0 obj <<%s>> stream\nBT (Hi (nested) x) Tj ET\nendstream endobj"
    assert extract.pdf_pages(page % b"") == ["Hi (nested) x"]
    assert extract.extract_one("a.pdf", "pdf", page % b"/Filter [/ASCII85Decode /FlateDecode]")[0]["error"] == "ValueError: filter"


def test_pictures():
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (300).to_bytes(4, "big") + (200).to_bytes(4, "big")
    assert extract.image_size(png) == (300, 200) and extract.image_size(b"GIF89a" + bytes([7, 0, 9, 0])) == (7, 9)
    assert extract.image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x06\x03") == (6, 5)

    def broken(data):
        raise RuntimeError

    assert [(c["source"], c["text"]) for c in extract.image_extractor(lambda d: ["http://x", "y"], lambda d: "- a b -")("p", png)] == [("qr", "http://x"), ("qr", "y")]
    assert [(c["source"], c["text"]) for c in extract.image_extractor(broken, lambda d: "some text")("p", png)] == [("ocr", "some text")]
    huge = png[:16] + (10**6).to_bytes(4, "big") * 2
    assert extract.image_extractor()("p", huge) == [{"error": "image_too_large"}]
    boxes = extract.tiles(300, 200)
    assert len(boxes) == 4 and boxes[0][:2] == (0, 0) and boxes[-1][2:] == (300, 200)
    seen = []
    got = extract.code_payloads("big", 300, 200, lambda p, n: f"{p}/{n}", lambda p, box: "tile", lambda p: seen.append(p) or (["a"] if p == "big/4" else ["a", "b"] if p == "tile" else []))
    assert got == ["a", "b"] and seen == ["big", "big/2", "big/4", *["tile"] * 4]


def test_globs():
    hit = lambda g, p: bool(re.match(extract.glob_pattern(g), p, re.S))
    assert hit("*.[ch]", "a/b.c") and not hit("*.[!ch]", "b.c") and hit("{a,b}/*.txt", "b/x/y.txt") and not hit("{a,b}", "c") and hit("a?c", "a.c") and hit("**/x/**", "x/y")
    for bad in ("[a", "{a,b"):
        with pytest.raises(ValueError):
            extract.glob_pattern(bad)


def test_rows_of_boxes(spark):
    boxes = [("i", 50.0, 0.0, 10.0, "b"), ("i", 0.0, 3.0, 10.0, "a"), ("i", 0.0, 20.0, 10.0, "c"), ("j", 0.0, 0.0, 1.0, "x")]
    df = spark.createDataFrame(boxes, "image string, x double, y double, height double, text string")
    assert [(r.text, r.row) for r in extract.reading_order(df).filter("image = 'i'").orderBy("place").collect()] == [("a", 0), ("b", 0), ("c", 1)]
    assert [r.text for r in extract.ocr_chunks(spark.createDataFrame([("p", "a-b-c"), ("p", "abc 123")], "path string, text string")).collect()] == ["abc 123"]


def test_vectors_of_chunks(spark):
    def make():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad")
            assert all(t.startswith(embed.PASSAGE) or t.startswith(embed.QUERY) for t in texts)
            return np.ones((len(texts), 2), np.float32)

        return model

    embed.register_model("prefixed", 2, make)
    chunks = spark.createDataFrame([(1, 1, "body", "fine"), (2, 1, "filename", "n"), (3, 2, "body", "bad"), (4, 2, "filename", "n")], "chunk_id long, file_id long, source string, text string")
    vectors, failed = embed.chunk_vectors(chunks, "prefixed")
    assert sorted(r.chunk_id for r in vectors.collect()) == [1, 2, 4] and [(r.file_id, r.error) for r in failed.collect()] == [(2, "bad")]
    with pytest.raises(RuntimeError):
        embed.chunk_vectors(chunks.withColumn("text", F.lit("bad")), "prefixed")
    queries = spark.createDataFrame([(1, "what"), (2, " ")], "query_id long, query string")
    got = {r.query_id: (r.text_vector, r.image_vector) for r in embed.query_vectors(queries, "prefixed").collect()}
    assert got == {1: ([1.0, 1.0], None), 2: (None, None)}
    embed.register_reranker("length", lambda: lambda query, docs: [float(len(d)) for d in docs])
    hits = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, file_id long, rank long")
    documents = spark.createDataFrame([(5, "abc"), (6, "abcdef")], "file_id long, document string")
    assert {r.file_id: r.model for r in embed.reranked(hits, documents, queries, "length").collect()} == {5: 3.0, 6: 6.0}


def run_stream(spark, tmp_path, build, batches, schema, name):
    src = f"{tmp_path}/{name}"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{src}/b{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}_ck").outputMode("update" if name == "gate" else "append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive
    return spark.table(name).collect()


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, streams.STATE_PROVIDER)
    yield
    spark.conf.unset(key)


def test_bursts(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    rows = [("r", "a", "write", at(1)), ("r", "b", "write", at(2)), ("r", "a", "access", at(3)), ("r", "c", "overflow", at(9)), ("r", "z", "write", at(50))]
    rows = [(r, p, k, __import__("datetime").datetime.fromisoformat(t)) for r, p, k, t in rows]
    got = run_stream(spark, tmp_path, streams.debounced_paths, [rows[:4], rows[4:]], "root string, path string, kind string, ts timestamp", "bursts")
    assert sorted((sorted(r.paths), r.rescan) for r in got) == [(["a", "b"], False), (["c"], True)]


def test_held_deletions_stream(spark, tmp_path, rocks):
    import datetime as d

    at = lambda s: d.datetime(2024, 1, 1) + d.timedelta(seconds=s)
    batches = [[(1, "vanished", at(0)), (2, "vanished", at(0))], [(1, "seen", at(3))], [(9, "seen", at(30))], [(9, "seen", at(60))]]
    got = run_stream(spark, tmp_path, streams.held_deletions, batches, "file_id long, kind string, ts timestamp", "held")
    assert [r.file_id for r in got] == [2]


def test_gate_stream(spark, tmp_path, rocks):
    s = 10**9
    batches = [[(1, 0, 1 * s, 5)], [(1, 0, 10 * s, 5)], [(1, 0, 11 * s, 5)], [(1, 0, 20 * s, 5)]]
    got = run_stream(spark, tmp_path, streams.stability_gate, batches, "file_id long, mtime_ns long, now_ns long, size long", "gate")
    assert [r.decision for r in sorted(got, key=lambda r: r.now_ns)] == ["defer", "watch", "extract", "watch"]


def test_files_share_batches_when_they_are_put_together(spark):
    """Neither whole files nor picked passages cost a call for each file, nor a file's overlap more than its bytes bound."""
    rows = [(i, k, f"tail{i} word{k} word{k + 1}") for i in range(1200) for k in (1, 0, 2)]
    df = spark.createDataFrame(rows, "file_id long, ordinal long, text string")
    texts, sent = passages.whole_texts(df), passages.picked(df.withColumn("place", 3 - F.col("ordinal")), 4000)
    for made in (texts, sent):
        assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()
    want = {i: "\n\n".join(f"tail{i} word{k} word{k + 1}" for k in range(3)) for i in range(1200)}
    assert {r.file_id: r.text for r in texts.collect()} == want == {r.file_id: r.text for r in sent.collect()}

    class Counted(str):
        seen = 0

        def __getitem__(self, at):
            got = str.__getitem__(self, at)
            Counted.seen += len(got)
            return Counted(got)

        def __iter__(self):
            for c in str.__iter__(self):
                Counted.seen += 1
                yield c

    assert passages.overlap("x é", Counted("é " + "y" * 1_000_000)) == 1 and Counted.seen < 100_000

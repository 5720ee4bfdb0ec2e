import pytest
from pyspark.sql import functions as F

from trovelens.operators import presentation as p


def test_snippets_and_highlights(spark):
    text = " ".join(f"w{i}" for i in range(30)) + " the Café menú here"
    plain = lambda t: t.replace(p.OPEN, "[").replace(p.CLOSE, "]")
    got = plain(p.marked_snippet(text, "cafe men"))
    assert got.startswith("...") and "[Café] [menú]" in got and len(got.split(" ")) == p.WINDOW and not got.endswith("...")
    assert plain(p.marked_snippet("short text", "text")) == "short [text]" and p.marked_snippet("nothing here", "else") == "nothing here"
    # A phrase is one mark; a word of the query that is no phrase of the text is none.
    assert plain(p.marked_snippet("bar foo, foo bar and foo", "foo-bar x")) == "bar foo, [foo bar] and foo"
    # Two phrases count more than one that is there twice; a sentence is shown from its beginning.
    long_ = "red red " + "x " * 20 + "red and blue " + "y " * 20
    assert "[red] and [blue]" in plain(p.marked_snippet(long_, "red blue"))
    assert plain(p.marked_snippet("z " * 30 + "end. The one word is here and more of it follows after", "word")).startswith("...The one [word]")
    assert plain(p.marked_snippet("", "a")) == ""
    h = spark.range(1).select(p.highlights(F.lit(f"é {p.OPEN}ab{p.CLOSE} c {p.OPEN}d{p.CLOSE}")).alias("h")).first().h
    assert h.text == "é ab c d" and [list(x) for x in h.highlights] == [[3, 5], [8, 9]]


def test_settings_and_roots(spark):
    base = {"indexing": {"hidden": False, "exclude_globs": ["*.o"]}, "models": {}, "ui": {"theme": "a"}, "secret": 1}
    assert p.patched(base, {"ui": {"theme": "b"}})["ui"]["theme"] == "b" and base["ui"]["theme"] == "a"
    for bad in ({"secret": 2}, {"ui": {"nope": 1}}):
        with pytest.raises(KeyError):
            p.patched(base, bad)
    with pytest.raises(ValueError):
        p.patched(base, {"indexing": {"exclude_globs": ["[a"]}})
    assert p.root_added(["/a/b", "/c"], "/a/") == (["/c", "/a"], ["/a/b"])
    with pytest.raises(ValueError):
        p.root_added(["/a"], "/a/x")
    files = spark.createDataFrame([("/a/b", "/a/b/f", "f"), ("/c", "/c/g", "g")], "root string, path string, rel_path string")
    assert {tuple(r) for r in p.repointed(files, ["/a/b"], "/a").collect()} == {("/a", "/a/b/f", "b/f"), ("/c", "/c/g", "g")}
    assert p.limit_of(None, 30) == 30 and p.limit_of(9999, 1) == 500 and p.workers(12, 16) == 4


def test_rows(spark):
    df = spark.createDataFrame([(["keyword", "semantic"], ["a", "b"], ["b", "x", "b"])], "s array<string>, sent array<string>, reply array<string>")
    r = df.select(p.shown_sources(F.col("s")), p.cited(F.col("sent"), F.col("reply")), p.index_state(F.lit(False), F.lit(False), F.lit(3)), p.one_line(F.lit("a\r\nb"))).first()
    assert list(r) == [["keyword"], ["b"], "indexing", "a  b"]

"""An index kept through changes is the index of what is left."""

import pytest
from pyspark.sql import functions as F

from trovelens.operators import fusion, keyword
from trovelens.plans.kept_index import KeptIndex


@pytest.fixture()
def put(spark, tmp_path):
    """Puts files {id: [texts of chunks]} and deletes others; knows what should be there."""
    index, there = KeptIndex(spark, f"file://{tmp_path}/index"), {}

    def change(files, deleted=()):
        rows = [(i, f"r/{i}", "r", f"{i}.txt") for i in files]
        chunks = [(i * 100 + k, i, "body", x) for i, texts in files.items() for k, x in enumerate(texts)]
        vectors = [(c, i, [float(c), 1.0]) for c, i, _, _ in chunks]
        f = spark.createDataFrame(rows, "file_id long, path string, root string, file_name string")
        c = spark.createDataFrame(chunks, "chunk_id long, file_id long, source string, text string")
        v = spark.createDataFrame(vectors, "chunk_id long, file_id long, embedding array<double>")
        index.change(f, c, v, v.select("file_id", F.col("file_id").alias("chunk_id"), "embedding").limit(0), spark.createDataFrame([(i,) for i in deleted], "file_id long"))
        there.update(files)
        for i in deleted:
            there.pop(i, None)

    return index, there, change


def same_as_fresh(spark, index, there):
    chunks = spark.createDataFrame([(i * 100 + k, i, x) for i, texts in there.items() for k, x in enumerate(texts)], "chunk_id long, file_id long, text string")
    fresh = keyword.memory_index(chunks)
    roots = spark.createDataFrame([("r", True, "ok")], "root string, enabled boolean, status string")
    store = index.open(roots)
    sets = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert sets(store.chunks, "chunk_id", "text") == sets(chunks, "chunk_id", "text") and sets(store.files, "file_id") == [(i,) for i in sorted(there)]
    assert sets(store.text_vectors, "chunk_id", "root", "mute") == [(c, "r", False) for c, in sets(chunks, "chunk_id")]
    assert sets(store.keyword.postings, "term", "chunk_id", "tf", "positions") == sets(fresh.postings, "term", "chunk_id", "tf", "positions")
    assert sets(store.keyword.vocabulary, "term", "n_chunks") == sets(fresh.vocabulary, "term", "n_chunks")
    assert sets(store.keyword.prefixes, "prefix", "n_chunks") == sets(fresh.prefixes, "prefix", "n_chunks")
    assert (store.keyword.chunks, store.keyword.average) == (fresh.chunks, pytest.approx(fresh.average))
    q = spark.createDataFrame([(1, "red fo"), (2, "den"), (3, "red-fox")], "query_id int, query string")
    assert sets(keyword.bm25(store.keyword, q), "query_id", "chunk_id", "score") == sets(keyword.bm25(fresh, q), "query_id", "chunk_id", "score")
    return store


def test_changes_are_a_fresh_index(spark, put):
    index, there, change = put
    with pytest.raises(FileNotFoundError):
        index.open(None)
    change({i: [f"red fox {i}", "den of the fox", ""] for i in range(1, 9)})
    same_as_fresh(spark, index, there)
    change({9: ["red folder"], 2: ["blue fox", "den of the fox"]}, deleted=[3, 77])  # one is new, one changed, one gone
    assert len(index.parts()) == 2
    same_as_fresh(spark, index, there)
    change({}, deleted=[9])
    change({3: ["again a fox"]})
    same_as_fresh(spark, index, there)
    before = index.parts()
    index._write("part_torn", {"chunks": index.live("chunks")})  # a change that did not come to its end
    same_as_fresh(spark, KeptIndex(spark, index.path), there)
    with pytest.raises(Exception, match="(?i)exists"):
        index._commit(before[-1])  # another writer was first
    index.merge(whole=True)
    assert len(index.parts()) == 1
    store = same_as_fresh(spark, index, there)
    roots = store.roots
    found = fusion.search(spark.createDataFrame([(1, "again", [3.0, 1.0])], "query_id int, query string, embedding array<double>"), store._replace(files=store.files.withColumns({"mtime_ns": F.lit(0).cast("long"), "content_hash": F.col("path")}), chunks=store.chunks.withColumn("page", F.lit(None).cast("long"))), 0)
    assert found.filter("in_keyword").select("file_id").collect()[0].file_id == 3 and roots.count() == 1
    with pytest.raises(ValueError):
        index.change(store.files.limit(0), store.chunks.limit(0), store.text_vectors.select("chunk_id", "file_id", "embedding").limit(1), store.image_vectors)

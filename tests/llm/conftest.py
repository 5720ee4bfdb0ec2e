import pytest
from pyspark.sql import functions as F

EXTRA = "kept boolean, keep_id string, component_id string, score string, bin string, rep string, text_sha256 string"
#: Names that operators use or once used for themselves, and odd ones.
INNER = "_own _fa _fb _stays _again _digest _salt own fa fb a b stays again digest whole id said n k key row rank part end node of_a of_b a.b `q` x"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empties, white space, repeats, ties, a long text and extra columns with clashing names."""
    long_ = " ".join(f"word{i % 977} and{i % 31}." for i in range(60_000))
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One  two\nthree"), (6, "one two three"), (7, long_), (8, long_), (8, long_), (None, "no id at all here"),
        (9, "a\u00a0b \u2028 c \x1c d"), (10, "'s <|endoftext|> x\\</s> [INST]"), (11, "日本語のテキスト。" * 50), (12, "x" * 5000), (13, "same words " * 200), (13, "same words " * 200),
    ]
    rows = [(i, t, None if (i or 0) % 3 == 0 else "en", None, None if t is None else len(t)) + (True, "a", "b", "c", "d", "e", "f") for i, t in texts]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)
    return df.withColumns({name: F.lit(name) for name in INNER.split()})


@pytest.fixture(scope="session")
def no_documents(spark, odd_documents):
    return spark.createDataFrame([], odd_documents.schema)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"

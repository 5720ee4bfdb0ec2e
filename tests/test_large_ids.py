"""Ids whose times of change in nanoseconds are no longs: tables with millions of documents have them."""

import duckdb
import pytest

from test_entry import SF, plain
from trovelens import catalogue

#: Over 2,089,825, and divisible by what rules ask ids to be divided by.
SHIFT = 3_603_600
IDS = {"documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id", "benchmark": "item_id"}


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """The smallest tables with large ids."""
    path = tmp_path_factory.mktemp("far")
    for table, key in IDS.items():
        duckdb.sql(f"COPY (SELECT * REPLACE (({key} + {SHIFT})::BIGINT AS {key}) FROM '{SF}/{table}.parquet') TO '{path}/{table}.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["kept_vocabulary", "kept_search", "z_search", "eval_metrics", "substring_lookup", "strength_sweep", "eval_modes", "hit_rows", "scan_diff"])
def test_query_equals_its_sql_on_large_ids(spark, far, name):
    con = duckdb.connect()
    for table in IDS:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{far}/{table}.parquet'")
    sql = catalogue.ORACLE_SQL[name]
    want = con.sql(sql.replace("doc_id * 3600000000000", "doc_id::HUGEINT * 3600000000000"))  # the same numbers, which overflow as longs
    got = catalogue.QUERIES[name](spark, far)
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=repr)
    assert rows and rows == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["whole_file", "passage_budget"])
def test_texts_are_those_of_small_ids(spark, far, name):
    rows = lambda path, shift: sorted(tuple(r[c] + shift if c == "file_id" else r[c] for c in r.__fields__) for r in catalogue.QUERIES[name](spark, path).collect())
    got = rows(far, 0)
    assert got and got == rows(SF, SHIFT)

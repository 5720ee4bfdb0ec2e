"""The driver's contract, with and without the optional subpackage, and queries against their SQL."""

import datetime
import decimal
import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from trovelens import catalogue

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=repr)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "rank" in df.columns


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_parts(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from trovelens.plans.lineage import shared_dir

    def session(master, folder=None):
        conf = {"spark.checkpoint.dir": folder} if folder else {}
        return SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert shared_dir(session("local[2]")).startswith("file://")
    for master in ("yarn", "spark://a:1", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))


def test_runner(spark, capsys):
    from trovelens.__main__ import main

    assert main(["list"]) == 0 and "hybrid_search" in capsys.readouterr().out
    assert main(["features"]) == 0
    assert main(["search", SF, "the"]) == 0 and "strength" in capsys.readouterr().out
    assert main(["doctor", SF]) == 0 and "pending" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "nothing", SF])

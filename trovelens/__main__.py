"""A thin runner over the catalogue.

python -m trovelens list                          the names of all queries
python -m trovelens run NAME SF_DIR               one of them
python -m trovelens index SF_DIR                  build the search structures and say what they hold
python -m trovelens search SF_DIR TEXT            keyword search for a text of one's own
python -m trovelens search SF_DIR [--mode MODE]   the labelled queries: hybrid, keyword, vector, visual or z
python -m trovelens eval SF_DIR [--mode MODE]     recall and MRR of one mode, or of all six
python -m trovelens roots SF_DIR                  roots with their status and how much of each is indexed
python -m trovelens errors SF_DIR                 the newest files in error
python -m trovelens doctor SF_DIR                 states of files, and enabled roots that are not ok
python -m trovelens features                      the models and extractors that are registered

On a cluster spark.checkpoint.dir must name a folder that all share.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from trovelens import catalogue
from trovelens.operators import embed, extract, fusion
from trovelens.plans import eval_queries
from trovelens.plans.index_store import index
from trovelens.sources import tables

NAMED = {"roots": ["root_counts"], "errors": ["errors_newest"], "doctor": ["state_counts", "permissions_report"]}
SEARCHES = {"hybrid": "hybrid_search", "keyword": "search_keyword", "vector": "search_vector", "visual": "search_visual", "z": "z_search"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trovelens", usage=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    sub.add_parser("features")
    run = sub.add_parser("run")
    run.add_argument("name", choices=sorted(catalogue.QUERIES))
    run.add_argument("sf_dir")
    for name in ("index", *NAMED):
        sub.add_parser(name).add_argument("sf_dir")
    search = sub.add_parser("search")
    search.add_argument("sf_dir")
    search.add_argument("text", nargs="?")
    search.add_argument("--mode", choices=sorted(SEARCHES), default="hybrid")
    search.add_argument("--limit", type=int, default=10)
    evaluate = sub.add_parser("eval")
    evaluate.add_argument("sf_dir")
    evaluate.add_argument("--mode", choices=eval_queries.MODES)
    return p


def main(args: list[str]) -> int:
    asked = parser().parse_args(args)
    if asked.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    if asked.command == "features":
        print("models", *sorted(embed.MODELS), "\nrerankers", *sorted(embed.RERANKERS), "\nextractors", *sorted({"text", "code", "office", *extract._SEAMS}))
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if asked.command == "index":
        store = index(spark, asked.sf_dir)
        print(f"files {store.files.count()}, chunks {store.keyword.chunks}, terms {store.keyword.vocabulary.count()}")
        return 0
    if asked.command == "search" and asked.text is not None:
        queries = spark.createDataFrame([(0, asked.text)], "query_id int, query string")
        hits = fusion.search(queries, index(spark, asked.sf_dir), tables.NOW_S, asked.limit, "keyword")
        hits.select("rank", "path", "score", "strength", "page").orderBy("rank").show(asked.limit, truncate=80)
        return 0
    if asked.command == "eval" and asked.mode:
        eval_queries.Labelled(spark, asked.sf_dir).report(asked.mode).show()
        return 0
    names = {"run": [getattr(asked, "name", None)], "search": [SEARCHES.get(getattr(asked, "mode", None))], "eval": ["eval_modes"], **NAMED}[asked.command]
    for name in names:
        catalogue.QUERIES[name](spark, asked.sf_dir).show(50, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

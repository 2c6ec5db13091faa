"""python -m fathomline build|search: an index of page and edge files, and searches in it."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import graph
from .plans.engine import EXPANSIONS, METHODS, SearchEngine
from .sources import files


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="fathomline", description=__doc__)
    todo = parser.add_subparsers(dest="todo", required=True)
    build = todo.add_parser("build")
    build.add_argument("--pages", required=True)
    build.add_argument("--edges", required=True)
    build.add_argument("--out", required=True)
    search = todo.add_parser("search")
    search.add_argument("--index", required=True)
    search.add_argument("--method", choices=METHODS, default="tfidf")
    search.add_argument("--expand", choices=EXPANSIONS)
    search.add_argument("-k", type=int, default=10)
    search.add_argument("query", nargs="+")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName("fathomline").getOrCreate()
    if given.todo == "build":
        pages = files.number_pages(files.read_pages(spark, given.pages))
        urls = files.last_doc_of_url(pages)
        nodes, edges = graph.build_graph(urls, files.read_edges(spark, given.edges))
        SearchEngine.build(pages, pages.select(F.col("doc_id").alias("id")), edges).save(given.out)
        return
    engine = SearchEngine.load(spark, given.index)
    asked = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(" ".join(given.query)).alias("query"))
    found = engine.expand_and_search(asked, given.expand, given.method, given.k) if given.expand else engine.search(asked, given.method, given.k)
    for r in found.orderBy("rank").collect():
        print(f"{r['rank']:>3}  {r['score']:.6f}  {r['url']}  {r['title']}")


if __name__ == "__main__":
    main()
